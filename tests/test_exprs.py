import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from caselight.functions import exprs as X


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def murmur3(text: str, seed: int = 42) -> int:
    """The 32-bit string hash Spark documents, written out for a check."""
    mask = 0xFFFFFFFF

    def rotl(x, r):
        return ((x << r) | (x >> (32 - r))) & mask

    def mix_k(k):
        return rotl((k * 0xCC9E2D51) & mask, 15) * 0x1B873593 & mask

    def mix_h(h, k):
        return (rotl(h ^ k, 13) * 5 + 0xE6546B64) & mask

    data, h = text.encode(), seed
    cut = len(data) // 4 * 4
    for i in range(0, cut, 4):
        h = mix_h(h, mix_k(int.from_bytes(data[i : i + 4], "little")))
    for b in data[cut:]:
        h = mix_h(h, mix_k((b - 256 if b > 127 else b) & mask))
    h ^= len(data)
    h = (h ^ h >> 16) * 0x85EBCA6B & mask
    h = (h ^ h >> 13) * 0xC2B2AE35 & mask
    h ^= h >> 16
    return h - (1 << 32) if h >> 31 else h


@pytest.mark.parametrize("key", ["", "a", "CALL000000000017", "DOC0000000000013", "é-doc"])
def test_bucket_is_abs_hash_modulo(spark, key):
    for n, salt in ((5, ""), (90, "h"), (540, "wait")):
        assert one(spark, X.bucket(F.lit(key), n, salt)) == abs(murmur3(key + salt)) % n


def test_bucket_survives_the_smallest_hash(spark):
    smallest = F.lit(-(2**31)).cast("int")
    assert one(spark, F.abs(smallest.cast("long")) % 5) == 2**31 % 5


@pytest.mark.parametrize(
    "unreadable, dob, ssn4, tier",
    [
        (True, False, False, X.TIER_UNREADABLE),
        (False, True, True, X.TIER_NONE),
        (False, None, None, X.TIER_NONE),
        (None, None, False, X.TIER_ONE),
        (False, False, True, X.TIER_ONE),
        (False, False, False, X.TIER_BOTH),
    ],
)
def test_risk_tier(spark, unreadable, dob, ssn4, tier):
    cols = [F.lit(v).cast("boolean") for v in (unreadable, dob, ssn4)]
    assert one(spark, X.risk_tier(*cols)) == tier


def test_score_cuts(spark):
    df = spark.createDataFrame([(v,) for v in (100, 90, 89, 85, 84, 75, 74, 70, 69, 60, 59)], "s int")
    got = {r.s: (r.b, r.d) for r in df.select("s", X.outcome_bucket(F.col("s")).alias("b"), X.score_band(F.col("s")).alias("d")).collect()}
    assert got[85] == ("compliant", "Good") and got[84] == ("needs_review", "Good")
    assert got[70] == ("needs_review", "Needs Coaching") and got[69] == ("high_risk", "Needs Coaching")
    assert got[90][1] == "Excellent" and got[59][1] == "At Risk" and got[74][1] == "Needs Coaching"


def test_rubric_weights(spark):
    assert one(spark, X.call_score(*[F.lit(v) for v in (100.0, 80.0, 50.0, 20.0)])) == pytest.approx(75.0)


def test_match_class_is_strict(spark):
    df = spark.createDataFrame([(8.0,), (8.0001,), (3.0,), (3.0001,), (-5.0,)], "w double")
    got = [r[0] for r in df.select(X.match_class(F.col("w"), 8, 3)).collect()]
    assert got == ["possible_match", "match", "non_match", "possible_match", "non_match"]


def test_sla(spark):
    df = spark.createDataFrame([("urgent", 3), ("urgent", 4), ("standard", 7), ("standard", 8), ("other", 0)], "u string, d int")
    target = X.sla_hours(F.col("u"))
    got = [tuple(r) for r in df.select(target, X.within_sla(F.col("d"), target)).collect()]
    assert got == [(72, True), (72, False), (168, True), (168, False), (None, False)]


def test_spread_stays_in_window_and_repeats(spark):
    as_of = dt.date(2024, 6, 30)
    df = spark.range(500).select(F.concat(F.lit("DOC"), F.col("id")).alias("k"))
    ts = X.spread_ts(F.col("k"), F.lit(as_of), 90)
    got = {r.k: r.ts for r in df.select("k", ts.alias("ts")).collect()}
    days = {(as_of - v.date()).days for v in got.values()}
    assert min(days) >= 0 and max(days) <= 89 and len(days) > 60
    k = "DOC17"
    expected = dt.datetime.combine(as_of, dt.time()) - dt.timedelta(days=abs(murmur3(k)) % 90)
    expected += dt.timedelta(hours=abs(murmur3(k + "h")) % 24, minutes=abs(murmur3(k + "m")) % 60)
    assert got[k] == expected


def test_relative_windows(spark):
    d = [F.lit(dt.date(2024, 3, x)) for x in (1, 13, 20)]
    assert one(spark, X.since(d[1], d[2], 7)) and not one(spark, X.since(d[0], d[2], 7))
    assert one(spark, X.month_to_date(d[0], d[2]))
    assert not one(spark, X.month_to_date(F.lit(dt.date(2024, 2, 29)), d[2]))


def test_weights():
    agree, disagree = X.fs_weights(0.95, 0.001)
    assert round(agree, 4) == 9.8918 and round(disagree, 4) == -4.3205
    assert X.fs_weights(0.9, 0.0)[0] == 8.0 and X.fs_weights(0.9, 1.0)[1] == -4.0


def test_weight_expression(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), (None, "b")], "x string, y string")
    w = X.fs_weight(F.col("x") == F.col("y"), 0.9, 0.1, missing=F.col("x").isNull(), mult=2.0)
    got = [r[0] for r in df.select(w).collect()]
    assert got == pytest.approx([2 * math.log2(9), 2 * math.log2(1 / 9), 0.0])


def test_formats(spark):
    day = F.lit(dt.date(2024, 1, 9))
    assert one(spark, X.auth_number(day, F.lit(123456))) == "AUTH-2024-123456"
    assert one(spark, X.batch_id(day, F.lit(7))) == "MRM-20240109-007"
    assert one(spark, X.template_id(F.lit("claims_status"), F.lit(3))) == "TPL_CLA_03"
    assert one(spark, X.padded_id("CALL", F.lit(12), 8)) == "CALL00000012"
    assert one(spark, X.score_sentence(F.lit(70), F.lit("resolved"))) == "Score 70: resolved call with adequate documentation."
    assert one(spark, X.clamp(F.lit(130), 0, 100)) == 100 and one(spark, X.clamp(F.lit(-3), 0, 100)) == 0
    assert one(spark, X.link_confidence(F.lit(9.0938), 15.0)) == 0.6063
    assert one(spark, X.link_confidence(F.lit(23.0), 15.0)) == 1.0
    assert one(spark, X.pick(["a", "b", "c"], F.lit(2))) == "c"
