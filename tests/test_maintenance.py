import datetime as dt

from pyspark.sql import functions as F

from caselight.functions.exprs import PAYER_CODES
from caselight.operators import maintenance as M
from caselight.sources.schemas import SCHEMAS
from conftest import rows
from test_exprs import murmur3

AS_OF = dt.date(2024, 6, 30)
LOADED = dt.date(2024, 1, 10)


def test_payer_by_hash_and_cascade(reg):
    docs = reg.raw("clinical_document").drop("payer_code")
    once = M.assign_payer(docs, "doc_id").select("doc_id", "payer_code")
    for r in once.limit(20).collect():
        assert r.payer_code == PAYER_CODES[abs(murmur3(r.doc_id)) % 5]
    assert rows(M.assign_payer(once, "doc_id")) == rows(once)
    blank = reg.raw("clinical_doc_structured").drop("payer_code")
    filled = M.cascade_payer(blank, once).select("doc_id", "payer_code")
    assert filled.join(once, ["doc_id", "payer_code"]).count() == blank.count()
    assert rows(M.cascade_payer(filled, once)) == rows(filled)


def test_cascade_leaves_known_payers(spark):
    stage = spark.createDataFrame([("d1", "VERITAS"), ("d2", None), ("d3", None)], "doc_id string, payer_code string")
    docs = spark.createDataFrame([("d1", "METRIDIAN"), ("d2", "METRIDIAN")], "doc_id string, payer_code string")
    assert rows(M.cascade_payer(stage, docs)) == [("d1", "VERITAS"), ("d2", "METRIDIAN"), ("d3", None)]


def test_urgency_is_three_tenths(reg):
    auths = M.assign_urgency(reg.raw("authorization").drop("urgency"))
    share = auths.where("urgency = 'urgent'").count() / auths.count()
    assert 0.25 < share < 0.35
    for r in auths.select("auth_id", "urgency").limit(20).collect():
        assert (r.urgency == "urgent") == (abs(murmur3(r.auth_id)) % 10 < 3)
    assert rows(M.assign_urgency(auths).select("auth_id", "urgency")) == rows(auths.select("auth_id", "urgency"))


def test_call_timings_fill_only_missing_calls(reg, spark):
    none = spark.createDataFrame([], SCHEMAS["call_ops_supplemental"])
    now = F.lit(dt.datetime(2024, 6, 30))
    full = M.add_call_timings(none, reg.raw("mv_call_scores"), now)
    assert full.count() == reg.raw("mv_call_scores").count()
    low, high, slow, fast = full.agg(F.min("wait_seconds"), F.max("wait_seconds"), F.max("handle_seconds"), F.min("handle_seconds")).first()
    assert 60 <= low and high <= 599 and slow <= 1799 and fast >= 180
    r = full.limit(1).first()
    assert r.wait_seconds == 60 + abs(murmur3(r.call_id + "wait")) % 540
    assert r.handle_seconds == 180 + abs(murmur3(r.call_id + "handle")) % 1620
    assert r.fcr_flag == (abs(murmur3(r.call_id + "fcr")) % 100 < 70)
    again = M.add_call_timings(full, reg.raw("mv_call_scores"), now)
    assert again.count() == full.count()


def test_spread_and_stage_lag(reg):
    docs = M.spread_documents(reg.raw("clinical_document"), AS_OF, LOADED)
    old = reg.raw("clinical_document").select("doc_id", F.col("ingestion_timestamp").alias("was"))
    both = docs.join(old, "doc_id")
    moved = F.to_date("was") == F.lit(LOADED)
    assert both.where(~moved & (F.col("was") != F.col("ingestion_timestamp"))).count() == 0
    assert both.where(moved & ~F.col("ingestion_timestamp").between("2024-04-02", "2024-07-01")).count() == 0
    assert both.where(moved & (F.col("received_timestamp") != F.col("ingestion_timestamp"))).count() == 0
    stage = M.cascade_stage_ts(reg.raw("clinical_doc_structured"), "clinical_doc_structured", docs, LOADED)
    gaps = stage.join(both.where(moved).select("doc_id", "ingestion_timestamp"), "doc_id").select(
        (F.col("extraction_ts").cast("long") - F.col("ingestion_timestamp").cast("long")).alias("s")
    )
    assert rows(gaps.distinct()) == [(900,)]


def test_shift_keeps_gaps_and_leaves_pending(spark):
    d = dt.date
    auths = spark.createDataFrame(
        [
            ("a1", d(2024, 1, 3), d(2024, 1, 10)),
            ("a2", d(2024, 1, 12), d(2024, 1, 10)),
            ("a3", d(2024, 1, 3), None),
            ("a4", d(2024, 6, 1), d(2024, 6, 20)),
        ],
        "auth_id string, auth_requested_date date, auth_decision_date date",
    )
    once = M.shift_decisions(auths, AS_OF)
    got = {r[0]: r[1:] for r in rows(once)}
    decided = AS_OF - dt.timedelta(days=abs(murmur3("a1")) % 90)
    assert got["a1"] == (decided - dt.timedelta(days=7), decided)
    assert got["a2"][0] == got["a2"][1]  # a negative gap becomes zero
    assert got["a3"] == (d(2024, 1, 3), None) and got["a4"] == (d(2024, 6, 1), d(2024, 6, 20))
    assert rows(M.shift_decisions(once, AS_OF)) == rows(once)


def test_overlay_fills_blanks_only(spark):
    kept = dt.datetime(2024, 5, 5)
    df = spark.createDataFrame([("c1", None), ("c2", kept)], "call_id string, synthetic_call_ts timestamp")
    once = M.overlay_call_ts(df, AS_OF)
    got = {r[0]: r[1] for r in rows(once)}
    assert got["c2"] == kept
    assert got["c1"].date() == AS_OF - dt.timedelta(days=abs(murmur3("c1")) % 30)
    assert rows(M.overlay_call_ts(once, AS_OF)) == rows(once)
    bare = M.overlay_call_ts(df.drop("synthetic_call_ts"), AS_OF)
    assert bare.where("synthetic_call_ts IS NULL").count() == 0


def test_backfills_over_a_registry_leave_the_original_alone(reg):
    bare = reg.copy()
    for name in ("clinical_document", "authorization", *M.STAGE_LAG):
        bare.put(name, reg.raw(name).drop("payer_code", "urgency"))
    full = M.backfill_payers(bare)
    assert full.table("authorization").where("payer_code IS NULL OR urgency IS NULL").count() == 0
    assert full.table("clinical_doc_parsed").where("payer_code IS NULL").count() == 0
    assert "payer_code" not in bare.table("clinical_document").columns
    assert reg.table("clinical_document").where("payer_code IS NULL").count() > 0
    moved = M.spread_dates(full, AS_OF, LOADED)
    days = moved.table("clinical_doc_parsed").agg(F.max(F.to_date("ingest_ts"))).first()[0]
    assert days > dt.date(2024, 4, 1)
    held = reg.copy()
    held.put("call_ops_supplemental", reg.raw("call_ops_supplemental").where("fcr_flag"))
    timed = M.backfill_timings(held, F.lit(dt.datetime(2024, 6, 30)))
    assert timed.table("call_ops_supplemental").count() == reg.table("mv_call_scores").count()
