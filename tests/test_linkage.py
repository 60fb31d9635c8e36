import random
from itertools import product

import pytest
from pyspark.sql import functions as F

from caselight.functions.exprs import fs_weights
from caselight.operators import joins as J
from caselight.operators import linkage as L
from conftest import rows, same

FIELDS = ("name", "dob", "ssn4")


def _sides(spark, n_docs=150, n_members=40, seed=5):
    rnd = random.Random(seed)

    def row(i, prefix, hole):
        pick = lambda values: rnd.choice(values + [None] * hole)
        return (f"{prefix}{i:04d}", pick(list("abcde")), pick(list("rstuvw")), pick(list("123456789")))

    docs = spark.createDataFrame([row(i, "d", 3) for i in range(n_docs)], "doc_id string, name string, dob string, ssn4 string")
    members = spark.createDataFrame([row(i, "m", 1) for i in range(n_members)], "mid string, name string, dob string, ssn4 string")
    return docs, members


def _brute(docs, members, fields):
    best = {}
    for d, m in product(docs.collect(), members.collect()):
        total, parts = 0.0, []
        for f in fields:
            yes, no = f.weights
            w = 0.0 if d[f.name] is None else (yes if d[f.name] == m[f.name] else no)
            total += w
            parts.append(round(w, 4))
        key = (-round(total, 9), m.mid)
        if d.doc_id not in best or key < best[d.doc_id][0]:
            best[d.doc_id] = (key, (d.doc_id, m.mid, *parts, round(total, 4)))
    return sorted(v[1] for v in best.values())


@pytest.mark.parametrize("split", [{}, {"hot_rows": 5, "fraction": 1.0}])
def test_best_link_equals_brute_force(spark, split):
    docs, members = _sides(spark)
    got = L.best_links(docs, members, "doc_id", "mid", L.MEMBER_FIELDS, **split)
    assert rows(got) == _brute(docs, members, L.MEMBER_FIELDS)


def test_best_link_with_two_fields_and_equal_weights(spark):
    docs, members = _sides(spark, seed=8)
    fields = (L.Compare("name", 0.9, 0.1), L.Compare("dob", 0.9, 0.1))
    got = L.best_links(docs.drop("ssn4"), members.drop("ssn4"), "doc_id", "mid", fields)
    assert rows(got) == _brute(docs, members, fields)


def test_documents_without_fields_still_get_a_candidate(spark):
    members = _sides(spark)[1]
    docs = spark.createDataFrame([("d1", None, None, None)], "doc_id string, name string, dob string, ssn4 string")
    assert rows(L.best_links(docs, members, "doc_id", "mid", L.MEMBER_FIELDS)) == [("d1", "m0000", 0.0, 0.0, 0.0, 0.0)]


def test_agreeing_must_weigh_more(spark):
    docs, members = _sides(spark, 2, 2)
    with pytest.raises(ValueError):
        L.best_links(docs, members, "doc_id", "mid", [L.Compare("name", 0.1, 0.9)])


def test_every_structured_document_has_one_member_candidate(reg):
    cands = reg.table("doc_member_match_candidates")
    docs = reg.table("clinical_doc_structured")
    assert cands.count() == docs.count() == cands.select("doc_id").distinct().count()
    assert {r[0] for r in cands.select("match_class").distinct().collect()} == {"match", "possible_match", "non_match"}


def test_full_agreement_finds_the_true_member(reg):
    cands = reg.table("doc_member_match_candidates").where(F.col("total_weight") > 20)
    truth = reg.table("clinical_document").select("doc_id", "member_id")
    assert cands.join(truth, "doc_id").where("candidate_member_id <> member_id").count() == 0


def test_salted_lookup_equals_plain_join(spark):
    facts = spark.range(500).select(F.col("id"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    index = facts.select("k").distinct().where("k <> '3'").withColumn("v", F.length("k"))
    got = J.balanced_lookup(facts, index, ["k"], "id", hot_rows=50, fraction=1.0)
    same(got, facts.join(index, "k", "left"))
    hot = rows(J.hot_keys(facts, ["k"], 50, 1.0))
    assert [h[0] for h in hot] == ["hot"] and hot[0][1] >= 7


def test_best_candidate_breaks_ties_by_id(spark):
    df = spark.createDataFrame(
        [("d1", "b", 2.0, "x"), ("d1", "a", 2.0, "y"), ("d1", "c", 1.0, "z"), ("d2", "q", -1.0, "w")],
        "doc_id string, cid string, total_weight double, match_class string",
    )
    assert rows(L.best_candidate(df, "cid")) == [("d1", "a", 2.0, "y"), ("d2", "q", -1.0, "w")]


def test_patterns_equal_brute_force(spark):
    docs, members = _sides(spark)
    expected = {}
    for d, m in product(docs.collect(), members.collect()):
        there = sum(1 << i for i, f in enumerate(FIELDS) if d[f] is not None)
        agreed = sum(1 << i for i, f in enumerate(FIELDS) if d[f] is not None and d[f] == m[f])
        expected[there, agreed] = expected.get((there, agreed), 0) + 1
    got = {(r.there, r.agreed): int(r.pairs) for r in L.agreement_patterns(docs, members, FIELDS).collect()}
    assert got == expected


def test_estimated_probabilities_separate_matches(spark):
    # 1000 true pairs among a million, agreeing 90/80/95 percent of the time.
    m, u, n_true, n_false = (0.9, 0.8, 0.95), (0.05, 0.02, 0.01), 1000, 999_000
    data = []
    for code in range(8):
        p = q = 1.0
        for i in range(3):
            p *= m[i] if code >> i & 1 else 1 - m[i]
            q *= u[i] if code >> i & 1 else 1 - u[i]
        data.append((7, code, round(n_true * p + n_false * q)))
    patterns = spark.createDataFrame(data, "there int, agreed int, pairs long")
    for r in L.estimate_mu(patterns, FIELDS, 200).collect():
        i = FIELDS.index(r.field)
        assert abs(r.m - m[i]) < 0.06 and abs(r.u - u[i]) < 0.01


def test_likelihood_never_falls_and_rounds_are_told(spark):
    rng = random.Random(2)
    for _ in range(20):
        data = [(there, code, float(rng.randint(1, 10**rng.randint(1, 7)))) for there in (7, 5, 2) for code in range(8) if not code & ~there]
        _, _, trace = L.fit_mu(data, 3, 300, 1e-14)
        assert all(b >= a - 1e-12 * abs(a) for a, b in zip(trace, trace[1:]))
    patterns = spark.createDataFrame([(t, c, int(n)) for t, c, n in data], "there int, agreed int, pairs long")
    few, many = (L.estimate_mu(patterns, FIELDS, n).first() for n in (2, 20_000))
    assert (few.rounds, few.converged) == (2, False) and many.converged and many.rounds < 20_000
    assert many.log_likelihood >= few.log_likelihood
    assert L.estimate_mu(patterns.limit(0), FIELDS).count() == 3


def test_hot_values_are_split_and_numbers_aggregated(spark, tmp_path):
    """A third of all documents share one combination: the final join splits it, and probes go through hash tables."""
    docs = spark.range(60_000).select(
        F.concat(F.lit("d"), "id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "unknown").otherwise(F.concat(F.lit("n"), F.col("id"))).alias("name"),
        F.when(F.col("id") % 3 == 0, "1970").otherwise(F.concat(F.lit("b"), F.col("id") % 500)).alias("dob"),
        F.when(F.col("id") % 3 != 0, F.col("id").cast("string")).alias("ssn4"),
    )
    docs.write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    members = docs.where("ssn4 IS NOT NULL").select(F.concat(F.lit("m"), "doc_id").alias("mid"), "name", "dob", "ssn4").limit(20_000)
    low = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "6",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10k", "spark.sql.files.maxPartitionBytes": "100k",
        "spark.sql.files.openCostInBytes": "1k",
    }
    before = {c: spark.conf.get(c, None) for c in low}
    try:
        for c, v in low.items():
            spark.conf.set(c, v)
        found = L.best_links(docs, members, "doc_id", "mid", L.MEMBER_FIELDS)
        assert len({r.doc_id for r in found.collect()}) == 60_000
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in before.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
    assert "skew=true" in plan and "SortAggregate" not in plan.split("Subquery")[0]


def test_events_only_for_matches(reg):
    events = reg.table("match_events")
    kinds = {r[0]: r[1] for r in events.groupBy("event_type").count().collect()}
    for table, kind in (("doc_member_match_candidates", "member_match_confirmed"), ("doc_auth_match_candidates", "auth_match_confirmed")):
        assert reg.table(table).where("match_class = 'match'").count() == kinds[kind]
    assert events.select("event_id").distinct().count() == events.count()
    assert events.where("confidence > 1 or confidence <= 0").count() == 0


def test_documented_weights():
    assert [round(w, 4) for w in fs_weights(0.89, 0.015)] == [5.8908, -3.1626]
    assert [round(w, 4) for w in fs_weights(0.92, 0.01)] == [6.5236, -3.6294]
