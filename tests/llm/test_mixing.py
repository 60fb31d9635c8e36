import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from caselight.llm import mixing as X
from caselight.llm.queries import op9_source_mixing

WEIGHTS = (5, 2, 1)


def size(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), float(sum(sizes.values()))
    while True:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
            open_.remove(s)
        left = sum(sizes.values()) - sum(target.values())
    return target | {s: left * weight[s] / sum(weight[s] for s in open_) for s in open_}


def check(df):
    want = defaultdict(int)
    for r in df.collect():
        want[r.source] += size(r.text)
    targets, rows = brute_targets(dict(want)), X.assign(df).collect()
    assert len(rows) == df.count()
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == want[r.source] and r.target == pytest.approx(targets[r.source])
        assert 0 <= r.taken <= 3 * r.size and (r.position is None) == (r.taken == 0)
        assert r.position is None or 0 <= r.position <= 1
        taken[r.source] += r.taken
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 1
    return rows


def test_targets_and_takes(docs, odd, none):
    rows = check(docs)
    again = X.assign(docs.repartition(7)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    check(odd)
    assert X.assign(none).collect() == []


def test_no_words_at_all(odd):
    rows = X.assign(odd.withColumn("text", F.lit(" "))).collect()
    assert len(rows) == 16 and all(r.taken == 0 and r.target == 0 for r in rows)


def test_demand_is_inverted(spark):
    for a, b in X.SCHEDULES:
        t = [i / 20 for i in range(21)]
        share = [(a * x + (b - a) * x * x / 2) / ((a + b) / 2) for x in t]
        df = spark.createDataFrame([(s, a, b) for s in share], "s double, a double, b double")
        got = [r[0] for r in df.select(X.demand_time(F.col("s"), F.col("a"), F.col("b"))).collect()]
        assert got == pytest.approx(t, abs=1e-9)


def test_training_order(docs):
    mixed = X.assign(docs, keep=("text",))
    order = X.training_order(mixed, ("text", "size")).collect()
    at = [r.position for r in order]
    assert at == sorted(at)
    words = defaultdict(int)
    for r in order:
        words[r.doc_id] += r.words
    assert words == {r.doc_id: r.taken for r in mixed.collect() if r.taken}


def test_targets_follow_the_integrals_of_the_schedules(spark):
    """Weight times schedule, integrated: 5 of 12 words, 4 of 12, none of c and 3 of 12 (weight 5, 0.6 on the mean)."""
    rows = [(10 * i + j, "w " * 12, s) for i, s in enumerate("abcd") for j in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    schedules = ((0.0, 2.0), (3.0, 1.0), (0.0, 0.0), (1.2, 0.0))
    got = X.assign(df, schedules=schedules).collect()
    targets = {r.source: r.target for r in got}
    assert targets == pytest.approx({"a": 200.0, "b": 160.0, "c": 0.0, "d": 120.0})
    assert {s: sum(r.taken for r in got if r.source == s) for s in "abcd"} == {"a": 200, "b": 160, "c": 0, "d": 120}
    first = {s: min(r.position for r in got if r.source == s and r.taken) for s in "abd"}
    assert first == {"a": 0.0, "b": 0.0, "d": 0.0}
    # Words wanted in the first half: 1/4 of a's, 5/8 of b's and 3/4 of d's demand; a document is 12 words.
    uses = X.training_order(X.assign(df, schedules=schedules), ("source",)).where("position < 0.5").collect()
    half = {s: sum(r.words for r in uses if r.source == s) for s in "abd"}
    assert all(abs(half[s] - share * targets[s]) <= 12 for s, share in (("a", 1 / 4), ("b", 5 / 8), ("d", 3 / 4)))


def test_all_that_weigh_are_full(spark):
    rows = [(1, "w " * 90, "a"), (2, "w w", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = X.assign(df, schedules=((0.0, 0.0), (1.0, 0.0))).collect()
    assert {r.source: (r.target, r.taken) for r in got} == {"a": (0.0, 0), "b": (6.0, 6)}


def test_query_is_in_training_order(spark, sf):
    query = op9_source_mixing(spark, sf)
    assert "rangepartitioning(position" in query._jdf.queryExecution().executedPlan().toString()
    rows = query.collect()
    at = [(r.position is None, r.position or 0, r.doc_id) for r in rows]
    assert at == sorted(at) and len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_unused_documents_come_last(odd):
    rows = X.first_uses(X.assign(odd)).collect()
    unused = [r.position is None for r in rows]
    assert len(rows) == 16 and any(unused) and unused == sorted(unused)


def test_cut_words(spark):
    df = spark.createDataFrame([("a  b\nc ", 3, 3), ("a  b\nc ", 2, 3), ("a", 0, 1)], "t string, w int, n int")
    assert [r[0] for r in df.select(X.cut_words(F.col("t"), F.col("w"), F.col("n"))).collect()] == ["a  b\nc ", "a b", ""]


def test_no_python_in_the_plan(docs):
    plan = X.training_order(X.assign(docs))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan
