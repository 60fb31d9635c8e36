import numpy as np
import pytest

from caselight.llm import hard_negatives as hn
from caselight.llm.oracles import ORACLE_SQL
from caselight.llm.queries import QUERIES
from tools.check import compare, connect

SCHEMA = "vec_id long, embedding array<double>, label int, row string, score string"


def test_lookups_give_inner_products():
    rng = np.random.default_rng(3)
    for dim, most in ((8, 3), (24, 200), (64, 1 << 23), (16, 1)):
        a, b = (rng.integers(-most, most + 1, (n, dim)).astype(np.int32) for n in (5, 7))
        bits = hn.bit_width(b)
        codes = hn.planes(b, bits)
        assert (hn.unpack(codes[2].tobytes(), dim // 8, bits) == b[2]).all()
        assert (hn.scores(hn.subset_sums(a.astype(np.int64)), codes) == a.astype(np.int64) @ b.astype(np.int64).T).all()


def brute(rows, every=100, positives=5, negatives=10, low=30, high=90):
    """The definition, row by row; ``rows`` are (vec_id, embedding, label)."""
    good = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or x != x or abs(x) == float("inf") for x in v):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        good.append((vec_id, [hn.floor_times(float(x), 256) for x in v], label))
    out = []
    for i, (aid, a, label) in enumerate(good):
        if aid is None or aid % every:
            continue
        scored = [
            (-sum(x * y for x, y in zip(a, v, strict=True)), vid is None, vid or 0, other)
            for j, (vid, v, other) in enumerate(good)
            if j != i and len(v) == len(a)
        ]
        scored.sort()
        for s, none, vid, other in [x for x in scored if x[3] == label][:positives]:
            found = [x for x in scored if x[3] != label and low * -s <= -100 * x[0] <= high * -s][:negatives]
            for rank, (n, none2, nid, _) in enumerate(found, 1):
                out.append((aid, None if none else vid, rank, None if none2 else nid, -s, -n))
    return sorted(out, key=lambda t: tuple((v is None, v) for v in t))


def mined(df, **how):
    return sorted((tuple(r) for r in hn.mine(df, **how).collect()), key=lambda t: tuple((v is None, v) for v in t))


def test_query_matches_sql_and_brute_force(spark, sf):
    name = "op13_four_russians_negatives"
    found = QUERIES[name](spark, sf)
    assert compare(found, connect(sf).sql(ORACLE_SQL[name])) == ""
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    assert sorted(tuple(r) for r in found.collect()) == brute(rows)


@pytest.mark.parametrize(("anchors", "every"), [(2_048, 10), (3, 10), (1, 40)])
def test_odd_rows(spark, anchors, every):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(0.3, 0.5, 11)], int(rng.integers(0, 3))) for i in range(160)]
    rows += [(i, [float(x) for x in rng.integers(0, 2, 3)], 1 + i % 2) for i in range(-40, 0)]  # many ties, other length
    rows += [(200, None, 1), (210, [1.0, None], 1), (220, [float("nan")] * 11, 1), (230, [float("inf")] * 11, 2)]
    rows += [(240, [], 1), (241, [], 1), (250, [], 2), (260, rows[0][1], None), (None, rows[3][1], 0), (None, rows[5][1], 1)]
    rows += [(20, rows[20][1], rows[20][2]), (21, rows[20][1], 2), (300, [0.0] * 11, 1)]
    rows += [(400, [1e5, -2e5] + [0.5] * 9, 0), (401, [1e7] * 11, 0), (402, [-1e6] * 11, 1), (403, [1e5, 0.1] + [0.0] * 9, 2)]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA).repartition(5)
    want = brute(rows, every)
    assert len({w[0] for w in want}) > 3 and mined(df, anchors=anchors, every=every) == want


def test_products_beyond_a_long_end_at_it(spark):
    rows = [(100, [1e12], 1), (1, [1e12], 1), (2, [5e11], 2), (3, [1.0], 2), (4, [1e300], 2)]
    found = mined(spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA))
    assert found == [(100, 1, 1, 2, hn.LONG, hn.LONG)]


def test_empty(spark):
    assert mined(spark.createDataFrame([], SCHEMA)) == []
    assert mined(spark.createDataFrame([(5, [1.0], 1, "a", "b")], SCHEMA)) == []
