import math

import numpy as np
import pytest

from caselight.llm import lattice as L


def brute(rows):
    good = {}
    for i, (vid, v) in enumerate(rows):
        ok = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        if ok and vid is not None:
            good[i] = np.array(v, float)
    links = {i: set() for i in range(len(rows))}
    for i in good:
        for j in good:
            if i != j and len(good[i]) == len(good[j]):
                cos = good[i] @ good[j] / (np.linalg.norm(good[i]) * np.linalg.norm(good[j]))
                if cos >= 0.95:
                    links[i].add(j)
    label = [vid for vid, _ in rows]
    changed = True
    while changed:
        changed = False
        for i in good:
            for j in good:
                if (j in links[i] or rows[i][0] == rows[j][0]) and label[j] < label[i]:
                    label[i], changed = label[j], True
    return sorted(((v, len(links[i]), label[i], v is not None and v == label[i]) for i, (v, _) in enumerate(rows)), key=str)


def result(df, **how):
    return sorted(map(tuple, L.link(df, **how).collect()), key=str)


def test_nearest_point_is_nearest():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 8)) * 2
    p = L.nearest_e8(x)
    assert np.all((2 * p) % 1 == 0) and np.all(p.sum(axis=1) % 2 == 0)
    around = L.e8_neighbours()
    assert len({tuple(v) for v in around}) == 240 and np.allclose((around**2).sum(axis=1), 2)
    mine = ((x - p) ** 2).sum(axis=1)
    assert all(np.all(mine <= ((x - p - v) ** 2).sum(axis=1) + 1e-12) for v in around)


def test_against_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    rng = np.random.default_rng(3)
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    size = max(np.linalg.norm(v) for _, v in rows)
    for i in range(0, len(rows), 5):  # chains of near copies
        for j in range(1, 4):
            near = np.array(rows[i][1]) + 0.01 * j * size * rng.normal(size=len(rows[i][1]))
            rows.append((10_000 * j + i, near.tolist()))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute(rows)
    assert sum(r[1] for r in want) > 50
    assert result(df) == want


def test_odd_rows(spark):
    base = [1.0, 2.0, 3.0, 4.0]
    rows = [
        (1, base), (2, base), (2, base), (3, [2.0, 4.0, 6.0, 8.0]), (4, None), (5, []), (6, [0.0] * 4),
        (7, [1.0, None, 3.0, 4.0]), (8, [float("nan"), 1.0, 1.0, 1.0]), (9, [float("inf"), 1.0, 1.0, 1.0]),
        (None, base), (10, [1.0, 2.0, 3.0]), (11, [-1.0, -2.0, -3.0, -4.0]), (12, [1.0, 2.0, 3.0, 4.1]), (12, [9.0, 0.0, 0.0, 0.0]),
    ]
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<float>, id string, n int")
    assert result(df) == brute(rows)
    assert result(df.limit(0)) == []


@pytest.mark.parametrize("lattices", [1, 2])
def test_recall_at_the_threshold(spark, lattices):
    """Pairs at cosine 0.95 to 0.97, the hardest ones."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(600, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    noise = rng.normal(size=x.shape)
    noise -= (noise * x).sum(axis=1, keepdims=True) * x
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    cos = rng.uniform(0.951, 0.97, size=(600, 1))
    y = cos * x + np.sqrt(1 - cos**2) * noise
    rows = [(i, v.tolist()) for i, v in enumerate([*x, *y])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    kinds = L.classes(df)
    name = {r.id: r.vec_id for r in kinds.collect()}
    found = {tuple(sorted((name[r.a], name[r.b]))) for r in L.near_pairs(kinds, lattices=lattices).collect()}
    assert found <= {(i, i + 600) for i in range(600)}
    assert len(found) >= 0.9 * 600


def test_extreme_magnitudes(spark):
    rows = [
        (1, [1e200, 0.0]), (2, [0.0, 1e200]), (3, [1e-200, 0.0]), (4, [0.0, 1e-200]), (5, [2e200, 4e200]), (6, [1.0, 2.0]),
        (7, [1e300, 1e-300]), (8, [5e-324, 0.0]), (9, [1e308, 1e308, 1e308]), (10, [1e-308, 1e-308, 1e-308]),
    ]
    got = {r.vec_id: (r.n_links, r.component_id) for r in L.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got[5] == got[6] == (1, 5) and got[9] == got[10] == (1, 9)
    assert [got[i] for i in (1, 3, 7, 8)] == [(3, 1)] * 4 and [got[i] for i in (2, 4)] == [(1, 2)] * 2
