import numpy as np
import pyarrow as pa
import pytest

from caselight.llm import cells
from caselight.llm import lattice as L

from .test_lattice import brute

TABLES, PROBES = 4, 12


def grouped(rng, groups, alone, dim=64):
    """Groups of different near vectors, and random ones."""
    out = [rng.normal(size=(alone, dim))]
    for size in groups:
        middle = rng.normal(size=dim)
        out.append(middle / np.linalg.norm(middle) + 0.15 / np.sqrt(dim) * rng.normal(size=(size, dim)))
    return np.concatenate(out)


def near(x, bound=0.95):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = unit @ unit.T >= bound
    np.fill_diagonal(out, False)
    return out


def components(edges, n):
    low = list(range(n))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for a, b in edges:
        a, b = sorted((root(a), root(b)))
        low[b] = a
    return [root(i) for i in range(n)]


def dealt(make, batches, buckets, then):
    """What a shuffle between two tasks' functions does."""
    sent = pa.Table.from_batches(list(make(batches)), pa.schema([("bucket", pa.int32()), ("grp", pa.int64()), ("payload", pa.binary())]))
    for b in range(buckets):
        got = sent.filter(pa.compute.equal(sent["bucket"], b)).combine_chunks().to_batches()
        yield from then(iter(got))


def search(x, n, pairs, turns, parts=1, lattices=1):
    """Both searches without Spark, with the cells as large as the constants of the module have it."""
    ids = np.random.default_rng(9).permutation(len(x)) * 1000  # ids in no order
    kind = "<f4" if x.dtype == np.float32 else "<f8"
    rows = pa.RecordBatch.from_pydict({"id": ids, "n": n, "embedding": pa.array(list(x))})
    signed = list(L._sign(TABLES, lattices, PROBES, L.SCALES[lattices], 20)([rows.slice(0, 150), rows.slice(150)]))
    step = cells.neighbour_keys(L.e8_neighbours(), lattices)
    mask, large = {}, {}
    deal = cells.deal_sketches(TABLES, list(range(TABLES)), PROBES, step, 3)
    for batch in dealt(deal, signed, 3, cells.meet(cells.sketch_bound(0.95))):
        for r in batch.to_pylist():
            if r["mask"]:
                mask[r["id"], r["grp"] % TABLES] = mask.get((r["id"], r["grp"] % TABLES), 0) | r["mask"]
            else:
                large.setdefault(r["grp"], []).append((r["id"], -(-r["homes"] // cells.GRID), -(-r["asks"] // cells.GRID)))
    large = {g: tuple(np.array(sorted(v), np.int64).T) for g, v in large.items()}
    for t in range(TABLES):
        signed = [b.append_column(f"mask_{t}", pa.array([mask.get((i, t)) for i in b["id"].to_pylist()], pa.int64())) for b in signed]
    out = []
    for which in turns:
        for part in range(parts):
            deal = cells.deal_vectors(TABLES, which, PROBES, step, 5, kind, large, parts, part)
            for batch in dealt(deal, signed, 5, cells.link(TABLES, PROBES, step, kind, 0.95, pairs)):
                out += batch.to_pylist()
    at = {int(v): i for i, v in enumerate(ids)}
    return [(at[r["a"]], at.get(r["b"]), r["near"]) for r in out], large


@pytest.mark.parametrize(
    ("listed", "grid", "turns", "parts", "kind"),
    [
        (4096, 8192, [[0, 1, 2, 3]], 1, np.float64),
        (4096, 8192, [[0], [1], [2, 3]], 3, np.float32),
        (8, 8192, [[0, 1], [2, 3]], 1, np.float64),
        (8, 10, [[0], [1, 2, 3]], 2, np.float32),
    ],
)
def test_each_pair_counts_once(monkeypatch, listed, grid, turns, parts, kind):
    """Small cells and large ones, cells cut into parts, tables together and apart: the same pairs, each of them once."""
    monkeypatch.setattr(cells, "LISTED", listed)
    monkeypatch.setattr(cells, "GRID", grid)
    rng = np.random.default_rng(4)
    x = grouped(rng, (130, 90, 12, 2, 2, 2), 200).astype(kind)
    n = rng.integers(1, 5, len(x))
    want = near(x.astype(np.float64))
    pairs, large = search(x, n, True, turns, parts)
    assert bool(large) == (grid == 10)
    assert sorted(tuple(sorted(p[:2])) for p in pairs) == sorted(map(tuple, np.argwhere(np.triu(want))))
    links, _ = search(x, n, False, turns, parts)
    sums = np.zeros(len(x), int)
    for a, _, count in links:
        sums[a] += count or 0
    assert sums.tolist() == (want @ n).tolist()
    edges = [(a, b) for a, b, _ in links if b is not None]
    assert components(edges, len(x)) == components(np.argwhere(want), len(x))
    # A row and a forest edge or two of a vector in a cell, not one of each of the pairs.
    assert len(links) < 40 * len(x) or listed == 8


def test_sketches_keep_every_near_pair():
    rng = np.random.default_rng(2)
    for dim in (2, 8, 64, 300):
        x = rng.normal(size=(400, dim))
        y = rng.normal(size=x.shape)
        x, y = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
        y -= (x * y).sum(axis=1, keepdims=True) * x
        y = 0.95 * x + np.sqrt(1 - 0.95**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
        a, b = (cells.sketches(v, 20).astype(int) for v in (x, y))
        assert ((a - b) ** 2).sum(axis=1).max() <= cells.sketch_bound(0.95)


def test_a_vector_is_not_written_for_each_cell_or_pair(spark, monkeypatch):
    """Staged tables stay in proportion to the vectors, though each asks 104 cells and 300 of them are near each other."""
    rows = []

    def counted(df, tag, write=L.stage):
        out = write(df, tag)
        rows.append((out.count(), tag))
        return out

    monkeypatch.setattr(L, "stage", counted)
    x = grouped(np.random.default_rng(6), (300,), 700)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in L.link(df).collect()}
    assert all(got[i] == (0, i) for i in range(700)) and all(got[i] == (299, 700) for i in range(700, 1000))
    assert len(rows) > 3 and max(rows)[0] <= 16 * len(x), rows


def test_vectors_of_one_hash(spark, monkeypatch):
    """Rows find their vector also where the hash is that of several."""
    monkeypatch.setattr(L, "_digest", lambda: L.F.pmod(L.F.xxhash64("embedding"), L.F.lit(3)))
    x = grouped(np.random.default_rng(8), (5, 2), 6, dim=12).astype(np.float32)
    x[3, 2] = 0.0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(50, rows[0][1]), (51, rows[7][1]), (51, rows[7][1]), (52, [*rows[3][1][:2], -0.0, *rows[3][1][3:]]), (53, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(map(tuple, L.link(df).collect()), key=str) == brute(rows)
