"""What happens in the cells of a lattice hash: which vectors meet there, and which of them are near.

Rows travel packed: a task sends all it has for a bucket of cells as one value, and a bucket is searched with
arrays.  The first search has sketches, short projections whose distance is never above that of the vectors; it
tells the rows that can have a partner in their cell.  The second has those rows with their vectors.  There a pair
counts in the first table, and the first direction, that proposes it, as both vectors carry their cells of the
tables before; so no list of pairs is ever written to take repeats out.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from caselight.llm.components import _roots

SKETCH = 24  # components of a sketch, a byte each
SLIM = np.dtype([("key", "<i8"), ("id", "<i8"), ("slot", "u1"), ("sketch", "i1", (SKETCH,))])
DEALT = "bucket int, grp long, payload binary"
MET = "id long, grp long, mask long, homes long, asks long"
LINKS = "a long, b long, near long"

LISTED = 4096  # pairs of a cell up to which they are listed; above, blocks are multiplied
GRID = 8192  # rows to a side of the parts that a cell of very many pairs is cut into
EDGE = 1e-9  # so close to the bound, cosines are summed anew, in the order of their components
HELD = 1_000_000


def neighbour_keys(around: np.ndarray, lattices: int) -> np.ndarray:
    """What the step to each neighbour, of each lattice in turn, adds to a cell's key."""
    steps = np.zeros((lattices * len(around), 8 * lattices))
    for k in range(lattices):
        steps[k * len(around) : (k + 1) * len(around), 8 * k : 8 * k + 8] = around
    return point_keys(steps)


def narrow(step: np.ndarray) -> str:
    """The bytes that a neighbour's number takes."""
    return "u1" if len(step) <= 256 else "<u2"


def asked_column(home: np.ndarray, asked: np.ndarray, step: np.ndarray) -> pa.Array:
    """The key of each row's cell with the numbers of the neighbours it asks."""
    few = np.dtype(narrow(step))
    out = np.empty(len(home), np.dtype([("home", "<i8"), ("asked", few, asked.shape[1:])]))
    out["home"], out["asked"] = home, asked
    return binary(out)


def home_and_asked(column: pa.Array, probes: int, step: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows = fixed(column, np.dtype([("home", "<i8"), ("asked", narrow(step), (probes,))]))
    return rows["home"], rows["asked"]


def point_keys(points: np.ndarray) -> np.ndarray:
    """64 bits of each row of lattice points, additive: the key of a sum is the sum of the keys."""
    weight = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(points.shape[1])], np.uint64)
    twice = np.rint(2 * points).astype(np.int64).astype(np.uint64)
    return (twice * weight).sum(axis=1, dtype=np.uint64).view(np.int64)


def units(vectors: np.ndarray) -> np.ndarray:
    unit = vectors.astype(np.float64)
    unit = np.ldexp(unit, -np.frexp(np.abs(unit).max(axis=1, keepdims=True))[1])
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosines of vectors of any magnitude: each is first divided by a power of two, which changes no digit."""
    edge = np.arange(0, x.size, x.shape[1])
    x, y = (v.astype(np.float64) for v in (x, y))
    x, y = (np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, keepdims=True))[1]).ravel() for v in (x, y))
    dot, xx, yy = (np.add.reduceat(v, edge) for v in (x * y, x * x, y * y))
    return dot / (np.sqrt(xx) * np.sqrt(yy))


def sketches(unit: np.ndarray, seed: int) -> np.ndarray:
    dim = unit.shape[1]
    axes = np.linalg.qr(np.random.default_rng([seed, dim, SKETCH]).standard_normal((dim, min(dim, SKETCH))))[0]
    out = np.zeros((len(unit), SKETCH), np.int8)
    out[:, : axes.shape[1]] = np.rint(127 * (unit @ axes))
    return out


def sketch_bound(cosine: float) -> float:
    """No two vectors of this cosine have sketches of a larger squared distance; rounding moves each by half a unit."""
    return (127 * math.sqrt(max(0.0, 2 - 2 * cosine)) + math.sqrt(SKETCH) + 1e-3) ** 2


def binary(rows: np.ndarray, bounds: np.ndarray | None = None) -> pa.Array:
    """An Arrow value of each row, or of the rows between bounds, without copies."""
    bounds = np.arange(len(rows) + 1) if bounds is None else bounds
    width = rows.itemsize * math.prod(rows.shape[1:])
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(
        pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * width).astype(np.int32)), pa.py_buffer(rows)]
    )


def _parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    bounds = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return bounds, np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)


def values(column: pa.Array) -> list[np.ndarray]:
    """The bytes of each value, as views."""
    bounds, data = _parts(column)
    return [data[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def fixed(column: pa.Array, kind: np.dtype) -> np.ndarray:
    """Values of one width."""
    bounds, data = _parts(column)
    return data[bounds[0] : bounds[-1]].view(kind.base).reshape(len(column), *kind.shape)


def long(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def by_length(batch: pa.RecordBatch, column: str = "embedding") -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """The rows of a batch by the length of their vectors, and these as a matrix."""
    dims = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(dims):
        rows = np.flatnonzero(dims == dim)
        part = batch if len(rows) == batch.num_rows else batch.take(pa.array(rows))
        yield part, part.column(column).flatten().to_numpy(zero_copy_only=False).reshape(-1, int(dim))


def _mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    x = x.view(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def _packed(grp: int, bucket: np.ndarray, rows: np.ndarray) -> pa.RecordBatch:
    """Rows that are in the order of their buckets, a value a bucket."""
    bounds = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1], True])
    cols = [pa.array(bucket[bounds[:-1]].astype(np.int32)), pa.array(np.full(len(bounds) - 1, grp)), binary(rows, bounds)]
    return pa.RecordBatch.from_arrays(cols, ["bucket", "grp", "payload"])


def _gathered(batches: Iterator[pa.RecordBatch], kind) -> Iterator[tuple[int, np.ndarray]]:
    held: dict[int, list[np.ndarray]] = defaultdict(list)
    for batch in batches:
        for grp, value in zip(batch.column("grp").to_pylist(), values(batch.column("payload")), strict=True):
            held[grp].append(value)
    while held:
        grp, parts = held.popitem()
        rows = np.concatenate(parts)
        del parts
        yield grp, rows.view(kind(grp))


def _ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, count of them, for each; one after the other."""
    ends = np.cumsum(count)
    return np.repeat(first - ends + count, count) + np.arange(ends[-1] if len(ends) else 0)


def _listed(start, size, homes, block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, home) of cells whose homes are their first rows, so many at a time."""
    rows, first, each = _ranges(start, size), np.repeat(start, size), np.repeat(homes, size)
    ends = np.cumsum(each)
    lo = 0
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - each[lo] + block, "right")))
        yield np.repeat(rows[lo:hi], each[lo:hi]), _ranges(first[lo:hi], each[lo:hi])
        lo = hi


def _cut(*sorted_by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the runs of equal rows."""
    new = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in sorted_by])]
    start = np.flatnonzero(new)
    return start, np.diff(np.r_[start, len(new)])


# ---- the first search


def deal_sketches(tables: int, which: list[int], probes: int, step: np.ndarray, buckets: int):
    """Each vector's sketch to all cells it asks, its own first."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, dims, sketch = long(batch.column("id")), long(batch.column("dim")), fixed(batch.column("sketch"), SLIM["sketch"])
            for dim in np.unique(dims):
                rows = np.flatnonzero(dims == dim)
                for t in which:
                    home, asked = home_and_asked(batch.column(f"asked_{t}"), probes, step)
                    keys = asked_keys(home[rows], asked[rows], step).ravel()
                    bucket = _mix(keys) % np.uint64(buckets)
                    order = np.argsort(bucket.astype(np.uint16 if buckets < 1 << 16 else np.uint64), kind="stable")
                    row = rows[order // (probes + 1)]
                    out = np.empty(len(order), SLIM)
                    out["key"], out["id"], out["slot"] = keys[order], ids[row], order % (probes + 1)
                    out["sketch"] = sketch[row]
                    yield _packed(int(dim) * tables + t, bucket[order], out)

    return run


def asked_keys(home: np.ndarray, asked: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Keys of the cells of each row, its own first."""
    return np.concatenate([home[..., None], home[..., None] + step[asked]], axis=-1)


def meet(bound: float):
    """Which rows have another's sketch within the bound in their cell, as a bit of their vector; and the cells that
    have so many of them that the pairs should be dealt to several tasks."""

    def run(batches):
        for grp, rows in _gathered(batches, lambda _: SLIM):
            rows, start, size, homes = _crowded(rows)
            if not len(rows):
                continue
            live = _live(rows, start, size, homes, bound)
            near = rows[live]
            own, all_ = (np.add.reduceat(x.astype(np.int64), start) for x in (live & (rows["slot"] == 0), live))
            large = np.flatnonzero(own * all_ > 2 * GRID**2)
            zero, none = np.zeros(len(near), np.int64), np.zeros(len(large), np.int64)
            cols = [
                np.concatenate([near["id"], rows["key"][start[large]]]), np.full(len(near) + len(large), grp),
                np.concatenate([np.int64(1) << near["slot"].astype(np.int64), none]),
                np.concatenate([zero, own[large]]), np.concatenate([zero, all_[large]]),
            ]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["id", "grp", "mask", "homes", "asks"])

    return run


def _crowded(rows: np.ndarray):
    """The rows of cells that are somebody's own and have other rows, by cell and own rows first; starts, sizes, own."""
    rows = rows[_visited(rows["key"], rows["slot"] == 0)]
    cells = np.unique(rows["key"][rows["slot"] == 0])
    none = np.empty(0, np.int64)
    if not len(cells):
        return rows[:0], none, none, none
    at = np.searchsorted(cells, rows["key"])
    at[at == len(cells)] = 0
    hit = cells[at] == rows["key"]
    hit &= np.bincount(at[hit], minlength=len(cells))[at] > 1
    rows, at = rows[hit], at[hit]
    if not len(rows):
        return rows, none, none, none
    order = np.lexsort((rows["slot"], at))
    rows, at = rows[order], at[order]
    start, size = _cut(at)
    return rows, start, size, np.add.reduceat((rows["slot"] == 0).astype(np.int64), start)


def _visited(key: np.ndarray, own: np.ndarray) -> np.ndarray:
    """Rows without most of those whose cell is nobody's own or has no other row, by 22 bits of the key."""
    at = (_mix(np.ascontiguousarray(key), 3) >> np.uint64(42)).astype(np.int64)
    homes, rows = np.flatnonzero(own), np.flatnonzero(~own)
    is_home, seen = np.zeros(1 << 22, bool), np.zeros(1 << 22, bool)
    place = np.sort(at[homes])
    is_home[place] = True
    seen[place[1:][place[1:] == place[:-1]]] = True
    rows = rows[is_home[at[rows]]]
    seen[at[rows]] = True
    return np.concatenate([homes[seen[at[homes]]], rows])


def _live(rows, start, size, homes, bound: float) -> np.ndarray:
    live = np.zeros(len(rows), bool)
    ids, sketch = np.ascontiguousarray(rows["id"]), np.ascontiguousarray(rows["sketch"]).astype(np.int16)
    small = homes * size <= LISTED
    for a, b in _listed(start[small], size[small], homes[small], 1 << 17):
        d = sketch[a] - sketch[b]
        near = (np.einsum("ij,ij->i", d, d, dtype=np.int32) <= bound) & (ids[a] != ids[b])
        live[a[near]] = live[b[near]] = True
    for c in np.flatnonzero(~small):
        cell = np.arange(start[c], start[c] + size[c])
        x = sketch[cell].astype(np.float32)  # sums are whole numbers below 2 ** 24
        square = (x * x).sum(axis=1)

        def test(h, a, at=start[c], x=x, square=square):
            if len(h) and len(a):
                d = square[h - at][:, None] + square[a - at] - 2 * (x[h - at] @ x[a - at].T)
                near = (d <= bound) & (ids[h][:, None] != ids[a])
                live[h[near.any(axis=1)]] = live[a[near.any(axis=0)]] = True

        # Only pairs of which one row is open are of use: in a group of near vectors the first homes settle all.
        for h in np.split(cell[: homes[c]], range(256, homes[c], 256)):
            for a in np.split(cell, range(4096, size[c], 4096)):
                settled = live[a]
                test(h, a[~settled])
                test(h[~live[h]], a[settled])
    return live


# ---- the second search


def _fat(grp: int, tables: int, probes: int, few: str, kind: str) -> np.dtype:
    dim, t = divmod(grp, tables)
    return np.dtype([
        ("key", "<i8"), ("sub", "<i4"), ("id", "<i8"), ("n", "<i8"), ("role", "u1"), ("home", "<i8", (t + 1,)),
        ("asked", few, (t + 1, probes)), ("vector", kind, (dim,)),
    ])


ASKS, OWNS = 1, 2  # roles of a row in its cell, or in its part of one


def deal_vectors(tables, which, probes, step, buckets, kind, large: dict, parts: int = 1, part: int = 0):
    """Vectors to the cells in which they can have partners, or to those of one part of all cells.

    A row of a large cell goes to a row and a column of a grid, where it is asked and asks.
    """
    few = narrow(step)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, vectors in by_length(batch):
                ids, n = long(rows.column("id")), long(rows.column("n"))
                all_ = [home_and_asked(rows.column(f"asked_{s}"), probes, step) for s in range(which[-1] + 1)]
                home, asked = (np.stack(x, axis=1) for x in zip(*all_, strict=True))
                for t in which:
                    grp = vectors.shape[1] * tables + t
                    mask = rows.column(f"mask_{t}").fill_null(0).to_numpy(zero_copy_only=False)
                    row, slot = np.nonzero(mask[:, None] >> np.arange(probes + 1) & 1)
                    key = asked_keys(home[:, t], asked[:, t], step)[row, slot]
                    if parts > 1:
                        mine = _mix(key, 1) % np.uint64(parts) == part
                        row, slot, key = row[mine], slot[mine], key[mine]
                    role = np.where(slot == 0, ASKS | OWNS, ASKS)
                    row, key, sub, role = _grid(row, key, role, ids, large.get(grp))
                    if not len(row):
                        continue
                    bucket = _mix(key + sub * 0x632BE5AB) % np.uint64(buckets)
                    order = np.argsort(bucket, kind="stable")
                    row = row[order]
                    out = np.empty(len(row), _fat(grp, tables, probes, few, kind))
                    out["key"], out["sub"], out["role"] = key[order], sub[order], role[order]
                    out["id"], out["n"], out["vector"] = ids[row], n[row], vectors[row]
                    out["home"], out["asked"] = home[row, : t + 1], asked[row, : t + 1]
                    yield _packed(grp, bucket[order], out)

    return run


def _grid(row, key, role, ids, large):
    """Copies of the rows of large cells for the parts of their grid; ``large``: keys in order, rows, columns."""
    sub = np.zeros(len(row), np.int64)
    if large is None or not len(row):
        return row, key, sub, role
    keys, high, wide = large
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    cut = keys[at] == key
    rest, x = np.flatnonzero(~cut), np.flatnonzero(cut)
    h, w = high[at[x]], wide[at[x]]
    place = _mix(ids[row[x]], 2)
    i, j = (place % h.astype(np.uint64)).astype(np.int64), (place // np.uint64(1 << 20) % w.astype(np.uint64)).astype(np.int64)
    owns = role[x] & OWNS
    ask, down = np.repeat(np.arange(len(x)), h), _ranges(np.zeros(len(x), np.int64), h)
    o = np.flatnonzero(owns)
    own, right = np.repeat(o, w[o]), _ranges(np.zeros(len(o), np.int64), w[o])
    own, right = own[right != j[own]], right[right != j[own]]
    pick = np.concatenate([rest, x[ask], x[own]])
    sub = np.concatenate([sub[rest], 1 + down * w[ask] + j[ask], 1 + i[own] * w[own] + right])
    role = np.concatenate([role[rest], np.where(down == i[ask], ASKS | owns[ask], ASKS), np.full(len(own), OWNS)])
    return row[pick], key[pick], sub, role


def link(tables, probes, step, kind, cosine: float, pairs: bool):
    """Near pairs of the cells: the pairs themselves, or for each row the vectors that the others stand for (``near``)
    and a forest that ties what the pairs tie."""

    few = narrow(step)

    def run(batches):
        for grp, rows in _gathered(batches, lambda grp: _fat(grp, tables, probes, few, kind)):
            found = _Links(rows, step, cosine, pairs)
            del rows
            yield from found.run()

    return run


class _Links:
    def __init__(self, rows: np.ndarray, step: np.ndarray, cosine: float, pairs: bool):
        rows = rows[np.lexsort((rows["role"] < OWNS, rows["sub"], rows["key"]))]
        self.ids, self.n, self.role = (np.ascontiguousarray(rows[c]) for c in ("id", "n", "role"))
        self.home = np.ascontiguousarray(rows["home"].T)
        self.asked = asked_keys(self.home, rows["asked"].transpose(1, 0, 2), step)
        self.vector, self.unit = rows["vector"], units(rows["vector"])
        self.start, self.size = _cut(rows["key"], rows["sub"])
        self.owns = np.add.reduceat((self.role >= OWNS).astype(np.int64), self.start)
        self.t = len(self.home) - 1
        self.cosine, self.pairs = cosine, pairs
        self.near = np.zeros(len(rows), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def run(self) -> Iterator[pa.RecordBatch]:
        small = self.owns * self.size <= LISTED
        for a, b in _listed(self.start[small], self.size[small], self.owns[small], 1 << 15):
            use = (self.role[a] & ASKS > 0) & (self.ids[a] != self.ids[b])
            a, b = a[use], b[use]
            self.take(*self.first(*self.close(np.einsum("ij,ij->i", self.unit[a], self.unit[b]), a, b)))
            yield from self.flush(HELD)
        for c in np.flatnonzero(~small & (self.owns > 0)):
            cell = np.arange(self.start[c], self.start[c] + self.size[c])
            for a, b in self.unproposed(cell[self.role[cell] & ASKS > 0], cell[: self.owns[c]]):
                if len(a) * len(b) <= LISTED:
                    self.few(a, b)
                    continue
                for some in np.split(a, range(1024, len(a), 1024)):
                    for home in np.split(b, range(1024, len(b), 1024)):
                        self.block(some, home)
                        yield from self.flush(HELD)
            self.settle()
        yield from self.flush(0)
        if not self.pairs:
            some = np.flatnonzero(self.near)
            yield self.out(self.ids[some], None, self.near[some])

    def unproposed(self, a: np.ndarray, b: np.ndarray, s: int = 0):
        """Rows and homes, by the homes' cells in the tables before where that leaves out most of the rows: those that
        asked the cell there."""
        while s < self.t and len(a) * len(b) > LISTED:
            cells, at, count = np.unique(self.home[s, b], return_inverse=True, return_counts=True)
            rest = ~self.member(self.asked[s, a], cells)
            if rest.sum(axis=0) @ count * 2 < len(a) * len(b):
                for k in np.flatnonzero(rest.any(axis=0)):
                    yield from self.unproposed(a[rest[:, k]], b[at == k], s + 1)
                return
            s += 1
        yield a, b

    @staticmethod
    def member(asked: np.ndarray, cells: np.ndarray) -> np.ndarray:
        out = np.zeros((len(asked), len(cells)), bool)
        at = np.searchsorted(cells, asked)
        at[at == len(cells)] = 0
        row, col = np.nonzero(cells[at] == asked)
        out[row, at[row, col]] = True
        return out

    def close(self, found: np.ndarray, a: np.ndarray, b: np.ndarray):
        """The pairs (a, b) whose cosines, found in any order of summing, reach the bound."""
        near = found >= self.cosine - EDGE
        found, a, b = found[near], a[near], b[near]
        edge = np.flatnonzero(found <= self.cosine + EDGE)
        if len(edge):
            found[edge] = cosines(self.vector[a[edge]], self.vector[b[edge]])
        near = found >= self.cosine
        return a[near], b[near]

    def first(self, a: np.ndarray, b: np.ndarray):
        """The pairs that no table before proposed, and not this one from the side of the smaller id."""
        for s in range(self.t):
            new = (self.asked[s, a] != self.home[s, b][:, None]).all(axis=1)
            new &= (self.asked[s, b] != self.home[s, a][:, None]).all(axis=1)
            a, b = a[new], b[new]
        new = (self.ids[a] < self.ids[b]) | (self.asked[self.t, b] != self.home[self.t, a][:, None]).all(axis=1)
        return a[new], b[new]

    def few(self, a: np.ndarray, b: np.ndarray) -> None:
        """Rows against homes, to be settled with others."""
        found = self.unit[a] @ self.unit[b].T
        x, y = np.nonzero(found >= self.cosine - EDGE)
        self.held.append((found[x, y], a[x], b[y]))
        self.waiting += len(x)
        if self.waiting > 1 << 16:
            self.settle()

    def settle(self) -> None:
        if self.waiting:
            found, a, b = (np.concatenate(x) for x in zip(*self.held, strict=True))
            use = self.ids[a] != self.ids[b]
            self.take(*self.first(*self.close(found[use], a[use], b[use])))
        self.held, self.waiting = [], 0

    def block(self, a: np.ndarray, b: np.ndarray) -> None:
        """Rows against homes, all pairs at once."""
        found = self.unit[a] @ self.unit[b].T
        near = found >= self.cosine - EDGE
        near &= self.ids[a][:, None] != self.ids[b]
        if np.count_nonzero(near) * 50 < near.size:
            x, y = np.nonzero(near)
            self.take(*self.first(*self.close(found[x, y], a[x], b[y])))
            return
        x, y = np.nonzero(near & (found <= self.cosine + EDGE))
        if len(x):
            near[x, y] = cosines(self.vector[a[x]], self.vector[b[y]]) >= self.cosine
        for s in range(self.t + 1):
            cells, at = np.unique(self.home[s, a], return_inverse=True)
            back = self.member(self.asked[s, b], cells)[:, at].T
            if s == self.t:
                near &= ~back | (self.ids[a][:, None] < self.ids[b])
                break
            cells, at = np.unique(self.home[s, b], return_inverse=True)
            near &= ~(back | self.member(self.asked[s, a], cells)[:, at])
        if self.pairs:
            x, y = np.nonzero(near)
            self.take(a[x], b[y])
            return
        self.near[a] += (near * self.n[b]).sum(axis=1)
        self.near[b] += (near.T * self.n[a]).sum(axis=1)
        self.stars(a, b, near)

    def stars(self, a: np.ndarray, b: np.ndarray, near: np.ndarray) -> None:
        """Edges that tie what a block's pairs tie; each of its rows and columns is looked at once or twice."""
        left = near.any(axis=1)
        while left.any():
            root = int(left.argmax())
            rows, cols = np.zeros(len(a), bool), np.zeros(len(b), bool)
            new = np.array([root])
            while len(new):
                rows[new] = True
                more = np.flatnonzero(near[new].any(axis=0) & ~cols)
                cols[more] = True
                new = np.flatnonzero(near[:, more].any(axis=1) & ~rows)
            left &= ~rows
            ends = np.concatenate([self.ids[a[rows]], self.ids[b[cols]]])
            self.edges.append((np.full(len(ends), self.ids[a[root]]), ends))

    def take(self, a: np.ndarray, b: np.ndarray) -> None:
        if len(a):
            self.edges.append((self.ids[a], self.ids[b]))
            if not self.pairs:
                np.add.at(self.near, a, self.n[b])
                np.add.at(self.near, b, self.n[a])

    def flush(self, least: int) -> Iterator[pa.RecordBatch]:
        if sum(len(x) for x, _ in self.edges) <= least:
            return
        a, b = (np.concatenate(x) for x in zip(*self.edges, strict=True))
        self.edges.clear()
        if self.pairs:
            yield self.out(np.minimum(a, b), np.maximum(a, b), None)
            return
        ids, low = _roots(a, b)
        far = ids != low
        yield self.out(ids[far], low[far], None)

    @staticmethod
    def out(a, b, near) -> pa.RecordBatch:
        cols = [pa.nulls(len(a), pa.int64()) if c is None else pa.array(c, pa.int64()) for c in (a, b, near)]
        return pa.RecordBatch.from_arrays(cols, ["a", "b", "near"])
