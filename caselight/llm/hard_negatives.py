"""Hard negatives by Four-Russians scoring of integer vectors.

Components become integers.  A candidate is packed once: for each group of eight dimensions and each bit of the
two's complement a byte holds that bit of the eight components.  An anchor has, for each group, the sums of all
256 subsets of its eight components.  The inner product is then a lookup by every byte, shifted by its bit and
added up, the highest bit with a minus: exact, whatever the signs.

Anchors are taken in blocks of a bounded number, each sent to all tasks; candidates are never moved.  A task
keeps the best few rows per anchor (and positive), so what is shuffled does not grow with the candidates.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.llm.common import bounded_batches, stage
from caselight.session import shared_dir

SCALE = 256
EVERY = 100  # anchors are the vec_ids divisible by it
POSITIVES, NEGATIVES = 5, 10
LOW, HIGH = 30, 90  # a negative's score in hundredths of the positive's
ANCHORS = 2_048  # anchors of a block, sent to every task
CHUNK = 32  # anchors whose tables are looked up at a time
PART = 2_048  # candidates that are looked up at a time
WIDE = 1 << 24  # components beyond it are multiplied as Python integers
LONG = (1 << 63) - 1
MOST = 10**38 - 1  # products beyond it count as it

_CAND = "row long, vec_id long, label int, dim int, bits int, packed binary, big array<string>"


def integer_rows(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """``(row, vec_id, label, embedding)`` of the rows that take part, with a number of their own, written once.

    Rows with a null label, a null vector or a null or non-finite component take no part.  A vec_id divisible by 7
    moves the label on by one, modulo 10.
    """
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = F.col("label").isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(True))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = vectors.where(good).select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        moved.cast("int").alias("label"),
        v.cast("array<double>").alias("embedding"),
    )
    return stage(bounded_batches(rows).mapInArrow(_pack(scale), _CAND), "planes")


def _pack(scale: int):
    """Vectors as bit planes: bytes (group, bit) of 8 components each, or decimal text of very large components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            dims = lists.value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(len(at), dim)
                with np.errstate(over="ignore"):
                    x = np.floor(x * float(scale))
                wide = (np.abs(x) >= WIDE).any(axis=1) if dim else np.zeros(len(at), bool)
                packed, big = [b""] * len(at), [None] * len(at)
                small = np.flatnonzero(~wide)
                whole = np.zeros((len(small), -(-dim // 8) * 8), np.int32)
                whole[:, :dim] = x[small]
                bits = bit_width(whole)
                for i, code in zip(small.tolist(), planes(whole, bits), strict=True):
                    packed[i] = code.tobytes()
                for i in np.flatnonzero(wide).tolist():
                    parts = lists[int(at[i])].as_py()
                    big[i] = [str(floor_times(p, scale)) for p in parts]
                cols = [batch.column(c).take(pa.array(at)) for c in range(3)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *cols, pa.array(np.full(len(at), dim, np.int32)), pa.array(np.full(len(at), bits, np.int32)),
                        pa.array(packed, pa.binary()), pa.array(big, pa.list_(pa.string())),
                    ],
                    ["row", "vec_id", "label", "dim", "bits", "packed", "big"],
                )

    return run


def floor_times(x: float, scale: int) -> int:
    """``floor(scale * x)`` of a double without loss, also where the product is no double."""
    up, down = x.as_integer_ratio()
    return up * scale // down


def bit_width(whole: np.ndarray) -> int:
    """Bits of the two's complement that hold every component."""
    if not whole.size:
        return 1
    return max(int(whole.max()).bit_length(), int(~whole.min()).bit_length() if whole.min() < 0 else 0) + 1


def planes(whole: np.ndarray, bits: int) -> np.ndarray:
    """Bytes ``[row, group, bit]``; bit j of a byte is that bit of the group's component j."""
    n, width = whole.shape
    out = np.empty((n, width // 8, bits), np.uint8)
    for b in range(bits):
        out[:, :, b] = np.packbits((whole >> b & 1).astype(np.uint8).reshape(n, width // 8, 8), axis=2, bitorder="little")[:, :, 0]
    return out


def unpack(packed: bytes, groups: int, bits: int) -> np.ndarray:
    """Components behind the bytes of :func:`planes`."""
    code = np.frombuffer(packed, np.uint8).reshape(groups, bits)
    bit = np.unpackbits(code, axis=0, bitorder="little").reshape(groups, 8, bits).astype(np.int64)
    weight = np.array([1 << b for b in range(bits)], np.int64)
    weight[-1] = -weight[-1]
    return (bit * weight).sum(axis=2).ravel()


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """``[anchor, group, 256]``: sums of the components that the bits of 0..255 name, each from one of fewer bits."""
    n, width = anchors.shape
    table = np.zeros((n, width // 8, 256), np.int64)
    part = anchors.reshape(n, width // 8, 8)
    for j in range(8):
        table[:, :, 1 << j : 2 << j] = table[:, :, : 1 << j] + part[:, :, j : j + 1]
    return table


def scores(tables: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Inner products ``[anchor, candidate]``: table lookups by every byte, shifted and added."""
    n, groups, bits = codes.shape
    out = np.zeros((len(tables), n), np.int64)
    # Components below 2**24 in both leave every sum of up to 2**14 of them within 64 bits.
    for b in range(bits - 1, -1, -1):
        part = np.zeros_like(out)
        for g in range(groups):
            part += tables[:, g].take(codes[:, g, b], axis=1)
        out = (out << 1) + (-part if b == bits - 1 else part)
    return out


class Block:
    """Anchors of one block, by number of components."""

    def __init__(self, rows: list, bands: dict[int, list[tuple[int, int, int, int]]] | None):
        self.anchors = [
            (r["row"], r["label"], r["dim"], r["bits"], r["packed"], None if r["big"] is None else [int(x) for x in r["big"]])
            for r in rows
        ]
        self.bands = bands

    def by_dim(self) -> dict[int, list]:
        out: dict[int, list] = {}
        for a in self.anchors:
            out.setdefault(a[2], []).append(a)
        return out


def exact(anchor: tuple, packed: bytes, bits: int, big: list[int] | None) -> int:
    """Inner product with a very large component in one of the two, in Python integers."""
    groups = -(-anchor[2] // 8)
    left = anchor[5] if anchor[5] is not None else unpack(anchor[4], groups, anchor[3]).tolist()
    right = big if big is not None else unpack(packed, groups, bits).tolist()
    return max(-MOST, min(MOST, sum(a * b for a, b in zip(left, right, strict=False))))


class Best:
    """The first ``k`` of (score, vec_id, row, label) seen, higher scores first, then smaller ids, nulls last."""

    __slots__ = ("k", "rows", "floor")

    def __init__(self, k: int):
        self.k, self.rows, self.floor = k, [], None

    def add(self, found: list[tuple]) -> None:
        self.rows = sorted([*self.rows, *found])[: self.k]
        if len(self.rows) == self.k:
            self.floor = -self.rows[-1][0]


def _ranked(score: int, vec_id: int | None, row: int) -> tuple:
    return -score, vec_id is None, vec_id or 0, row


def _search(block: Block, k: int, alike: bool):
    """Best ``k`` rows of a task for each anchor (of its label, ``alike``) or for each of its positives' bands."""

    def wants(anchor: tuple) -> list[tuple]:
        if alike:
            return [(None, None, None)]
        return block.bands.get(anchor[0], [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple, Best] = {}
        groups, whole = {}, {}
        for dim, anchors in block.by_dim().items():
            groups[dim] = ([a for a in anchors if a[5] is None], None, [a for a in anchors if a[5] is not None])
            whole |= {a[0]: unpack(a[4], -(-dim // 8), a[3]) for a in groups[dim][0]}

        def compare(part: pa.RecordBatch, bits: int, dim: int, small: list, large: list) -> None:
            ids, packed, big = (part.column(c).to_pylist() for c in (1, 5, 6))
            rows, labels = part.column(0).to_numpy(), part.column(2).to_numpy()
            plain = [i for i, x in enumerate(big) if x is None]
            odd = [i for i, x in enumerate(big) if x is not None]
            codes = np.frombuffer(b"".join(packed[i] for i in plain), np.uint8).reshape(len(plain), -(-dim // 8), bits)
            for c in range(0, len(small) if plain else 0, CHUNK):
                some = small[c : c + CHUNK]
                found = scores(subset_sums(np.array([whole[a[0]] for a in some])), codes)
                for anchor, own in zip(some, found, strict=True):
                    offer(anchor, own, [ids[i] for i in plain] if odd else ids, rows[plain], labels[plain])
            for anchors, spots in ((small, odd), (large, list(range(len(ids))))):
                for anchor in anchors if spots else []:
                    own = np.empty(len(spots), object)
                    own[:] = [exact(anchor, packed[i], bits, big[i] and [int(x) for x in big[i]]) for i in spots]
                    offer(anchor, own, [ids[i] for i in spots], rows[spots], labels[spots])

        def offer(anchor: tuple, row_scores, ids: list, rows: np.ndarray, labels: np.ndarray) -> None:
            right = (labels == anchor[1]) & (rows != anchor[0]) if alike else labels != anchor[1]
            for want in wants(anchor):
                best = kept.get((anchor[0], want[0]))
                take = right
                if want[1] is not None:
                    take = take & (row_scores >= want[1]) & (row_scores <= want[2])
                if best is not None and best.floor is not None:
                    take = take & (row_scores >= best.floor)
                hit = np.flatnonzero(take)
                if not len(hit):
                    continue
                if best is None:
                    best = kept[anchor[0], want[0]] = Best(k)
                if len(hit) > 4 * k:  # ties of the k-th stay in
                    own = row_scores[hit]
                    hit = hit[own >= np.partition(own, len(own) - k)[len(own) - k]]
                best.add([_ranked(int(row_scores[i]), ids[i], int(rows[i])) for i in hit.tolist()])

        for batch in batches:
            dims, widths, of_label = (batch.column(c).to_numpy() for c in (3, 4, 2))
            for dim in np.unique(dims).tolist():
                if dim not in groups:
                    continue
                # Positives are looked for among rows of the anchor's label alone.
                for label in np.unique(of_label).tolist() if alike else [None]:
                    near = [[a for a in group if label in (None, a[1])] for group in (groups[dim][0], groups[dim][2])]
                    if not any(near):
                        continue
                    same = (dims == dim) & (True if label is None else of_label == label)
                    for bits in np.unique(widths[same]).tolist():
                        at = np.flatnonzero(same & (widths == bits))
                        for lo in range(0, len(at), PART):
                            compare(batch.take(pa.array(at[lo : lo + PART])), bits, dim, *near)
        out = [
            (anchor, positive, row, None if none else vec_id, str(-minus))
            for (anchor, positive), best in kept.items()
            for minus, none, vec_id, row in best.rows
        ]
        for lo in range(0, len(out), 8_192):
            cols = zip(*out[lo : lo + 8_192], strict=True)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["anchor", "positive", "row", "vec_id", "score"]
            )

    return run


_MINED = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
_FOUND = "anchor long, positive long, row long, vec_id long, score string"


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The best ``k`` over all tasks, with their rank."""
    score = F.col("score").cast("decimal(38,0)")
    order = [score.desc_nulls_last(), F.col("vec_id").asc_nulls_last(), "row"]
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)


def _as_long(score: Column) -> Column:
    wide = score.cast("decimal(38,0)")
    return F.least(F.greatest(wide, F.lit(-LONG - 1).cast("decimal(38,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("long")


def mine(
    vectors: DataFrame, every: int = EVERY, positives: int = POSITIVES, negatives: int = NEGATIVES,
    low: int = LOW, high: int = HIGH, scale: int = SCALE, anchors: int = ANCHORS,
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)``.

    Vectors are compared with those of as many components only.  Rows that repeat a vec_id are rows of their own:
    each is an anchor, each may be another's positive or negative.  A row without vec_id is no anchor and comes
    last among equal scores.  Empty vectors score 0 with one another.  Products are exact up to 38
    digits, and what is longer counts as 38 nines; a score that no long holds is returned as the nearest long.
    """
    rows = integer_rows(vectors, scale)
    spark = rows.sparkSession
    chosen = stage(rows.where(F.col("vec_id") % every == 0), "anchors")
    blocks = -(-chosen.count() // anchors)
    folder = f"{shared_dir(spark)}/negatives-{uuid.uuid4().hex}"
    spark.createDataFrame([], _MINED).write.parquet(folder)
    for block in range(blocks):
        # Hashed shares of about `anchors` rows each; a block passes the driver, the set of anchors never does.
        own = chosen.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).collect()
        alike = rows.mapInArrow(_search(Block(own, None), positives, True), _FOUND)
        liked = _first(alike, ["anchor"], positives).select("anchor", "row", "vec_id", "score").collect()
        bands: dict[int, list] = {}
        for r in liked:
            p = int(r.score)
            bands.setdefault(r.anchor, []).append((r.row, -(-low * p // 100), high * p // 100))
        unlike = rows.mapInArrow(_search(Block(own, bands), negatives, False), _FOUND)
        first = _first(unlike, ["anchor", "positive"], negatives)
        anchor_ids = spark.createDataFrame([(r.row, r.vec_id) for r in own], "anchor long, anchor_id long")
        pairs = spark.createDataFrame(
            [(r.anchor, r.row, r.vec_id, r.score) for r in liked],
            "anchor long, positive long, positive_id long, positive_score string",
        )
        named = first.join(F.broadcast(pairs), ["anchor", "positive"]).join(F.broadcast(anchor_ids), "anchor")
        named.select(
            "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"),
            _as_long(F.col("positive_score")).alias("positive_score"), _as_long(F.col("score")).alias("negative_score"),
        ).write.mode("append").parquet(folder)
    return spark.read.schema(_MINED).parquet(folder)
