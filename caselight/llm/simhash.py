"""Near-duplicate groups by SimHash, found through a segment-popcount embedding.

A fingerprint becomes a point: the number of set bits in each of its segments.  Differing in d bits moves the
point by a Manhattan distance of d at most, so all fingerprints within ``BITS`` bits of one lie in the grid
cells within that distance.  A range join over the cells proposes pairs and the differing bits decide.

Only different fingerprints take part, equal ones being one point.  The number of segments follows from the
number of fingerprints: more segments mean more cells to ask and fewer wrong proposals, and both stay balanced.
Cells that hold very many fingerprints would propose the square of their number.  Fingerprints in or near
such a cell are linked instead through the values within one bit of them: two fingerprints are within two bits
exactly when they share such a value, and 65 values a fingerprint do for a group of any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.llm.common import as_bytes, bounded_batches, stage
from caselight.llm.components import connected_components

SHINGLE = 3
BITS = 2
SEED = 42
DENSE_CELL = 256  # fingerprints of a cell above which pairs are not proposed from it


def fingerprint_bits(text: bytes | None, shingle: int = SHINGLE) -> int:
    """A bit is set when it is set in more than half of the shingles' hashes; without words it is zero."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    if len(found) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(found), SEED)
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    first = [0, *ends[:-shingle].tolist()]
    last = (ends[shingle - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
    total = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        total += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprint(text: str = "text", shingle: int = SHINGLE) -> Column:
    """Fingerprint of a text column as a signed 64-bit number."""

    @F.arrow_udf("long")
    def make(texts: pa.Array) -> pa.Array:
        found = np.array([fingerprint_bits(t, shingle) for t in as_bytes(texts)], np.uint64)
        return pa.array(found.view(np.int64))

    return make(F.col(text))


def segments_for(n: int) -> int:
    """Segments at which the cells asked and the wrong proposals expected of a fingerprint are closest.

    Two random segments of 8, 4 or 2 bits have the same count with probability 0.196, 0.273 and 0.375.
    """
    cells = {8: 145, 16: 545, 32: 2113}
    same = {8: 0.196**8, 16: 0.273**16, 32: 0.375**32}
    return min(cells, key=lambda m: cells[m] + n * same[m] * cells[m])


def _moves(segments: int, bits: int) -> list[list[int]]:
    """Steps to the cells within a Manhattan distance of ``bits``, one of each opposite pair, and no step."""
    out = {(0,) * segments}
    for _ in range(bits):
        out |= {(*m[:i], m[i] + d, *m[i + 1 :]) for m in out for i in range(segments) for d in (-1, 1)}
    return sorted(m for m in out if m >= (0,) * segments)


def _cells(segments: int, bits: int):
    """(print, cell, home): a fingerprint's own cell, and the cells it asks besides."""
    width = 64 // segments
    moves = np.array(_moves(segments, bits), np.int64)
    weight = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(segments)], np.uint64)

    def run(batches):
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False)
            for part in np.array_split(prints, len(prints) * len(moves) // 500_000 + 1):
                if not len(part):
                    continue
                set_bits = np.unpackbits(part.view(np.uint64).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
                point = set_bits.reshape(len(part), segments, width).sum(axis=2, dtype=np.int64)
                asked = point[:, None, :] + moves[None]
                fits = ((asked >= 0) & (asked <= width)).all(axis=2)
                cell = (asked.astype(np.uint64) * weight).sum(axis=2, dtype=np.uint64).view(np.int64)
                home = np.broadcast_to((moves == 0).all(axis=1), fits.shape)
                out = np.broadcast_to(part[:, None], fits.shape)
                cols = [pa.array(x[fits]) for x in (out, cell, home)]
                yield pa.RecordBatch.from_arrays(cols, ["print", "cell", "home"])

    return run


def near_prints(prints: DataFrame, bits: int = BITS, dense: int = DENSE_CELL, segments: int | None = None) -> DataFrame:
    """Links ``(a, b)`` between nodes that give the components of "within ``bits`` bits".

    ``prints`` holds different fingerprints as (print, node).  The links are those within the bound, save that
    around dense cells, they are chains through shared values instead of all pairs.
    """
    if bits != BITS:
        raise ValueError("the way around dense cells is made for two bits")
    segments = segments or segments_for(prints.count())
    points = stage(prints.select("print").mapInArrow(_cells(segments, bits), "print long, cell long, home boolean"), "cells")
    dense_cells = stage(
        points.where("home").groupBy("cell").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > dense).select("cell"),
        "dense",
    )
    asking = points.join(dense_cells, "cell", "left_anti")
    homes = asking.where("home").select("cell", F.col("print").alias("other"))
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("other")))
    near = (
        asking.join(homes, "cell")
        .where((F.col("print") != F.col("other")) & (apart <= bits))
        .select(F.least("print", "other").alias("print"), F.greatest("print", "other").alias("other"))
        .distinct()
    )
    # All that lie in a dense cell or ask one.  What a dense cell asks of other cells was proposed above.
    crowd = points.join(dense_cells, "cell", "left_semi").select("print").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")), F.transform(F.sequence(F.lit(0), F.lit(63)), _one_bit))
    values = crowd.select("print", F.explode(flips).alias("flip")).select(
        "print", F.col("print").bitwiseXOR(F.col("flip")).alias("value")
    )
    hubs = values.groupBy("value").agg(F.min("print").alias("other"), F.count(F.lit(1)).alias("n")).where("n > 1")
    chains = values.join(hubs, "value").where("print <> other").select("print", "other")
    found = near.unionByName(chains)
    left, right = prints.select("print", F.col("node").alias("a")), prints.select(
        F.col("print").alias("other"), F.col("node").alias("b")
    )
    return found.join(left, "print").join(right, "other").select("a", "b")


def _one_bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i)


def groups(
    docs: DataFrame, shingle: int = SHINGLE, bits: int = BITS, dense: int = DENSE_CELL, segments: int | None = None
) -> DataFrame:
    """``(doc_id, print, component_id)`` per row of ``docs``.

    Texts without words (null, empty, blank) have fingerprint zero and link like any other.  Rows that share a
    doc_id are one vertex each fingerprint.  A row without doc_id joins no group; its component is null.
    """
    made = stage(bounded_batches(docs).select("doc_id", fingerprint("text", shingle).alias("print")), "prints")
    prints = stage(
        made.where("doc_id IS NOT NULL").groupBy("print").agg(F.min(F.col("doc_id").cast("long")).alias("node")), "nodes"
    )
    by_id = made.where("doc_id IS NOT NULL").join(prints, "print").select(F.col("doc_id").cast("long").alias("b"), F.col("node").alias("a"))
    repeated = by_id.groupBy("b").agg(F.min("a").alias("a"), F.max("a").alias("last")).where("a <> last")
    same_id = by_id.join(repeated.select("b"), "b", "left_semi").select("a", "b")
    links = near_prints(prints, bits, dense, segments).unionByName(same_id)
    found = connected_components(links)
    root = prints.join(found.withColumnRenamed("component", "root"), prints.node == found.node, "left").select(
        "print", F.coalesce("root", prints.node).alias("root")
    )
    joined = made.join(root, "print", "left")
    return joined.select(
        "doc_id", "print", F.when(F.col("doc_id").isNotNull(), F.col("root")).alias("component_id")
    )


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one row of each group, that of the smallest doc_id; rows without doc_id stay.

    Where several texts share that doc_id, one row of each text stays.
    """
    found = groups(docs, **how)
    heads = found.where("doc_id = component_id").select(F.col("doc_id").alias("__head")).distinct()
    named = docs.join(heads, F.col("doc_id") == F.col("__head"), "left_semi")
    first = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy(F.lit(1))
    named = named.withColumn("__first", F.row_number().over(first)).where("__first = 1").drop("__first")
    return named.unionByName(docs.where("doc_id IS NULL"))
