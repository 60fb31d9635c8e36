"""Connected components of a large graph by alternating large-star and small-star rounds.

Every round is two grouped minima, so no neighbourhood is ever gathered and a vertex with very many edges is
combined map-side.  Rounds grow with the logarithm of the longest path.  Each round is written to the shared
folder, which cuts the lineage and survives lost executors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import stage

FOREST_ROWS = 1_000_000


def _roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vertices of an edge list and the smallest vertex each one reaches."""
    ids, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            return ids, ids[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a task, in bounded blocks, by stars around their smallest vertices."""
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        ids, low = _roots(*(np.concatenate(x) for x in zip(*held, strict=True)))
        held.clear()
        far = ids != low
        return pa.RecordBatch.from_arrays([pa.array(ids[far]), pa.array(low[far])], ["u", "v"])

    for batch in batches:
        held.append(tuple(batch.column(i).to_numpy(zero_copy_only=False) for i in range(2)))
        if sum(len(x) for x, _ in held) >= FOREST_ROWS:
            yield flush()
    if held:
        yield flush()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for every vertex of ``edges(a, b)``; the component is its smallest vertex.

    Self loops and repeated edges do no harm, rows with a null end are ignored, no edges give no rows.
    """
    found = edges.select(F.col("a").cast("long").alias("u"), F.col("b").cast("long").alias("v"))
    found = found.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    forest = stage(found.mapInArrow(_contract, "u long, v long"), "forest")
    while True:
        # Large star: the larger neighbours of a vertex move to the least vertex around it.
        both = forest.unionByName(forest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stage(
            both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least"
        )
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(moved.distinct(), "large")
        # Small star: a vertex and its smaller neighbours move to the least of them.
        low = stage(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low, "u")
            .where("v <> m")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(low.select("u", F.col("m").alias("v")))
            .distinct()
        )
        small = stage(small, "small")
        # A forest of stars: every vertex has one edge, and its end is no vertex itself.
        many = small.groupBy("u").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        chained = small.join(small.select(F.col("u").alias("v")), "v", "left_semi")
        if many.isEmpty() and chained.isEmpty():
            roots = small.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return small.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        forest = stage(small.mapInArrow(_contract, "u long, v long"), "forest")
