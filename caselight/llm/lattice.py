"""Near-duplicate embeddings by lattice hashing.

In each of several tables a unit vector is projected to eight random directions, scaled, and decoded to the
nearest point of the E8 lattice; vectors of one lattice point share a cell.  A vector also asks the
neighbouring points that its projection leans to most.  Proposed pairs are compared by cosine in double
precision, where they meet (``cells``).  Equal vectors are one class, so a group of copies is one vertex whatever
its size.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caselight.llm import cells
from caselight.llm.common import bounded_batches, drop_stage, partitions, stage
from caselight.llm.components import connected_components

COSINE = 0.95
TABLES = 8
PROBES = 12  # neighbouring lattice points asked in each table, of 240
# Lattice units per standard deviation of a projected unit vector, by lattice points that make a cell.
SCALES = {1: 1.1, 2: 0.65, 3: 0.5}
SEED = 20
# Bytes of packed rows: of several tables that take a turn together, and of those a task searches.
TURN_BYTES = 128 << 20
BUCKET_BYTES = 16 << 20
SLICED = 100_000  # vectors above which those with a partner are joined in slices


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 point of each row: the nearer of the best integer and the best half-integer point.

    Both kinds have coordinates of an even sum; where rounding gives an odd sum, the coordinate that was
    rounded farthest goes the other way.
    """

    def even(y: np.ndarray) -> np.ndarray:
        near = np.rint(y)
        off = y - near
        worst = np.abs(off).argmax(axis=1)
        rows = np.flatnonzero(near.sum(axis=1) % 2 != 0)
        step = np.where(off[rows, worst[rows]] >= 0, 1.0, -1.0)
        near[rows, worst[rows]] += step
        return near

    whole, half = even(x), even(x - 0.5) + 0.5
    closer = ((x - half) ** 2).sum(axis=1) < ((x - whole) ** 2).sum(axis=1)
    return np.where(closer[:, None], half, whole)


def e8_neighbours() -> np.ndarray:
    """The 240 shortest E8 vectors: two coordinates of +-1, or all of +-1/2 with an even number of minuses."""
    out = []
    for i in range(8):
        for j in range(i):
            for a in (-1.0, 1.0):
                for b in (-1.0, 1.0):
                    v = np.zeros(8)
                    v[i], v[j] = a, b
                    out.append(v)
    for code in range(256):
        signs = np.array([1.0 if code >> i & 1 else -1.0 for i in range(8)])
        if signs.prod() > 0:
            out.append(signs / 2)
    return np.array(out)


def projections(dim: int, tables: int, lattices: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, dim]).standard_normal((tables, lattices, dim, 8))


def lattices_for(n: int) -> int:
    """Lattice points that make a cell: one more whenever cells of random vectors would hold over ten."""
    out = 1
    while n / 8.0e4**out > 10:
        out += 1
    return out


def _sign(tables: int, lattices: int, probes: int, scale: float, seed: int):
    """A sketch of each vector, and for each table the key of its cell and which neighbouring cells it asks."""
    around = e8_neighbours()
    step = cells.neighbour_keys(around, lattices)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            for rows, vectors in cells.by_length(batch):
                dim = vectors.shape[1]
                unit = cells.units(vectors)
                sides = projections(dim, tables, lattices, seed)
                asked = []
                for t in range(tables):
                    at = [scale * unit @ sides[t, k] for k in range(lattices)]
                    point = [nearest_e8(x) for x in at]
                    # A neighbour is the nearer, the more the offset leans to it; all are equally long.
                    lean = np.concatenate([(p - x) @ around.T for x, p in zip(at, point, strict=True)], axis=1)
                    best = np.argpartition(lean, probes - 1, axis=1)[:, :probes] if probes else lean[:, :0]
                    asked.append(cells.asked_column(cells.point_keys(np.concatenate(point, axis=1)), best, step))
                sketch = cells.binary(cells.sketches(unit, seed))
                dims = pa.array(np.full(len(unit), dim, np.int32))
                yield pa.RecordBatch.from_arrays(
                    [*rows.select(["id", "n", "embedding"]).columns, dims, sketch, *asked], _signed_names(tables)
                )

    return run


def _signed_names(tables: int) -> list[str]:
    return ["id", "n", "embedding", "dim", "sketch", *(f"asked_{t}" for t in range(tables))]


def usable(vector: str = "embedding"):
    """Whether a vector has a direction: not null or empty, all components finite, not all zero."""
    v = F.col(vector)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & (F.size(v) > 0) & ~F.coalesce(bad, F.lit(True)) & F.exists(v, lambda x: x != 0)


def classes(vectors: DataFrame) -> DataFrame:
    """``(id, embedding, vec_id, n)``: the different usable vectors, their smallest vec_id and their count.

    ``id`` tells them apart where a vec_id names several vectors; the result is written, so it does not change.
    """
    good = vectors.where(F.coalesce(usable(), F.lit(False)) & F.col("vec_id").isNotNull())
    found = good.groupBy("embedding").agg(
        F.min(F.col("vec_id").cast("long")).alias("vec_id"), F.count(F.lit(1)).alias("n")
    )
    return stage(found.withColumn("id", F.monotonically_increasing_id()), "kinds")


def near_pairs(
    kinds: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES,
    lattices: int | None = None, seed: int = SEED,
) -> DataFrame:
    """``(a, b)``, a < b: pairs of different vectors (by ``id``) found with at least this cosine."""
    return _near(_signed(kinds, tables, probes, lattices, seed), cosine, tables, probes, True).select("a", "b")


def near_links(
    kinds: DataFrame, cosine: float = COSINE, tables: int = TABLES, probes: int = PROBES,
    lattices: int | None = None, seed: int = SEED,
) -> DataFrame:
    """``(a, b, near)``: what :func:`near_pairs` finds, without a row for each pair.

    Rows with ``near`` add up to the number of vectors, copies included, near ``a``; the others tie ``a`` to ``b``
    so that the same are tied as by the pairs.  The staged ``kinds`` are deleted on the way.
    """
    signed = _signed(kinds, tables, probes, lattices, seed)
    drop_stage(kinds)
    return _near(signed, cosine, tables, probes, False)


def _signed(kinds: DataFrame, tables: int, probes: int, lattices: int | None, seed: int) -> tuple:
    """The staged vectors with their cells, their number, that of their components, the lattice points of a cell."""
    if probes > 62:
        raise ValueError("a row's cells are the bits of a long: ask 62 neighbours at most")
    total, held = kinds.agg(F.count(F.lit(1)), F.sum(F.size("embedding").cast("long"))).first()
    lattices = lattices or lattices_for(total)
    scale = SCALES[min(lattices, max(SCALES))]
    n = F.col("n") if "n" in kinds.columns else F.lit(1).cast("long").alias("n")
    rows = bounded_batches(kinds.select("id", n, "embedding"))
    types = [*(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema), "dim int"]
    types += [f"{c} binary" for c in _signed_names(tables)[4:]]
    signed = rows.mapInArrow(_sign(tables, lattices, probes, scale, seed), ", ".join(types))
    return stage(signed, "signed"), total, held or 0, lattices


def _near(signed: tuple, cosine: float, tables: int, probes: int, pairs: bool) -> DataFrame:
    """The links of all tables.  Shuffles take turns, a few tables or a part of one at a time, as every vector is
    sent to thirteen cells of each table: together they would hold many times the input on disk."""
    signed, total, held, lattices = signed
    spark = signed.sparkSession
    step = cells.neighbour_keys(e8_neighbours(), lattices)
    masks = [f"mask_{t}" for t in range(tables)]
    sizes = [total * (probes + 1) * cells.SLIM.itemsize] * tables
    live = []
    for which in _turns(sizes, TURN_BYTES):
        columns = ["id", "dim", "sketch", *(f"asked_{t}" for t in which)]
        buckets = _buckets(spark, sum(sizes[t] for t in which))
        deal = cells.deal_sketches(tables, which, probes, step, buckets)
        met = _deal(signed.select(columns), deal, buckets).mapInArrow(cells.meet(cells.sketch_bound(cosine)), cells.MET)
        # Rows of vectors, and those of large cells, which have no mask.
        found = met.groupBy("id", "grp", (F.col("mask") == 0).alias("large")).agg(
            F.bit_or("mask").alias("mask"), F.max("homes").alias("homes"), F.max("asks").alias("asks")
        )
        live.append(stage(found, "live"))
    met = reduce(DataFrame.unionByName, live)
    large: dict[int, list] = {}
    for r in met.where("large").collect():
        large.setdefault(r.grp, []).append((r.id, -(-r.homes // cells.GRID), -(-r.asks // cells.GRID)))
    large = {g: tuple(np.array(sorted(x), np.int64).T) for g, x in large.items()}
    by_table = [F.bit_or(F.when(F.col("grp") % tables == t, F.col("mask"))).alias(m) for t, m in enumerate(masks)]
    own = stage(met.where("NOT large").groupBy("id").agg(*by_table), "masks")
    for done in live:
        drop_stage(done)
    # The vectors that can have a partner; a join of all at once would hold them three times.
    slices = 2 + 2 * own.count() // total if total > SLICED else 1
    rows = []
    for i in range(slices):
        here = F.pmod(F.xxhash64("id"), F.lit(slices)) == i
        rows.append(stage(signed.drop("sketch").where(here).join(own.where(here), "id"), "active"))
    active = reduce(DataFrame.unionByName, rows)
    drop_stage(signed)
    drop_stage(own)

    kind, width = ("<f4", 4) if signed.schema["embedding"].dataType.elementType.typeName() == "float" else ("<f8", 8)
    each = [F.bit_count(m) * (29 + (t + 1) * (8 + 2 * probes) + width * F.col("dim")) for t, m in enumerate(masks)]
    sizes = [s or 0 for s in active.agg(*(F.sum(x) for x in each)).first()]
    most = max(TURN_BYTES, width * held)
    out = []
    for which in _turns(sizes, most):
        size = sum(sizes[t] for t in which)
        parts = max(1, -(-size // most))
        columns = ["id", "n", "embedding", *(f"asked_{t}" for t in range(which[-1] + 1))]
        some = active.select(*columns, *(masks[t] for t in which))
        if len(which) < tables:
            some = some.where(" OR ".join(f"{masks[t]} <> 0" for t in which))
        buckets = _buckets(spark, size // parts)
        for part in range(parts):
            deal = cells.deal_vectors(tables, which, probes, step, buckets, kind, large, parts, part)
            task = cells.link(tables, probes, step, kind, cosine, pairs)
            out.append(stage(_deal(some, deal, buckets).mapInArrow(task, cells.LINKS), "links"))
    for done in rows:
        drop_stage(done)
    return reduce(DataFrame.unionByName, out)


def _deal(df: DataFrame, deal, buckets: int) -> DataFrame:
    dealt = bounded_batches(df).mapInArrow(deal, cells.DEALT).repartitionById(buckets, "bucket")
    return dealt.select("grp", "payload")


def _buckets(spark: SparkSession, size: int) -> int:
    return max(partitions(spark), -(-size // BUCKET_BYTES))


def _turns(sizes: list[int], most: int) -> list[list[int]]:
    """Tables in order, together as long as their sizes stay within the bound."""
    out, held = [], 0
    for t, size in enumerate(sizes):
        if not out or held + size > most:
            out.append([])
            held = 0
        out[-1].append(t)
        held += size
    return out


def _digest():
    return F.xxhash64("embedding")


def _named(rows: DataFrame, kinds: DataFrame, heads: DataFrame) -> DataFrame:
    """``(vec_id, id, n)``: the vector of each row.  Where no other vector has its hash, vectors need not travel."""
    shared = stage(heads.groupBy("digest").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1").select("digest"), "shared")
    rows = rows.withColumn("digest", _digest())
    if shared.isEmpty():
        return stage(rows.select("vec_id", "digest").join(heads.select("digest", "id", "n"), "digest").drop("digest"), "named")
    alone = heads.join(shared, "digest", "left_anti").select("digest", "id", "n")
    told = rows.select("vec_id", "digest").join(alone, "digest").drop("digest")
    some = kinds.withColumn("digest", _digest()).join(shared, "digest", "left_semi").select("embedding", "id", "n")
    apart = rows.join(shared, "digest", "left_semi").join(some, "embedding").select("vec_id", "id", "n")
    return stage(told.unionByName(apart), "named")


def link(vectors: DataFrame, cosine: float = COSINE, **how) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.  Every copy of
    a vector links with every other copy and with every copy of the vectors near it.  Rows that share a vec_id
    are vectors of their own in one component; a row without vec_id links with nothing and is not kept.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = F.coalesce(usable(), F.lit(False)) & F.col("vec_id").isNotNull()
    kinds = classes(rows)
    heads = stage(kinds.select("id", "vec_id", "n", _digest().alias("digest")), "heads")
    named = _named(rows.where(good), kinds, heads)
    links = near_links(kinds, cosine, **how)
    kinds = heads
    near = links.where("near IS NOT NULL").groupBy(F.col("a").alias("id")).agg(F.sum("near").alias("near"))
    pairs = links.where("near IS NULL").select("a", "b")
    # A vec_id that names several different vectors ties them together.
    shared = named.groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("last")).where("a <> last")
    ties = named.select("vec_id", F.col("id").alias("b")).join(shared, "vec_id").select("a", "b")
    found = connected_components(pairs.unionByName(ties)).withColumnRenamed("node", "id")
    least = found.join(kinds.select("id", "vec_id"), "id").groupBy("component").agg(F.min("vec_id").alias("root"))
    roots = found.join(least, "component").select("id", "root")
    per_kind = (
        kinds.select("id", "vec_id")
        .join(near, "id", "left")
        .join(roots, "id", "left")
        .select("id", F.coalesce("near", F.lit(0)).alias("near"), F.coalesce("root", "vec_id").alias("component_id"))
    )
    # Written, so that both sides of the next join are scans and the rows of one much repeated vector can be split.
    per_kind = stage(per_kind, "linked")
    linked = named.join(per_kind, "id").select("vec_id", (F.col("n") - 1 + F.col("near")).alias("n_links"), "component_id")
    alone = rows.where(~good).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept")
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", kept)
