"""Ranks, percentiles and rolling means that do not gather a group in one task.

A window such as ``PERCENT_RANK() OVER (PARTITION BY document_type ORDER BY
weight)`` sends every row of a document type to one task.  The forms here count
rows per distinct value first; ranks are prefix sums over those counts and go
back to the rows by a lookup.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.functions.exact import ratio
from caselight.session import materialize

# Distinct values per run that one window task may sort.
CELLS_PER_TASK = 200_000
# Rows of a lookup table that may be sent to every executor.
BROADCAST_ROWS = 200_000
# Rows of one key above which its rolling window is cut into ranges.
HOT_ROWS = 2_000_000


def null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Join on keys where NULL meets NULL, as window partitions do."""
    renamed = right.select(
        *[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys]
    )
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, on, how).drop(*[f"_r_{k}" for k in keys])


def sized(df: DataFrame, limit: int = BROADCAST_ROWS, at_most: int | None = None) -> DataFrame:
    """Broadcast a narrow lookup table once its size is known.

    ``at_most`` is a row count known to bound it (it is an aggregate of a
    counted table); otherwise the rows are counted.  Above ``limit`` the join
    is left to the planner: a shuffled join whose oversized partitions
    adaptive execution splits.
    """
    fits = at_most is not None and at_most <= limit
    return F.broadcast(df) if fits or df.limit(limit + 1).count() <= limit else df


def value_ranks(
    cells: DataFrame,
    keys: Sequence[str],
    value: str,
    cells_per_task: int = CELLS_PER_TASK,
    at_most: int | None = None,
) -> DataFrame:
    """Per (keys, value): rows below, rows above, distinct values above, total.

    ``cells`` holds one row per (keys, value) with its row count ``n``, and at
    most ``at_most`` rows if that is known.  A
    small input is windowed per key.  A large one is range-partitioned on
    (keys, value); each range is summed on its own and shifted by the totals
    of the ranges before it, so no task holds more than a range.
    """
    keys = list(keys)
    total_cells = at_most if at_most is not None and at_most <= cells_per_task else cells.count()
    if total_cells <= cells_per_task:
        up = W.partitionBy(*keys).orderBy(F.col(value).asc_nulls_first())
        all_rows = W.partitionBy(*keys)
        upto = up.rowsBetween(W.unboundedPreceding, 0)
        ranked = cells.select(
            *keys,
            value,
            (F.sum("n").over(upto) - F.col("n")).alias("below"),
            F.sum("n").over(all_rows).alias("total"),
            F.col("n"),
            F.count(F.lit(1)).over(upto).alias("_pos"),
            F.count(F.lit(1)).over(all_rows).alias("_cells"),
        )
    else:
        slices = -(-total_cells // cells_per_task)
        ranged = materialize(
            cells.repartitionByRange(slices, *keys, F.col(value).asc_nulls_first()).withColumn(
                "_slice", F.spark_partition_id()
            ),
            "value-ranges",
        )
        sums = ranged.groupBy(*keys, "_slice").agg(
            F.sum("n").alias("_n"), F.count(F.lit(1)).alias("_c")
        )
        before = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
        per_key = W.partitionBy(*keys)
        offsets = materialize(
            sums.select(
                *keys,
                "_slice",
                F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n_before"),
                F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_c_before"),
                F.sum("_n").over(per_key).alias("total"),
                F.sum("_c").over(per_key).alias("_cells"),
            ),
            "value-offsets",
        )
        inside = (
            W.partitionBy("_slice", *keys)
            .orderBy(F.col(value).asc_nulls_first())
            .rowsBetween(W.unboundedPreceding, 0)
        )
        local = ranged.select(
            *keys,
            value,
            "_slice",
            "n",
            F.sum("n").over(inside).alias("_n_upto"),
            F.count(F.lit(1)).over(inside).alias("_c_upto"),
        )
        ranked = null_safe(local, offsets, [*keys, "_slice"]).select(
            *keys,
            value,
            (F.col("_n_before") + F.col("_n_upto") - F.col("n")).alias("below"),
            "total",
            "n",
            (F.col("_c_before") + F.col("_c_upto")).alias("_pos"),
            "_cells",
        )
    return ranked.select(
        *keys,
        value,
        "below",
        (F.col("total") - F.col("below") - F.col("n")).alias("above"),
        (F.col("_cells") - F.col("_pos")).alias("values_above"),
        "total",
    )


def rank_desc() -> Column:
    """RANK() ... ORDER BY value DESC from :func:`value_ranks`."""
    return F.col("above") + 1


def dense_rank_desc() -> Column:
    return F.col("values_above") + 1


def percent_rank_asc(dp: int = 4) -> Column:
    """PERCENT_RANK() ... ORDER BY value from :func:`value_ranks`."""
    single = F.col("total") <= 1
    return F.when(single, F.lit(0.0)).otherwise(ratio(F.col("below"), F.col("total") - 1, dp))


def rolling_mean(
    df: DataFrame,
    key: str,
    order: Sequence[str],
    value: str,
    rows: int,
    dp: int,
    out: str,
    key_counts: DataFrame,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Mean of the last ``rows`` rows per key, ``order`` being unique per key.

    ``key_counts`` (key, n) tells which keys are too large for one task.  Those
    are range-partitioned on (key, order); each range borrows the last
    ``rows - 1`` rows before it, which is all its first rows can look back at.
    """
    order = list(order)

    def windowed(part: DataFrame, by: Sequence[str]) -> DataFrame:
        frame = W.partitionBy(*by).orderBy(*order).rowsBetween(1 - rows, 0)
        v = F.col(value).cast("long")
        return part.withColumn(out, ratio(F.sum(v).over(frame), F.count(v).over(frame), dp, wide=False))

    hot = key_counts.where(F.col("n") > hot_rows).select(key, "n")
    sizes = hot.agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("rows")).first()
    if not sizes["keys"]:
        return windowed(df, [key])

    hot_ids = materialize(hot.select(key), "hot-keys")
    cold = windowed(null_safe(df, hot_ids, [key], "left_anti"), [key])
    slices = max(2, -(-sizes["rows"] // hot_rows))
    ranged = materialize(
        null_safe(df, hot_ids, [key], "left_semi")
        .repartitionByRange(slices, key, *order)
        .withColumn("_slice", F.spark_partition_id()),
        "hot-ranges",
    )
    # The last rows of every range; the last ones before a range are among the
    # tails of the ranges before it, so one look back over the tails finds them.
    tails = (
        ranged.select(key, *order, value, "_slice")
        .withColumn(
            "_k",
            F.row_number().over(W.partitionBy(key, "_slice").orderBy(*[F.col(c).desc() for c in order])),
        )
        .where(F.col("_k") <= rows - 1)
    )
    by_key = W.partitionBy(key).orderBy(*order)
    row = F.struct(*order, value)
    halo = (
        tails.withColumn("_before", F.collect_list(row).over(by_key.rowsBetween(1 - rows, -1)))
        .withColumn("_prev", F.lag("_slice").over(by_key))
        .where(F.col("_prev").isNotNull() & (F.col("_prev") != F.col("_slice")))
        .select(key, "_slice", F.explode("_before").alias("_b"))
        .select(key, "_b.*", "_slice", F.lit(True).alias("_borrowed"))
    )
    full = ranged.withColumn("_borrowed", F.lit(False)).unionByName(halo, allowMissingColumns=True)
    warm = windowed(full, [key, "_slice"]).where(~F.col("_borrowed")).drop("_borrowed", "_slice")
    return cold.unionByName(warm)


def top_ranked(df: DataFrame, value: str, k: int, cells: DataFrame) -> DataFrame:
    """Rows whose RANK() by ``value`` descending is at most ``k``, all ties kept.

    ``cells`` (value, n) are the row counts per distinct value.  Ranks are
    decided there; the rows come back by a lookup, so a best value shared by a
    third of all rows stays spread over the cluster.
    """
    # At most k distinct values can have a rank of k or less.
    best = cells.orderBy(F.col(value).desc()).limit(k)
    ranks = (
        value_ranks(best, [], value, at_most=k).withColumn("rk", rank_desc()).where(F.col("rk") <= k).select(value, "rk")
    )
    return df.join(F.broadcast(ranks), value)  # k rows at most
