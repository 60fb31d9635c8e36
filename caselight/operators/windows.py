"""Row-based window columns over daily series.

Inputs are aggregated first (one row per day, or per day and key), so a
partition holds at most one row per calendar day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.functions.exact import mean_exact, ratio


def _window(keys: Sequence[str], order: Sequence[str]):
    return W.partitionBy(*keys).orderBy(*order) if keys else W.orderBy(*order)


def lag_rows(col: str, n: int, keys: Sequence[str], order: Sequence[str]) -> Column:
    """Value ``n`` rows (not days) earlier."""
    return F.lag(col, n).over(_window(keys, order))


def change(col: str, n: int, keys: Sequence[str], order: Sequence[str]) -> Column:
    return F.col(col) - lag_rows(col, n, keys, order)


def change_pct(col: str, n: int, keys: Sequence[str], order: Sequence[str], dp: int = 2) -> Column:
    before = lag_rows(col, n, keys, order)
    return ratio(F.col(col) - before, before, dp, scale=100, wide=False)


def trailing_sum(col: Column, rows: int, keys: Sequence[str], order: Sequence[str]) -> tuple[Column, Column]:
    """Sum and count over the current row and the ``rows - 1`` before it."""
    frame = _window(keys, order).rowsBetween(1 - rows, 0)
    return F.sum(col).over(frame), F.count(col).over(frame)


def trailing_mean(
    col: str, rows: int, keys: Sequence[str], order: Sequence[str], dp: int, exact: bool = False
) -> Column:
    """Mean of the last ``rows`` rows of whole numbers, or with ``exact`` of doubles."""
    if exact:
        return mean_exact(F.col(col), dp, _window(keys, order).rowsBetween(1 - rows, 0))
    return ratio(*trailing_sum(F.col(col).cast("long"), rows, keys, order), dp)


def running_total(col: str, keys: Sequence[str], order: Sequence[str]) -> Column:
    frame = _window(keys, order).rowsBetween(W.unboundedPreceding, 0)
    return F.sum(F.col(col).cast("long")).over(frame)


def share(col: str, keys: Sequence[str], dp: int = 2) -> Column:
    """Percent of the partition total."""
    return ratio(F.col(col), F.sum(col).over(W.partitionBy(*keys)), dp, scale=100)


def rank_in(keys: Sequence[str], order: Sequence[Column]) -> Column:
    return F.rank().over(W.partitionBy(*keys).orderBy(*order)).cast("long")


def streak(df: DataFrame, keys: Sequence[str], order: str, bad: Column, out: str, mode: str = "literal") -> DataFrame:
    """Add the length of the current run of bad rows, 0 on a good row.

    ``literal`` numbers rows inside the group opened by each good row, so that
    good row itself takes number 1 and the first bad day after it reads 2.
    ``documented`` counts bad rows only.
    """
    if mode not in ("literal", "documented"):
        raise ValueError(f"unknown streak mode {mode!r}")
    in_order = W.partitionBy(*keys).orderBy(order)
    # Row position, and the position of the last good row so far.
    df = df.withColumn("_at", F.row_number().over(in_order).cast("long"))
    so_far = in_order.rowsBetween(W.unboundedPreceding, 0)
    df = df.withColumn("_good", F.max(F.when(~bad, F.col("_at"))).over(so_far))
    if mode == "literal":
        run = F.col("_at") - F.coalesce(F.col("_good"), F.lit(1)) + 1
    else:
        run = F.col("_at") - F.coalesce(F.col("_good"), F.lit(0))
    return df.withColumn(out, F.when(bad, run).otherwise(F.lit(0))).drop("_at", "_good")
