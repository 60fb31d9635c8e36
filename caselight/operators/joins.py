"""Lookups that stay balanced when one key holds a large part of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.session import materialize

HOT_KEY_ROWS = 2_000_000
HOT_KEY_SAMPLE = 0.05


def hot_keys(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_KEY_ROWS, fraction: float = HOT_KEY_SAMPLE
) -> DataFrame:
    """Keys met about ``hot_rows`` times or more, with the pieces to cut them in.

    Found on a sample: it only decides how work is split, never which rows
    count.  At most rows / ``hot_rows`` keys can qualify.
    """
    seen = df.select(*keys)
    if fraction < 1:
        seen = seen.sample(fraction, seed=11)
    limit = max(1.0, hot_rows * fraction)
    return (
        seen.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= limit)
        .select(*keys, (F.ceil(F.col("_n") / limit) + 1).cast("int").alias("_pieces"))
    )


def splits_skew(df: DataFrame) -> bool:
    """Whether the session re-plans skewed join partitions at run time."""
    conf = df.sparkSession.conf
    keys = ("spark.sql.adaptive.enabled", "spark.sql.adaptive.skewJoin.enabled")
    return all(conf.get(k, "true") == "true" for k in keys)


def balanced_lookup(
    facts: DataFrame,
    index: DataFrame,
    keys: Sequence[str],
    row_id: str,
    hot_rows: int | None = None,
    fraction: float = HOT_KEY_SAMPLE,
) -> DataFrame:
    """Left join of ``facts`` with an ``index`` holding one row per key.

    The index side cannot multiply rows, so skew sits on the fact side alone,
    where adaptive execution cuts oversized partitions.  Without it, or when
    ``hot_rows`` is given, rows of a hot key are dealt to several pieces by
    ``row_id`` and the index row of that key is copied to each piece.
    """
    keys = list(keys)
    if hot_rows is None:
        if splits_skew(facts):
            return facts.join(index, keys, "left")
        hot_rows = HOT_KEY_ROWS
    hot = materialize(hot_keys(facts, keys, hot_rows, fraction), "hot-keys")
    if hot.isEmpty():
        return facts.join(index, keys, "left")
    dealt = facts.join(hot, keys, "left").withColumn(
        "_piece",
        F.when(F.col("_pieces").isNull(), 0).otherwise(
            F.pmod(F.xxhash64(row_id), F.col("_pieces").cast("long")).cast("int")
        ),
    )
    copied = index.join(hot, keys, "left").withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_pieces"), F.lit(1)) - 1))
    )
    return dealt.drop("_pieces").join(copied.drop("_pieces"), [*keys, "_piece"], "left").drop("_piece")
