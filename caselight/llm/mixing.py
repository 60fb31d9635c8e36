"""Mixing sources to target weights under a curriculum that changes over training.

Each source has a weight and a schedule over training time t in [0, 1], a straight line from ``start`` to ``end``
times that weight.  Its integral over the whole training is the source's part in the mix, and its integral up to t,
scaled to the words that the mix takes from the source, is the source's cumulative demand.  The k-th word of a source is wanted when that demand reaches k, so inverting it gives each document its position,
and a range sort by position the training order.  Positions are times: where the schedules' sum changes over
training, so does the number of words that a unit of time takes, but not their order.

Only sizes travel, never texts.  Cumulative sums run in two steps, over the totals of hash ranges and within a
range, so a source of any size is spread over as many tasks as there are ranges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WEIGHTS = (5, 2, 1)
# Schedule of the sources of each weight: weight at the start and at the end of training.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
MOST_PASSES = 3
RANGE_DIGITS = 3  # hexadecimal digits of the id's hash that make a range: 4,096 ranges
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def _cycle(rank: Column, values: Sequence[float]) -> Column:
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(rank % len(values) == i, F.lit(v)).otherwise(out)
    return out


def targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, passes: int = MOST_PASSES,
    schedules: Sequence[tuple[float, float]] = SCHEDULES,
) -> DataFrame:
    """Adds weight, schedule and target to (source, source_size): one row per source.

    The words of all sources are shared by their schedules' integrals, here the weight.  Where a share passes ``passes`` times the source's size it
    stops there and the excess is shared by weight among the others, again until none is above.  That is one
    level L with target = min(cap, weight * L): with sources ordered by cap / weight, those whose ratio is
    below the level are full, and the level is what they leave over the weights of the rest.  A source of weight
    zero takes part in none of this, besides its words.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1)
    start, end = (_cycle(F.col("rank"), [float(s[i]) for s in schedules]) for i in (0, 1))
    integral = _cycle(F.col("rank"), [float(w) for w in weights]) * (start + end) / 2
    ranked = ranked.select(
        "source", "source_size", integral.alias("weight"), start.alias("start"), end.alias("end"), "rank"
    ).withColumn("cap", F.col("source_size").cast("double") * passes)
    weighs = F.col("weight") > 0
    by_ratio = Window.orderBy(F.when(weighs, F.col("cap") / F.col("weight")).asc_nulls_last(), "rank")
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    filled = ranked.withColumn("left", left).withColumn("open_weight", open_weight)
    filled = filled.withColumn("own", F.when(weighs, F.col("left") / F.col("open_weight")))
    filled = filled.withColumn("full", F.col("cap") <= F.col("weight") * F.col("own"))
    # The first source in this order that does not fill sets the level; all before it are full.
    final = F.min(F.when(~F.col("full"), F.struct("rank_by", "own"))).over(everything)
    filled = filled.withColumn("rank_by", F.row_number().over(by_ratio)).withColumn("level", final["own"])
    # Without such a source all that weigh are full, as where there are no words at all.
    target = F.when(weighs, F.least(F.col("cap"), F.coalesce(F.col("weight") * F.col("level"), F.col("cap")))).otherwise(F.lit(0.0))
    return filled.select("source", "source_size", "start", "end", target.alias("target"))


def demand_time(share: Column, start: Column, end: Column) -> Column:
    """Time at which a source's demand reaches a share of its total: the inverse of the integrated schedule.

    The integral start * t + (end - start) * t**2 / 2 over its total (start + end) / 2 equals the share.
    """
    total = (start + end) / 2
    root = F.sqrt(F.greatest(start * start + (end - start) * total * share * 2, F.lit(0.0)))
    return F.when(start + end == 0, share).when(start + root == 0, F.lit(0.0)).otherwise(total * share * 2 / (start + root))


def assign(docs: DataFrame, keep: Sequence[str] = (), weights: Sequence[int] = WEIGHTS, passes: int = MOST_PASSES,
           schedules: Sequence[tuple[float, float]] = SCHEDULES) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken, position and the ``keep`` columns.

    A source whose target is q times its size and a rest gives every document q times, and once more the
    documents that come first by a hash of their id until the rest is used up; of the last one only the words
    still wanted.  So the words taken from a source are its target, rounded down.  ``position`` is when the
    document's first word is wanted, null when none is.  Null texts have size 0; a null source is a source;
    rows with equal or null ids are told apart by their size, and equal rows do not matter.
    """
    sized = docs.select(
        "doc_id", "source", n_words().alias("size"), F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")).alias("key"), *keep
    )
    sized = sized.withColumn("part", F.substring("key", 1, RANGE_DIGITS))
    parts = sized.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    totals = parts.groupBy("source").agg(F.sum("part_size").alias("source_size"))
    goals = targets(totals, weights, passes, schedules)
    along = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    heads = parts.select("source", "part", F.coalesce(F.sum("part_size").over(along), F.lit(0)).alias("ahead"))
    plan = heads.join(goals.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    plan = plan.withColumnsRenamed({"source": "of", "part": "of_part"})
    at = F.col("source").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part"))
    within = (
        Window.partitionBy("source", "part").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = sized.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0))).join(plan, at)
    before = F.col("ahead") + F.col("inside")
    goal = F.floor("target")
    q = F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))
    rest = goal - q * F.col("source_size")
    more = F.least(F.greatest(rest - before, F.lit(0)), F.col("size"))
    taken = q * F.col("size") + more
    share = F.when(F.col("target") > 0, before.cast("double") / F.col("target"))
    return placed.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        taken.cast("long").alias("taken"),
        F.when(taken > 0, demand_time(F.least(share, F.lit(1.0)), F.col("start"), F.col("end"))).alias("position"),
        before.alias("before"),
        "start",
        "end",
        *keep,
    )


def _range_sorted(df: DataFrame, *ties: str) -> DataFrame:
    """Rows in training order over ranges of positions, those without one at the end."""
    order = [F.col("position").asc_nulls_last(), *ties]
    return df.repartitionByRange(*order).sortWithinPartitions(*order)


def first_uses(assigned: DataFrame) -> DataFrame:
    """One row per document, range-sorted by the training position of its first use; unused ones come last."""
    return _range_sorted(assigned, "doc_id", "size")


def training_order(assigned: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per use of a document, range-sorted by training position: what a training run reads in order.

    Columns: position, copy (from 1), words (those this use takes) and the document's.  Every use but a source's
    last takes the whole document.
    """
    used = assigned.where("taken > 0").withColumn(
        "copy", F.explode(F.expr("sequence(1, cast(ceil(taken / size) as int))"))
    )
    words = F.least("size", F.col("taken") - (F.col("copy") - 1) * F.col("size"))
    share = ((F.col("copy") - 1) * F.col("source_size") + F.col("before")).cast("double") / F.col("target")
    placed = used.select(
        demand_time(F.least(share, F.lit(1.0)), F.col("start"), F.col("end")).alias("position"),
        "copy",
        words.cast("long").alias("words"),
        "doc_id",
        *keep,
    )
    return _range_sorted(placed, "doc_id", "copy")


def cut_words(text: Column, words: Column, size: Column) -> Column:
    """The text, or its first ``words`` words joined by blanks where not all are taken."""
    found = F.regexp_extract_all(text, F.lit(f"({WORD})"), F.lit(1))
    return F.when(words >= size, text).otherwise(F.array_join(F.slice(found, F.lit(1), F.greatest(words.cast("int"), F.lit(0))), " "))
