"""Collapse of logged conversation snapshots, and chat rendering.

A log often holds a conversation several times, each time with more turns.  Every turn gets a hash of its
conversation up to there: the running sum of the hashes of (position, role, text), in two independent sums.
A conversation that equals a shorter part of another one, or all of one with a smaller id, goes.

Positions and running sums are made in blocks of turn numbers, so a conversation of any length is spread out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caselight.llm.common import stage

BLOCK_TURNS = 1_024
PART_TURNS = 256  # turns of a conversation that one rendered part holds at most
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def _told(col: str) -> Column:
    """Text in which null differs from every string."""
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def prefixes(turns: DataFrame, block: int = BLOCK_TURNS) -> DataFrame:
    """``(conv_id, at, role, text, p, q)``: each turn's position from 1 and the two sums up to it.

    Turns are ordered by turn (null last), role and text; repeated rows count once; rows without conv_id
    belong to no conversation and are left out.
    """
    rows = turns.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL").distinct()
    rows = rows.withColumn("block", F.coalesce(F.floor(F.col("turn") / block), F.lit((1 << 63) // block)))
    within = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    rows = stage(rows.withColumn("inside", F.row_number().over(within)), "turns")

    def ahead(frame: DataFrame, *sums: Column) -> DataFrame:
        names = [f"ahead{i}" for i in range(len(sums))]
        blocks = frame.groupBy("conv_id", "block").agg(*[s.alias(n) for s, n in zip(sums, names, strict=True)])
        return blocks.select(
            "conv_id", "block", *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(n) for n in names]
        )

    placed = rows.join(ahead(rows, F.count(F.lit(1))), ["conv_id", "block"])
    placed = placed.withColumn("at", F.col("ahead0") + F.col("inside")).drop("ahead0")
    whole = "decimal(20,0)"
    terms = placed.withColumns({
        "x": F.xxhash64("at", _told("role"), _told("text")).cast(whole),
        "y": F.xxhash64(F.lit("second"), _told("text"), _told("role"), "at").cast(whole),
    })
    so_far = Window.partitionBy("conv_id", "block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    summed = terms.join(ahead(terms, F.sum("x"), F.sum("y")), ["conv_id", "block"])
    return stage(
        summed.select(
            "conv_id",
            "at",
            "role",
            "text",
            (F.sum("x").over(so_far) + F.col("ahead0")).cast("decimal(38,0)").alias("p"),
            (F.sum("y").over(so_far) + F.col("ahead1")).cast("decimal(38,0)").alias("q"),
        ),
        "prefixes",
    )


def maximal(found: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, n_logged)``: conversations that no other one contains from its start; n_logged equal ones."""
    ends = found.groupBy("conv_id").agg(F.max("at").alias("n_turns"))
    full = found.join(ends, "conv_id")
    last = full.where("at = n_turns").groupBy("at", "p", "q")
    last = last.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logged"))
    inner = full.where("at < n_turns").select("at", "p", "q").distinct()
    kept = last.join(inner, ["at", "p", "q"], "left_anti")
    return kept.select("conv_id", F.col("at").cast("long").alias("n_turns"), "n_logged")


def render(role: Column, text: Column) -> Column:
    """One turn between chat marks; marks inside the text are taken apart so that they cannot open a turn."""
    safe = F.replace(F.coalesce(text, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(OPEN), F.coalesce(role, F.lit("unknown")), F.lit("\n"), safe, F.lit(f"{CLOSE}\n"))


def collapse(turns: DataFrame, part: int = PART_TURNS, block: int = BLOCK_TURNS) -> DataFrame:
    """``(conv_id, part, n_turns, n_logged, rendered)``: maximal conversations as chat text.

    A conversation of up to ``part`` turns is one row; a longer one goes on in further parts.
    """
    found = prefixes(turns, block)
    kept = maximal(found)
    lines = found.join(kept, "conv_id").select(
        "conv_id", "n_turns", "n_logged", "at", F.floor((F.col("at") - 1) / part).alias("part"), render(F.col("role"), F.col("text")).alias("line")
    )
    parts = lines.groupBy("conv_id", "part", "n_turns", "n_logged").agg(
        F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines")
    )
    return parts.select(
        "conv_id", F.col("part").cast("long"), "n_turns", "n_logged", F.array_join("lines.line", "").alias("rendered")
    )
