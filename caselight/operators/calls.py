"""Call-centre rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.functions.exact import mean_int, n_where, ratio
from caselight.functions.exprs import day


def compliance_rollup(calls: DataFrame) -> DataFrame:
    """Calls per (day, call type, agency) by outcome, with rates."""
    rows = F.count(F.lit(1))
    bucket = F.col("outcome_bucket")
    high_risk = n_where(bucket == "high_risk")
    compliant = n_where(bucket == "compliant")
    return calls.groupBy(day(F.col("created_ts")).alias("day"), "call_type", "agency_name").agg(
        rows.alias("scored_calls"),
        mean_int(F.col("call_score"), 1).alias("avg_call_score"),
        compliant.alias("compliant_calls"),
        n_where(bucket == "needs_review").alias("needs_review_calls"),
        high_risk.alias("high_risk_calls"),
        ratio(high_risk, rows, 5).alias("high_risk_rate"),
        F.round(compliant.cast("double") / rows, 16).alias("compliance_rate"),
        F.lit("sdp").alias("source_schema"),
    )
