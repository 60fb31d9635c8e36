"""Backfills over stored tables: payers, urgency, call timings, dates.

Each function returns the new table contents; applied to its own output it
changes nothing more.
"""

from __future__ import annotations

from datetime import date
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions.exprs import PAYER_CODES, bucket, days_between, pick, plus_minutes, spread_ts
from caselight.sources.tables import append_missing, ensure_columns, merge_update, update_where

if TYPE_CHECKING:
    from caselight.sources.registry import Registry

# The payer dimension.
PAYER_ROWS = (
    ("NORTHWAVE", "Northwave Health", "commercial"),
    ("METRIDIAN", "Metridian", "commercial"),
    ("BLUEHARBOR", "BlueHarbor", "commercial"),
    ("VERITAS", "Veritas", "commercial"),
    ("SILVERPEAK", "SilverPeak Senior Health", "medicare_advantage"),
)
# Minutes each stage lags behind intake, per timestamp column.
STAGE_LAG = {
    "clinical_doc_parsed": ("ingest_ts", 5),
    "clinical_doc_structured": ("extraction_ts", 15),
    "doc_member_match_candidates": ("pipeline_run_ts", 30),
    "doc_auth_match_candidates": ("pipeline_run_ts", 30),
}
URGENT_TENTHS = 3
FCR_PERCENT = 70


def payer_of(key: str) -> Column:
    return pick(PAYER_CODES, bucket(F.col(key), len(PAYER_CODES)))


def assign_payer(df: DataFrame, key: str) -> DataFrame:
    """Give rows without a payer one by hash of their key."""
    df = ensure_columns(df, {"payer_code": "string"})
    return update_where(df, F.col("payer_code").isNull(), {"payer_code": payer_of(key)})


def assign_urgency(auths: DataFrame) -> DataFrame:
    auths = ensure_columns(auths, {"urgency": "string"})
    urgent = bucket(F.col("auth_id"), 10) < URGENT_TENTHS
    return update_where(
        auths, F.col("urgency").isNull(), {"urgency": F.when(urgent, "urgent").otherwise("standard")}
    )


def cascade_payer(table: DataFrame, docs: DataFrame) -> DataFrame:
    """Copy the document's payer to a stage table where it has none."""
    return merge_update(
        ensure_columns(table, {"payer_code": "string"}),
        docs.select("doc_id", "payer_code"),
        ["doc_id"],
        {"payer_code": F.col("s.payer_code")},
        when=F.col("t.payer_code").isNull(),
    )


def add_call_timings(timings: DataFrame, calls: DataFrame, generated_at: Column) -> DataFrame:
    """Hash-derived wait, handle time and first-call resolution for new calls."""
    key = F.col("call_id")
    derived = calls.select(
        key,
        (bucket(key, 540, "wait") + 60).cast("int").alias("wait_seconds"),
        (bucket(key, 1620, "handle") + 180).cast("int").alias("handle_seconds"),
        (bucket(key, 100, "fcr") < FCR_PERCENT).alias("fcr_flag"),
        generated_at.alias("generated_at"),
    )
    return append_missing(timings, derived, ["call_id"])


def spread_documents(docs: DataFrame, as_of: date, loaded_on: date, days: int = 90) -> DataFrame:
    """Spread documents loaded in one batch over the ``days`` before ``as_of``."""
    ts = spread_ts(F.col("doc_id"), F.lit(as_of), days)
    return update_where(
        docs,
        F.to_date("ingestion_timestamp") == F.lit(loaded_on),
        {"ingestion_timestamp": ts, "received_timestamp": ts},
    )


def cascade_stage_ts(table: DataFrame, name: str, docs: DataFrame, loaded_on: date) -> DataFrame:
    """Move a stage timestamp behind the document's new intake time."""
    column, minutes = STAGE_LAG[name]
    return merge_update(
        table,
        docs.select("doc_id", "ingestion_timestamp"),
        ["doc_id"],
        {column: plus_minutes(F.col("s.ingestion_timestamp"), minutes)},
        when=F.to_date(f"t.{column}") == F.lit(loaded_on),
    )


def shift_decisions(auths: DataFrame, as_of: date, days: int = 90) -> DataFrame:
    """Move old decisions into the last ``days`` days, keeping request-to-decision gaps."""
    decided = F.date_sub(F.lit(as_of), bucket(F.col("auth_id"), days).cast("int"))
    gap = F.greatest(
        F.lit(0), days_between(F.col("auth_decision_date"), F.col("auth_requested_date"))
    )
    return update_where(
        auths,
        F.col("auth_decision_date").isNotNull()
        & (F.col("auth_decision_date") < F.date_sub(F.lit(as_of), days - 1)),
        {"auth_decision_date": decided, "auth_requested_date": F.date_sub(decided, gap)},
    )


def overlay_call_ts(timings: DataFrame, as_of: date, days: int = 30) -> DataFrame:
    """Fill the overlay call time where there is none."""
    timings = ensure_columns(timings, {"synthetic_call_ts": "timestamp"})
    return update_where(
        timings,
        F.col("synthetic_call_ts").isNull(),
        {"synthetic_call_ts": spread_ts(F.col("call_id"), F.lit(as_of), days)},
    )


# The same backfills over all tables of a registry ---------------------------------


def backfill_payers(reg: Registry) -> Registry:
    """Payer and urgency where missing, then the payer cascade to the stage tables."""
    out = reg.copy()
    out.put("clinical_document", assign_payer(reg.raw("clinical_document"), "doc_id"))
    out.put("authorization", assign_urgency(assign_payer(reg.raw("authorization"), "auth_id")))
    for name in STAGE_LAG:
        out.put(name, cascade_payer(reg.raw(name), out.raw("clinical_document")))
    return out


def backfill_timings(reg: Registry, generated_at: Column) -> Registry:
    out = reg.copy()
    timings = add_call_timings(reg.raw("call_ops_supplemental"), reg.raw("mv_call_scores"), generated_at)
    out.put("call_ops_supplemental", timings)
    return out


def spread_dates(reg: Registry, as_of: date, loaded_on: date) -> Registry:
    """Documents, stages, decisions and call times moved into the window before ``as_of``."""
    out = reg.copy()
    out.put("clinical_document", spread_documents(reg.raw("clinical_document"), as_of, loaded_on))
    for name in STAGE_LAG:
        out.put(name, cascade_stage_ts(reg.raw(name), name, out.raw("clinical_document"), loaded_on))
    out.put("authorization", shift_decisions(reg.raw("authorization"), as_of))
    out.put("call_ops_supplemental", overlay_call_ts(reg.raw("call_ops_supplemental"), as_of))
    return out
