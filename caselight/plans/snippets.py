"""Reusable filters, dimensions and measures over the curated views.

Relative filters take the reporting date instead of the wall clock.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from caselight.functions.exact import mean_exact, mean_int, n_where, pct
from caselight.functions.exprs import TIER_NONE, since


def _rows() -> Column:
    return F.count(F.lit(1))


# name -> (view, condition)
FILTERS: dict[str, tuple[str, Callable[[], Column]]] = {
    "urgent_decisions": ("pa_decisions_daily", lambda: F.col("urgency") == "urgent"),
    "standard_decisions": ("pa_decisions_daily", lambda: F.col("urgency") == "standard"),
    "degradation_days": ("data_quality_daily", lambda: F.col("dq_degradation_flag")),
    "matches": ("match_detail_by_payer", lambda: F.col("match_class") == "match"),
    "non_matches": ("match_detail_by_payer", lambda: F.col("match_class") == "non_match"),
    "fax_only": ("match_detail_by_payer", lambda: F.col("source_channel") == "fax"),
    "high_risk_documents": ("match_detail_by_payer", lambda: F.col("doc_risk_tier") == TIER_NONE),
    "spike_days": ("intake_daily", lambda: F.col("is_volume_spike")),
    "commercial_payers": ("payer_mix", lambda: F.col("payer_type") == "commercial"),
    "compliant_calls": ("call_scores", lambda: F.col("outcome_bucket") == "compliant"),
    "high_risk_calls": ("call_scores", lambda: F.col("outcome_bucket") == "high_risk"),
    "escalated_calls": ("call_scores", lambda: F.col("disposition") == "escalated"),
    "enough_calls": ("call_scores", lambda: F.col("agent_call_count") >= 20),
    "declining_sentiment": ("call_sentiment", lambda: F.col("sentiment_trajectory") == "declining"),
    "systemic_compliance": ("compliance_daily", lambda: F.col("days_below_threshold") > 3),
}

# name -> (view, condition on the reporting date)
RECENT: dict[str, tuple[str, Callable[[Column], Column]]] = {
    "decisions_30_days": ("pa_decisions_daily", lambda d: since(F.col("decision_date"), d, 30)),
    "intake_7_days": ("intake_daily", lambda d: since(F.col("intake_date"), d, 7)),
    "call_ops_14_days": ("call_ops_daily", lambda d: since(F.col("ops_date"), d, 14)),
}

# name -> (view, column)
DIMENSIONS: dict[str, tuple[str, str]] = {
    "risk_tier": ("match_detail_by_payer", "doc_risk_tier"),
    "match_class": ("match_detail_by_payer", "match_class"),
    "document_type": ("match_detail_by_payer", "document_type"),
    "source_channel": ("match_detail_by_payer", "source_channel"),
    "intake_date": ("intake_daily", "intake_date"),
    "scored_date": ("call_scores", "scored_date"),
    "agent": ("call_scores", "agent_name"),
    "call_type": ("call_scores", "call_type"),
    "agency": ("call_scores", "agency_name"),
    "sentiment": ("call_sentiment", "sentiment_overall"),
}

# name -> (view, aggregate)
MEASURES: dict[str, tuple[str, Callable[[], Column]]] = {
    "match_rate_pct": (
        "match_detail_by_payer", lambda: pct(n_where(F.col("match_class") == "match"), _rows()),
    ),
    "high_risk_document_pct": (
        "match_detail_by_payer", lambda: pct(n_where(F.col("doc_risk_tier") == TIER_NONE), _rows()),
    ),
    # Two decimals here; the metric view carries four.
    "avg_weight": ("match_detail_by_payer", lambda: mean_exact(F.col("match_weight"), 2)),
    "avg_ocr_quality": ("intake_daily", lambda: mean_exact(F.col("avg_quality_score"), 3)),
    "extraction_complete_pct": (
        "match_detail_by_payer",
        lambda: pct(n_where(~F.col("missing_dob") & ~F.col("missing_ssn4")), _rows()),
    ),
    "documents_received": ("intake_daily", lambda: F.sum("total_docs")),
    "escalations": ("call_scores", lambda: n_where(F.col("disposition") == "escalated")),
    "avg_call_score": ("call_scores", lambda: mean_int(F.col("call_score"), 1)),
    "high_risk_calls": ("call_scores", lambda: n_where(F.col("outcome_bucket") == "high_risk")),
    "compliance_rate_pct": (
        "call_scores", lambda: pct(n_where(F.col("outcome_bucket") == "compliant"), _rows()),
    ),
    "longest_streak": ("compliance_daily", lambda: F.max("days_below_threshold")),
}
