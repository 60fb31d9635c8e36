"""Column comments of the curated views."""

from __future__ import annotations

_SHARED = {
    "agency_avg_score": "Mean score of the agency",
    "agency_compliance_rank": "Rank of this agency and call type on the day, 1 is best",
    "agency_name": "Agency that took the call",
    "agent_avg_score": "Mean score over all calls of the agent",
    "agent_call_count": "Calls of the agent",
    "agent_name": "Agent who took the call",
    "agent_rank_in_agency": "Dense rank by mean score within the agency, 1 is best",
    "agent_rolling_5_avg": "Mean of the agent's last five calls",
    "abandoned_proxy_count": "Calls that waited over 600 seconds",
    "approval_rate_pct": "Approved share of decisions that were not cancelled",
    "approved": "Approved decisions",
    "avg_call_score": "Mean score, 0 to 100",
    "avg_days_to_decision": "Mean days from request to decision",
    "avg_handle_seconds": "Mean handle time",
    "avg_match_weight": "Mean candidate weight",
    "avg_parse_confidence": "Not recorded, always NULL",
    "avg_quality_score": "Mean scan quality, 0 to 1",
    "avg_wait_seconds": "Mean time in queue",
    "call_id": "Call key",
    "call_score": "Quality score, 0 to 100",
    "call_type": "Kind of call",
    "cancelled": "Cancelled requests",
    "candidate_count": "Candidates of the class that day",
    "channel_avg_weight": "Mean weight of the channel",
    "class_running_total": "Candidates of the class since the first day",
    "clinical_notes": "Clinical notes",
    "compliance_rate": "Share of calls scoring 85 or more, 0 to 1",
    "compliant_calls": "Calls scoring 85 or more",
    "cumulative_docs": "Documents since the first day",
    "daily_class_share": "Percent of the day's candidates",
    "day": "Calendar day",
    "day_over_day_change": "Change to the row before",
    "day_over_day_pct": "Percent change to the row before",
    "days_below_threshold": "Length of the current run of days below 0.85",
    "decision_date": "Day of the decision",
    "denial_rate_pct": "Denied share of decisions that were not cancelled",
    "denied": "Denied decisions",
    "discharge_summaries": "Discharge summaries",
    "disposition": "Outcome of the call",
    "doc_id": "Document key",
    "doc_risk_tier": "Readability and anchor tier",
    "docs_same_day_type": "Documents of the same type and day",
    "docs_with_parse_error": "Documents with a parse error",
    "document_type": "Kind of document",
    "dq_degradation_flag": "Unreadable share above 1.5 times its 7-row mean",
    "emotional_markers": "Tags heard in the call",
    "fcr_pct": "Percent resolved on first contact",
    "fcr_resolved_count": "Calls resolved on first contact",
    "has_auth_id": "An authorization id was read",
    "has_member_id": "A member id was read",
    "high_risk_calls": "Calls scoring below 70",
    "high_risk_rate": "Share of calls scoring below 70, 0 to 1",
    "imaging_reports": "Imaging reports",
    "intake_date": "Day the document came in",
    "is_volume_spike": "More than twice the 7-row mean",
    "key_topics": "Topics of the call",
    "lab_results": "Lab results",
    "language": "Language of the call",
    "match_class": "match, possible_match or non_match",
    "match_date": "Day of scoring",
    "match_weight": "Total candidate weight",
    "max_match_weight": "Largest weight",
    "metric_name": "Name of the count",
    "metric_unit": "Unit of the value",
    "metric_value": "Current value",
    "min_match_weight": "Smallest weight",
    "missing_dob": "No date of birth read",
    "missing_dob_count": "Documents without date of birth",
    "missing_ssn4": "No SSN digits read",
    "missing_ssn4_count": "Documents without SSN digits",
    "needs_review_calls": "Calls scoring 70 to 84",
    "ops_date": "Day of the call",
    "outcome_bucket": "compliant, needs_review or high_risk",
    "pa_approval_rate_pct": "Approved share of all decided requests",
    "pa_avg_days_to_decision": "Mean days from request to decision",
    "pa_urgent_count": "Urgent decided requests",
    "parse_date": "Day of parsing",
    "partial": "Partial approvals",
    "payer_code": "Payer, NULL when unassigned",
    "payer_name": "Name of the payer",
    "payer_type": "Line of business",
    "pct_missing_dob": "Percent without date of birth",
    "pct_missing_ssn4": "Percent without SSN digits",
    "pct_unreadable": "Percent unreadable",
    "prev_day_total": "Total of the row before",
    "prev_day_unreadable_pct": "pct_unreadable of the row before",
    "prev_week_compliance": "Compliance rate seven rows earlier",
    "prev_week_count": "Candidates of the class seven rows earlier",
    "prior_auth_forms": "Prior-authorization forms",
    "rolling_30d_avg": "Mean of the last 30 rows",
    "rolling_7d_avg": "Mean of the last 7 rows",
    "rolling_7d_avg_count": "Mean count of the last 7 rows of the class",
    "rolling_7d_compliance": "Mean compliance rate of the last 7 rows",
    "rolling_7d_high_risk": "Mean high-risk rate of the last 7 rows",
    "rolling_7d_missing_dob_pct": "Mean pct_missing_dob of the last 7 rows",
    "rolling_7d_unreadable_pct": "Mean pct_unreadable of the last 7 rows",
    "score_pctile_in_type": "Percentile of the score within the call type",
    "score_rationale": "Score in words",
    "score_vs_agency_avg": "Score minus the agency's mean",
    "scored_calls": "Calls scored",
    "scored_date": "Day of scoring",
    "sentiment_end": "Tone at the end",
    "sentiment_overall": "Tone of the whole call",
    "sentiment_start": "Tone at the start",
    "sentiment_trajectory": "How the tone changed",
    "sla_compliance_pct": "Percent decided within the target",
    "sla_target_hours": "72 for urgent, 168 for standard",
    "source_channel": "Intake channel",
    "summary_text": "Summary of the call",
    "total_calls": "Calls",
    "total_decisions": "Decisions",
    "total_docs": "Documents",
    "total_documents": "Documents ever received",
    "total_pa_decisions": "Decided requests",
    "total_prior_auth_forms": "Prior-authorization forms ever received",
    "type_avg_weight": "Mean weight of the document type",
    "unreadable_count": "Unreadable documents",
    "unreadable_docs": "Unreadable documents",
    "unreadable_flag": "OCR could not read the document",
    "unreadable_pct": "Percent unreadable",
    "unreadable_trend_3d": "Change of pct_unreadable over three rows",
    "urgency": "urgent or standard",
    "vendor_template": "Transcript template",
    "via_electronic": "Received electronically",
    "via_fax": "Received by fax",
    "via_mail": "Received by mail",
    "via_upload": "Received by upload",
    "weight_pctile_in_type": "Percentile of the weight within the document type",
    "weight_rank_in_type": "Rank of the weight within the document type, 1 is best",
    "within_sla_count": "Decisions within the target",
    "wow_change_pct": "Percent change to seven rows earlier",
    "wow_compliance_change": "Change to seven rows earlier",
}

_OWN = {
    "intake_daily_by_payer": {
        "total_docs": "Documents of the payer that day",
        "is_volume_spike": "More than twice the payer's 7-row mean",
    },
    "call_ops_daily": {"ops_date": "Day of the overlay call time"},
    "call_ops_daily_by_created": {"ops_date": "Day the call was scored"},
}


def view_comments(view: str) -> dict[str, str]:
    """Comment per column name; unknown columns of a view are skipped by the caller."""
    return {**_SHARED, **_OWN.get(view, {})}


VIEW_COMMENTS: dict[str, str] = {
    "intake_daily": "Documents received per day, with change, rolling means and volume spikes",
    "intake_daily_by_payer": "Documents received per day and payer; means and spikes stay within a payer",
    "match_detail_ranked": "Member candidates with rank and context within document type and channel",
    "match_detail_by_payer": "Member candidates with payer, risk tier and extraction flags",
    "auth_match_daily": "Authorization candidates per day and class, with weekly change and shares",
    "data_quality_daily": "Parsing quality per day, with rolling means and degradation flag",
    "kpi_snapshot": "Counts over the whole processing, one row each",
    "call_scores": "Scored calls with agent, agency and call-type context",
    "call_sentiment": "Summary and sentiment of each call",
    "compliance_daily": "Compliance per day, call type and agency, with trends, ranks and runs below the floor",
    "pa_decisions_daily": "Authorization decisions per day, payer and urgency, against their time target",
    "payer_mix": "Volume, readability and decisions per payer",
    "call_ops_daily_by_created": "Queue and handle times per day of scoring, agency and call type",
    "call_ops_daily": "Queue and handle times per day of the overlay call time, agency and call type",
}
