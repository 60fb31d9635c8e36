"""Query text per checked query; names equal those of the Spark catalogue."""

from __future__ import annotations

from oracles.sql import N, PAYERS, abs_hash, digits_of, half_up, mean, n_if, nth, pct, sql

VIEWS = {
    "view_intake_daily": "SELECT * FROM v_intake",
    "view_intake_daily_by_payer": "SELECT * FROM v_intake_payer",
    "view_match_detail_ranked": "SELECT * FROM v_match_ranked",
    "view_match_detail_by_payer": "SELECT * FROM v_match",
    "view_auth_match_daily": "SELECT * FROM v_auth",
    "view_data_quality_daily": "SELECT * FROM v_quality",
    "view_kpi_snapshot": " UNION ALL ".join(
        f"SELECT '{label}' AS metric_name, CAST({col} AS DOUBLE) AS metric_value, 'count' AS metric_unit"
        " FROM v_kpi_row"
        for col, label in {
            "total_members": "Total Members",
            "total_documents": "Total Documents",
            "total_parsed": "Total Parsed",
            "unreadable_docs": "Unreadable Documents",
            "high_confidence_matches": "High Confidence Matches",
            "possible_matches": "Possible Matches",
            "non_matches": "Non Matches",
            "auth_matches": "Auth Matches",
        }.items()
    ),
    "view_call_scores": "SELECT * FROM v_calls",
    "view_call_sentiment": """SELECT call_id, call_type, summary_text, sentiment_overall, sentiment_start,
      sentiment_end, sentiment_trajectory, array_to_string(key_topics, '|') AS key_topics,
      array_to_string(emotional_markers, '|') AS emotional_markers FROM sent""",
    "view_compliance_daily": "SELECT * FROM v_comp",
    "view_compliance_daily_documented": "SELECT * FROM v_comp_documented",
    "view_pa_decisions_daily": "SELECT * FROM v_pa",
    "view_payer_mix": "SELECT * FROM v_mix",
    "view_call_ops_daily_by_created": "SELECT * FROM v_ops_created",
    "view_call_ops_daily": "SELECT * FROM v_ops",
}


def big(x: str) -> str:
    return f"CAST({x} AS BIGINT)"


MEASURES = {
    "doc_intake": {
        "total_documents": big("SUM(total_docs)"),
        "unreadable_documents": big("SUM(unreadable_docs)"),
        "avg_ocr_quality": mean("avg_quality_score", 3, 3),
        "fax_volume": big("SUM(via_fax)"),
        "electronic_volume": big("SUM(via_electronic)"),
        "upload_volume": big("SUM(via_upload)"),
        "mail_volume": big("SUM(via_mail)"),
        "spike_day_count": n_if("is_volume_spike"),
        "unreadable_rate_pct": pct("SUM(unreadable_docs)", "SUM(total_docs)"),
    },
    "doc_match": {
        "document_count": N,
        "match_rate_pct": pct(n_if("match_class = 'match'"), N),
        "avg_match_weight": mean("match_weight", 4, 4),
        "high_risk_pct": pct(n_if("doc_risk_tier LIKE 'High%'"), N),
        "extraction_completeness_pct": pct(n_if("NOT missing_dob AND NOT missing_ssn4"), N),
        "non_match_count": n_if("match_class = 'non_match'"),
    },
    "call_quality": {
        "total_calls": N,
        "avg_call_score": mean("call_score", 1),
        "compliance_rate_pct": pct(n_if("outcome_bucket = 'compliant'"), N),
        "high_risk_pct": pct(n_if("outcome_bucket = 'high_risk'"), N),
        "escalation_count": n_if("disposition = 'escalated'"),
        "escalation_rate_pct": pct(n_if("disposition = 'escalated'"), N),
    },
    "prior_auth": {
        "pa_volume": big("SUM(total_decisions)"),
        "approval_rate_pct": pct("SUM(approved)", "SUM(approved + denied + partial)"),
        "denial_rate_pct": pct("SUM(denied)", "SUM(approved + denied + partial)"),
        "sla_compliance_pct": pct("SUM(within_sla_count)", "SUM(total_decisions)"),
        "avg_days_to_decision": mean("avg_days_to_decision", 2, 2),
    },
    "payer_volume": {
        "documents": big("SUM(total_documents)"),
        "pa_volume": big("SUM(total_pa_decisions)"),
        "pa_approval_rate_pct": mean("pa_approval_rate_pct", 2, 2),
    },
    "call_ops": {
        "total_calls": big("SUM(total_calls)"),
        "avg_wait_seconds": mean("avg_wait_seconds", 0),
        "avg_handle_seconds": mean("avg_handle_seconds", 0),
        "fcr_pct": pct("SUM(fcr_resolved_count)", "SUM(total_calls)"),
    },
}
SOURCE = {
    "doc_intake": "v_intake_payer",
    "doc_match": "v_match",
    "call_quality": "calls",
    "prior_auth": "v_pa",
    "payer_volume": "v_mix",
    "call_ops": "v_ops",
}


def metric(view: str, dims: list[str], picks: dict[str, str] | list[str] | None = None, where: str = "",
           having: str = "", source: str | None = None) -> str:
    names = picks if picks is not None else list(MEASURES[view])
    pairs = names.items() if isinstance(names, dict) else [(m, m) for m in names]
    cols = ", ".join([*dims, *[f"{MEASURES[view][m]} AS {a}" for m, a in pairs]])
    text = f"SELECT {cols} FROM {source or SOURCE[view]}"
    if where:
        text += f" WHERE {where}"
    if dims:
        text += " GROUP BY " + ", ".join(dims)
    return f"SELECT * FROM ({text}) q WHERE {having}" if having else text


METRICS = {
    "metric_doc_intake": metric("doc_intake", ["is_volume_spike"]),
    "metric_doc_intake_global": metric("doc_intake", ["is_volume_spike"], source="v_intake"),
    "metric_doc_intake_by_date": metric("doc_intake", ["intake_date"]),
    "metric_doc_match_by_type": metric("doc_match", ["document_type"]),
    "metric_doc_match_by_channel_tier": metric("doc_match", ["source_channel", "doc_risk_tier"]),
    "metric_doc_match_total": metric("doc_match", []),
    "metric_call_quality_by_agency": metric("call_quality", ["agency_name"]),
    "metric_call_quality_by_type_bucket": metric("call_quality", ["call_type", "outcome_bucket"]),
    "metric_prior_auth_by_payer": metric("prior_auth", ["payer_code", "urgency"]),
    "metric_prior_auth_by_date": metric("prior_auth", ["decision_date"]),
    "metric_payer_volume_by_type": metric("payer_volume", ["payer_type"]),
    "metric_call_ops_by_agency_type": metric("call_ops", ["agency_name", "call_type"]),
    "metric_call_ops_by_date": metric("call_ops", ["ops_date"]),
}


def recent(col: str, table: str, days: int, source_col: str | None = None) -> str:
    return f"{col} >= (SELECT max({source_col or col}) FROM {table}) - {days}"


AGENTS = f"SELECT agent_name, agency_name, {mean('call_score', 1)} AS avg_score, {N} AS "
NEGATIVE = n_if("sentiment_overall = 'negative'")
BOTH = "calls c JOIN sent s ON c.call_id = s.call_id"

QUESTIONS = {
    "q01_urgent_sla": metric("prior_auth", ["decision_date", "payer_code"], {"sla_compliance_pct": "sla_pct"},
                             "urgency = 'urgent'")
    + " ORDER BY decision_date DESC, payer_code ASC NULLS FIRST LIMIT 30",
    "q02_payer_approval": metric(
        "prior_auth", ["payer_code"], {"approval_rate_pct": "approval_pct", "sla_compliance_pct": "sla_pct"}
    ),
    "q03_intake_trend": "SELECT intake_date, total_docs, rolling_7d_avg, rolling_30d_avg, is_volume_spike"
    f" FROM v_intake WHERE {recent('intake_date', 'v_intake', 30)}",
    "q04_payer_mix": "SELECT payer_code, total_documents, total_pa_decisions, pa_approval_rate_pct FROM v_mix",
    "q05_degradation_days": "SELECT parse_date, pct_unreadable, rolling_7d_unreadable_pct, unreadable_trend_3d"
    " FROM v_quality WHERE dq_degradation_flag",
    "q06_auth_trend": "SELECT match_date, match_class, candidate_count, prev_week_count, wow_change_pct,"
    f" daily_class_share FROM v_auth WHERE {recent('match_date', 'v_auth', 14)}",
    "q07_match_rate": metric("doc_match", [], ["match_rate_pct"]),
    "q08_urgent_sla_by_payer": metric(
        "prior_auth", ["payer_code"], {"sla_compliance_pct": "sla_pct"}, "urgency = 'urgent'"
    ),
    "q09_docs_last_week": f"SELECT {big('SUM(total_docs)')} AS docs_last_7_days FROM v_intake"
    f" WHERE {recent('intake_date', 'v_intake', 7)}",
    "q21_high_risk_declining": "SELECT c.call_id, c.agent_name, c.call_score, c.disposition, s.sentiment_overall,"
    f" s.sentiment_trajectory, s.summary_text FROM {BOTH}"
    " WHERE c.outcome_bucket = 'high_risk' AND s.sentiment_trajectory = 'declining'",
    "q22_streaks_above_3": "SELECT agency_name, call_type, day, compliance_rate, days_below_threshold FROM v_comp"
    " WHERE days_below_threshold > 3",
    "q22b_streaks_from_3": "SELECT agency_name, call_type, day, days_below_threshold FROM v_comp"
    " WHERE days_below_threshold >= 3",
    "q23_low_fcr": metric("call_ops", ["agency_name"], {"fcr_pct": "fcr"}, having="fcr < 70"),
    "q24_aht_by_type": metric(
        "call_ops", ["ops_date", "call_type"], {"avg_handle_seconds": "aht_sec"}, recent("ops_date", "v_ops", 14)
    ),
    "q25_agency_ops": metric(
        "call_ops", ["agency_name"],
        {"fcr_pct": "fcr", "avg_handle_seconds": "aht_sec", "avg_wait_seconds": "asa_sec"},
    ),
    "q26_bottom_agents": AGENTS + "calls FROM calls GROUP BY 1, 2 ORDER BY avg_score, agent_name, agency_name LIMIT 10",
    "q26b_bottom_agents_20": AGENTS + "n_calls FROM calls GROUP BY 1, 2 HAVING COUNT(*) >= 20"
    " ORDER BY avg_score, agent_name, agency_name LIMIT 10",
    "q27_escalated_sentiment": f"SELECT s.sentiment_overall, s.sentiment_trajectory, {N} AS call_count"
    f" FROM {BOTH} WHERE c.disposition = 'escalated' GROUP BY 1, 2",
    "q28_agency_ranking": "SELECT agency_name, day, compliance_rate, rolling_7d_compliance, agency_compliance_rank"
    f" FROM v_comp WHERE {recent('day', 'comp', 7)}",
    "q29_declining_by_type": f"SELECT call_type, sentiment_start, sentiment_end, {N} AS n FROM sent"
    " WHERE sentiment_trajectory = 'declining' GROUP BY 1, 2, 3"
    " ORDER BY n DESC, call_type, sentiment_start, sentiment_end LIMIT 20",
    "q30_escalation_type_sentiment": f"SELECT sentiment_overall, {N} AS n FROM sent"
    " WHERE call_type ILIKE '%escal%' GROUP BY 1",
    "q31_low_compliance_month": "SELECT agency_name,"
    f" {half_up(f'SUM({digits_of("compliance_rate")})', 'CAST(COUNT(*) AS HUGEINT) * 1000000000000000000', 2, 100)}"
    " AS avg_compliance_pct FROM comp WHERE day >= date_trunc('month', (SELECT max(day) FROM comp))"
    " GROUP BY 1 HAVING AVG(compliance_rate) < 0.85",
    "q32_top_ranked_rows": "SELECT agent_name, agent_avg_score, agent_call_count FROM v_calls"
    " WHERE agent_call_count >= 20 QUALIFY RANK() OVER (ORDER BY agent_avg_score DESC) <= 10",
    "q33_top_agents": AGENTS + "n_calls FROM calls GROUP BY 1, 2 HAVING COUNT(*) >= 20"
    " ORDER BY avg_score DESC, agent_name, agency_name LIMIT 10",
    "q34_fcr_by_agency": metric("call_ops", ["agency_name"], {"fcr_pct": "fcr"}),
    "q35_aht_by_agency": metric("call_ops", ["agency_name"], {"avg_handle_seconds": "aht_sec"}),
    "q36_compliance_by_day": metric(
        "call_quality", ["scored_date"], {"compliance_rate_pct": "comp_pct"}, recent("scored_date", "calls", 14)
    ),
    "q37_agents_trending_down": "SELECT agent_name, agent_rolling_5_avg, agent_avg_score, agent_call_count"
    " FROM v_calls JOIN (SELECT call_id, row_number() OVER (PARTITION BY agent_name"
    " ORDER BY minute_no DESC, call_id DESC) AS k FROM calls) USING (call_id)"
    " WHERE k = 1 AND agent_rolling_5_avg < agent_avg_score",
    "q38_high_risk_markers": f"SELECT marker, {N} AS n FROM (SELECT unnest(s.emotional_markers) AS marker"
    f" FROM {BOTH} WHERE c.outcome_bucket = 'high_risk') GROUP BY 1",
    "q39_declining_complaints": "SELECT c.call_id, c.agent_name, c.agency_name, c.call_type, c.call_score,"
    f" s.sentiment_start, s.sentiment_end FROM {BOTH}"
    " WHERE s.sentiment_trajectory = 'declining' AND c.disposition = 'complaint'",
    "s01_tier_breakdown": metric("doc_match", ["doc_risk_tier"], ["document_count", "match_rate_pct"]),
    "s02_worst_match_by_type": metric("doc_match", ["document_type"], ["document_count", "match_rate_pct"]),
    "s03_fax_vs_electronic": metric(
        "doc_match", ["source_channel"],
        ["document_count", "match_rate_pct", "avg_match_weight", "extraction_completeness_pct"],
        "source_channel IN ('fax', 'electronic')",
    ),
    "s04_docs_without_anchors": "SELECT doc_id, payer_code, document_type, source_channel, intake_date, match_class"
    " FROM v_match WHERE doc_risk_tier = 'High Risk - No Anchors'",
    "s05_spikes_this_week": "SELECT intake_date, total_docs, rolling_7d_avg, is_volume_spike FROM v_intake"
    f" WHERE {recent('intake_date', 'v_intake', 7)}",
    "s06_docs_yesterday": f"SELECT {N} AS docs_yesterday FROM docs WHERE intake = (SELECT max(intake) FROM docs) - 1",
    "s07_pa_time_by_payer": metric("prior_auth", ["payer_code"], ["pa_volume", "avg_days_to_decision"]),
    "s08_sla_by_urgency": metric("prior_auth", ["urgency"], ["pa_volume", "sla_compliance_pct", "denial_rate_pct"]),
    "s09_aht_variation": metric("call_ops", ["call_type"], ["total_calls", "avg_handle_seconds", "avg_wait_seconds"]),
    "s10_top_agents_by_agency": "SELECT agency_name, agent_name, max(agent_rank_in_agency) AS agent_rank_in_agency,"
    f" {N} AS calls FROM v_calls WHERE agent_rank_in_agency <= 3 GROUP BY 1, 2",
    "s11_negative_by_type": f"SELECT call_type, {NEGATIVE}"
    f" AS negative_calls, {pct(NEGATIVE, N)} AS negative_pct"
    " FROM sent GROUP BY 1",
    "s12_asa_trend": metric("call_ops", ["ops_date"], {"avg_wait_seconds": "asa_sec"}, recent("ops_date", "v_ops", 30)),
    "s13_fcr_this_week": metric("call_ops", [], {"fcr_pct": "fcr", "total_calls": "calls"}, recent("ops_date", "v_ops", 7)),
    "s14_score_by_agency": metric(
        "call_quality", ["agency_name"], ["total_calls", "avg_call_score", "high_risk_pct", "escalation_rate_pct"]
    ),
    "s15_compliance_30_days": metric(
        "call_quality", ["scored_date"], ["compliance_rate_pct", "high_risk_pct", "escalation_count"],
        recent("scored_date", "calls", 30),
    ),
    "x01_spike_then_calls": "SELECT i.intake_date, i.total_docs, i.is_volume_spike, q.dq_degradation_flag,"
    " e.scored_date, e.total_calls, e.avg_call_score FROM v_intake i LEFT JOIN v_quality q"
    " ON q.parse_date = i.intake_date LEFT JOIN ("
    + metric("call_quality", ["scored_date"], ["total_calls", "avg_call_score"])
    + ") e ON e.scored_date = i.intake_date + 1"
    " WHERE i.is_volume_spike OR COALESCE(q.dq_degradation_flag, false)",
}

BATCH = "p.mrm_batch_id"

PATTERN_FIELDS = ("name", "dob", "ssn4")
THERE = " + ".join(f"CASE WHEN d.{f} IS NOT NULL THEN {1 << i} ELSE 0 END" for i, f in enumerate(PATTERN_FIELDS))
AGREED = " + ".join(f"CASE WHEN d.{f} = t.{f} THEN {1 << i} ELSE 0 END" for i, f in enumerate(PATTERN_FIELDS))

def estimated(rounds: int = 1_000, tolerance: float = 1e-14) -> str:
    """Expectation maximisation over the pattern counts, one recursion step per round.

    A step also holds the log likelihoods of the two steps before it; when they hardly differ, the one before counts.
    """
    k = range(len(PATTERN_FIELDS))

    def product(first: str, p: str) -> str:
        terms = [
            f"CASE WHEN there & {1 << i} = 0 THEN 1.0 WHEN agreed & {1 << i} <> 0 THEN {p}{i} ELSE 1 - {p}{i} END"
            for i in k
        ]
        return " * ".join([first, *terms])

    def share(weight: str, i: int) -> str:
        bit = 1 << i
        hit = f"SUM(CASE WHEN there & {bit} <> 0 AND agreed & {bit} <> 0 THEN {weight} ELSE 0.0::DOUBLE END)"
        there = f"SUM(CASE WHEN there & {bit} <> 0 THEN {weight} ELSE 0.0::DOUBLE END)"
        return f"least(greatest({hit} / {there}, 1e-9), 1 - 1e-9)"

    columns = ", ".join(f"m{i}, u{i}" for i in k)
    settled = f"coalesce(ll1 - ll2 <= {tolerance} * abs(ll1), false)"
    start = ", ".join("0.9::DOUBLE, 0.05::DOUBLE" for _ in k)
    update = ", ".join(f"{share('n * g', i)}, {share('n * (1 - g)', i)}" for i in k)
    fields = " UNION ALL ".join(
        f"SELECT '{f}' AS field, round(m{i}, 4) AS m, round(u{i}, 4) AS u, x1 - x2 <= {tolerance} * abs(x1) AS converged"
        f" FROM em, last WHERE step = newest - 1"
        for i, f in enumerate(PATTERN_FIELDS)
    )
    return f"""SELECT * FROM (WITH RECURSIVE
      counts AS MATERIALIZED (SELECT {THERE} AS there, {AGREED} AS agreed, CAST(COUNT(*) AS DOUBLE) AS n
        FROM m_docs d CROSS JOIN m_targets t GROUP BY 1, 2),
      em(step, lambda_, ll1, ll2, {columns}) AS (SELECT 0, 1e-3::DOUBLE, NULL::DOUBLE, NULL::DOUBLE, {start}
        UNION ALL
        SELECT step + 1, least(greatest(SUM(n * g) / SUM(n), 1e-12), 1 - 1e-12), fsum(n * ln(pm + pu)), any_value(ll1), {update}
        FROM (SELECT *, pm / (pm + pu) AS g FROM (SELECT *, {product("lambda_", "m")} AS pm,
            {product("(1 - lambda_)", "u")} AS pu FROM em, counts WHERE step <= {rounds} AND NOT {settled}))
        GROUP BY step),
      last AS (SELECT step AS newest, ll1 AS x1, ll2 AS x2 FROM em ORDER BY step DESC LIMIT 1)
      {fields})"""


STAGES = {
    "link_estimate_mu": estimated(),
    "stage_parse_docs": "SELECT doc_id, unreadable_flag, page_count_detected, parse_error_status,"
    " intake AS ingest_day, payer_code FROM parsed",
    "stage_extract_fields": "SELECT doc_id, member_id_on_form, auth_id, name_on_form,"
    " CAST(dob_on_form AS VARCHAR) AS dob_extracted, ssn4_on_form AS ssn4_extracted, service_date_on_form,"
    " missing_dob, missing_ssn4, payer_code, intake AS extraction_day FROM structured",
    "link_member_candidates": "SELECT * FROM mcand",
    "link_auth_candidates": "SELECT * FROM acand",
    "link_best_candidate": """
      SELECT * FROM (
        SELECT doc_id, candidate_member_id, total_weight, match_class, run_day FROM mcand
        UNION ALL
        SELECT doc_id, member_id, w, CASE WHEN w > 8 THEN 'match' WHEN w > 3 THEN 'possible_match'
          ELSE 'non_match' END, run_day
        FROM (SELECT doc_id, member_id, total_weight AS w, CAST(run_ts AS DATE) AS run_day FROM m_best_anchors))
        q(doc_id, candidate_member_id, total_weight, match_class, run_day)
      QUALIFY row_number() OVER (PARTITION BY doc_id
        ORDER BY total_weight DESC, candidate_member_id, match_class) = 1""",
    "link_match_events": "SELECT event_id, doc_id, event_type, matched_entity_id, confidence, run_day AS event_day"
    " FROM v_events",
    "link_class_counts": f"SELECT match_class, {N} AS n FROM mcand GROUP BY 1",
    "link_agreement_patterns": f"SELECT CAST({THERE} AS INTEGER) AS there, CAST({AGREED} AS INTEGER) AS agreed,"
    f" {N} AS pairs FROM m_docs d CROSS JOIN m_targets t GROUP BY 1, 2",
    "kpi_row": "SELECT * FROM v_kpi_row",
    "rollup_compliance": "SELECT * FROM comp",
    "quality_by_batch": f"""SELECT {BATCH} AS batch_id, {N} AS total_docs,
      {pct(n_if("p.unreadable_flag"), N)} AS pct_unreadable, {pct(n_if("s.missing_dob"), N)} AS pct_missing_dob,
      {pct(n_if("s.missing_ssn4"), N)} AS pct_missing_ssn4,
      {n_if("p.parse_error_status IS NOT NULL")} AS parse_errors,
      {pct(n_if("m.match_class = 'match'"), "COUNT(m.match_class)")} AS pct_match,
      {pct(n_if("m.match_class = 'possible_match'"), "COUNT(m.match_class)")} AS pct_possible_match,
      {pct(n_if("m.match_class = 'non_match'"), "COUNT(m.match_class)")} AS pct_non_match
      FROM parsed p LEFT JOIN structured s ON s.doc_id = p.doc_id LEFT JOIN mcand m ON m.doc_id = p.doc_id
      GROUP BY 1""",
    "call_score_bands": "SELECT agency_name, CASE WHEN call_score >= 90 THEN 'Excellent' WHEN call_score >= 75"
    f" THEN 'Good' WHEN call_score >= 60 THEN 'Needs Coaching' ELSE 'At Risk' END AS band, {N} AS calls"
    " FROM calls GROUP BY 1, 2",
    "document_batches": f"SELECT mrm_batch_id, {N} AS docs, min(auth_id) AS first_auth, max(page_count) AS pages"
    " FROM docs GROUP BY 1",
}

HASHED_DOCS = abs_hash(
    abs_hash(abs_hash("SELECT doc_id FROM docs", "h", "doc_id", 15), "h_hour", "doc_id || 'h'", 16),
    "h_min", "doc_id || 'm'", 16,
)
STAGE_NAMES = {
    "clinical_document": "docs",
    "clinical_doc_parsed": "parsed",
    "clinical_doc_structured": "structured",
    "doc_member_match_candidates": "mcand",
    "doc_auth_match_candidates": "acand",
}
TABLES = {
    "table_append_missing": "SELECT call_id, CASE WHEN fcr_flag THEN 0 ELSE wait_seconds END"
    " AS wait_seconds, handle_seconds, fcr_flag FROM ops",
    "table_update_where": """SELECT auth_id, status,
      CASE WHEN decided IS NOT NULL AND status <> 'Cancelled' THEN decided + CAST(100 - greatest(0, decided - requested) AS INTEGER)
        ELSE requested END AS auth_requested_date,
      CASE WHEN status <> 'Cancelled' THEN decided + 100 ELSE decided END AS auth_decision_date FROM auths""",
    "table_merge_update": """SELECT p.doc_id, p.parse_error_status,
      CASE WHEN p.unreadable_flag AND p.payer_code IS NOT NULL THEN p.payer_code
        ELSE lower(d.payer_code) END AS payer_code
      FROM parsed p LEFT JOIN docs d ON d.doc_id = p.doc_id""",
    "table_ensure_columns": "SELECT doc_id, payer_code, CAST(NULL AS VARCHAR) AS urgency FROM docs",
    "table_partition_merge": f"SELECT intake AS day, {N} AS docs,"
    f" {n_if('payer_code IS NOT NULL AND intake > (SELECT max(intake) FROM docs) - 3')} AS lowered,"
    " intake > (SELECT max(intake) FROM docs) - 3 AS rewritten FROM docs GROUP BY 1",
    "backfill_payer": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, "
        "CASE WHEN t.payer_code IS NULL THEN d.hashed ELSE t.payer_code END"
        + f" AS payer_code, {N} AS rows FROM {cte} t JOIN (SELECT doc_id AS id, {nth(PAYERS, 'h % 5')} AS hashed"
        f" FROM ({HASHED_DOCS})) d ON d.id = t.doc_id GROUP BY 1, 2"
        for name, cte in STAGE_NAMES.items()
    ),
    "backfill_urgency": "SELECT CASE WHEN h % 10 < 3 THEN 'urgent' ELSE 'standard' END AS urgency,"
    f" {N} AS rows FROM ({abs_hash('SELECT auth_id FROM auths', 'h', 'auth_id', 16)}) GROUP BY 1",
    "backfill_call_timings": f"""SELECT call_id,
      CASE WHEN fcr_flag THEN wait_seconds ELSE 60 + hw % 540 END AS wait_seconds,
      CASE WHEN fcr_flag THEN handle_seconds ELSE 180 + hh2 % 1620 END AS handle_seconds,
      CASE WHEN fcr_flag THEN fcr_flag ELSE hf % 100 < 70 END AS fcr_flag
      FROM ({abs_hash(abs_hash(abs_hash("SELECT * FROM ops", "hw", "call_id || 'wait'", 20),
                               "hh2", "call_id || 'handle'", 22), "hf", "call_id || 'fcr'", 19)})""",
    "overlay_call_ts": "SELECT call_id, DATE '2024-06-30' - CAST(h % 30 AS INTEGER) AS call_day"
    f" FROM ({abs_hash('SELECT call_id FROM ops', 'h', 'call_id', 16)})",
    "spread_documents": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, CASE WHEN {day} = DATE '2024-01-10' THEN"
        f" CAST(CAST(DATE '2024-06-30' - CAST(h % 90 AS INTEGER) AS TIMESTAMP)"
        f" + to_minutes(h_hour % 24 * 60 + h_min % 60 + {lag}) AS DATE) ELSE {day} END AS day, {N} AS rows"
        f" FROM {cte} t JOIN (SELECT doc_id AS id, h, h_hour, h_min FROM ({HASHED_DOCS})) d ON d.id = t.doc_id"
        " GROUP BY 1, 2"
        for name, cte, day, lag in (
            ("clinical_document", "docs", "intake", 0),
            ("clinical_doc_parsed", "parsed", "intake", 5),
            ("clinical_doc_structured", "structured", "intake", 15),
            ("doc_member_match_candidates", "mcand", "run_day", 30),
            ("doc_auth_match_candidates", "acand", "run_day", 30),
        )
    ),
    "shift_decisions": "SELECT payer_code, urgency, CAST(decided - requested AS BIGINT) AS gap_days,"
    " CASE WHEN decided < DATE '2024-06-30' - 89 THEN DATE '2024-06-30' - CAST(h % 90 AS INTEGER)"
    f" ELSE decided END AS decision_day, {N} AS decisions"
    f" FROM ({abs_hash('SELECT * FROM auths WHERE decided IS NOT NULL', 'h', 'auth_id', 16)}) GROUP BY 1, 2, 3, 4",
}

SEEN = "payer_code IS NULL OR payer_code IN ('NORTHWAVE', 'METRIDIAN')"


def orphan(table: str, col: str, parent: str, key: str, name: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, '{col}' AS column_name, {N} AS total_rows,"
        f" {n_if(f'c.{col} IS NULL')} AS null_refs,"
        f" {n_if(f'c.{col} IS NOT NULL AND p.k IS NULL')} AS orphan_rows"
        f" FROM {table} c LEFT JOIN (SELECT DISTINCT {key} AS k FROM {parent}) p ON c.{col} = p.k"
    )


def keyed(table: str, col: str, name: str) -> str:
    return (
        f"SELECT '{name}' AS table_name, '{col}' AS key_columns, {big('SUM(n)')} AS total_rows,"
        f" {big(f'SUM(CASE WHEN {col} IS NULL THEN n ELSE 0 END)')} AS null_keys,"
        f" {n_if(f'{col} IS NOT NULL AND n > 1')} AS duplicate_keys"
        f" FROM (SELECT {col}, count(*) AS n FROM {table} GROUP BY 1)"
    )


GOVERNANCE = {
    "grants_for_seen_payers": "SELECT 'all@example.org' AS user_email, payer_code AS payer_id FROM payers"
    " UNION SELECT 'two@example.org', payer_code FROM payers WHERE payer_code IN ('NORTHWAVE', 'METRIDIAN')"
    " UNION SELECT 'two@example.org', payer_code FROM docs WHERE payer_code IS NOT NULL",
    "key_report": " UNION ALL ".join(
        [
            keyed("docs", "member_id", "clinical_document_member"),
            keyed("docs", "doc_id", "clinical_document"),
            keyed("auths", "auth_id", "authorization"),
            keyed("payers", "payer_code", "payer_dim"),
        ]
    ),
    "reference_report": " UNION ALL ".join(
        [
            orphan("docs", "payer_code", "payers", "payer_code", "clinical_document"),
            orphan("auths", "payer_code", "payers", "payer_code", "authorization"),
            orphan("mcand", "doc_id", "docs", "doc_id", "doc_member_match_candidates"),
            orphan("acand", "doc_id", "docs", "doc_id", "doc_auth_match_candidates"),
            orphan("docs", "auth_id", "structured", "auth_id", "clinical_document"),
        ]
    ),
}


def only(body: str, cond: str) -> str:
    """``body`` over the payer tables cut to the rows that meet ``cond``."""
    return sql(body, seen=cond)


FILTERED = {
    "row_filter_intake": ("SELECT * FROM v_intake", SEEN),
    "row_filter_match_ranked": ("SELECT * FROM v_match_ranked", SEEN),
    "row_filter_payer_mix_all": ("SELECT * FROM v_mix", "true"),
    "row_filter_payer_mix_none": ("SELECT * FROM v_mix", "payer_code IS NULL"),
    "row_filter_decisions": ("SELECT * FROM v_pa", SEEN),
}

FILTER_COUNTS = {
    "urgent_decisions": ("v_pa", "urgency = 'urgent'"),
    "standard_decisions": ("v_pa", "urgency = 'standard'"),
    "degradation_days": ("v_quality", "dq_degradation_flag"),
    "matches": ("v_match", "match_class = 'match'"),
    "non_matches": ("v_match", "match_class = 'non_match'"),
    "fax_only": ("v_match", "source_channel = 'fax'"),
    "high_risk_documents": ("v_match", "doc_risk_tier = 'High Risk - No Anchors'"),
    "spike_days": ("v_intake", "is_volume_spike"),
    "commercial_payers": ("v_mix", "payer_type = 'commercial'"),
    "compliant_calls": ("v_calls", "outcome_bucket = 'compliant'"),
    "high_risk_calls": ("v_calls", "outcome_bucket = 'high_risk'"),
    "escalated_calls": ("v_calls", "disposition = 'escalated'"),
    "enough_calls": ("v_calls", "agent_call_count >= 20"),
    "declining_sentiment": ("sent", "sentiment_trajectory = 'declining'"),
    "systemic_compliance": ("v_comp", "days_below_threshold > 3"),
}
RECENT_COUNTS = {
    "decisions_30_days": ("v_pa", "decision_date >= DATE '2024-03-20' - 30"),
    "intake_7_days": ("v_intake", "intake_date >= DATE '2024-03-20' - 7"),
    "call_ops_14_days": ("v_ops", "ops_date >= DATE '2024-03-20' - 14"),
}
DIMENSION_COLUMNS = {
    "risk_tier": ("v_match", "doc_risk_tier"),
    "match_class": ("v_match", "match_class"),
    "document_type": ("v_match", "document_type"),
    "source_channel": ("v_match", "source_channel"),
    "intake_date": ("v_intake", "intake_date"),
    "scored_date": ("v_calls", "scored_date"),
    "agent": ("v_calls", "agent_name"),
    "call_type": ("v_calls", "call_type"),
    "agency": ("v_calls", "agency_name"),
    "sentiment": ("sent", "sentiment_overall"),
}
MEASURE_SQL = {
    "match_rate_pct": ("v_match", pct(n_if("match_class = 'match'"), N)),
    "high_risk_document_pct": ("v_match", pct(n_if("doc_risk_tier = 'High Risk - No Anchors'"), N)),
    "avg_weight": ("v_match", mean("match_weight", 2, 4)),
    "avg_ocr_quality": ("v_intake", mean("avg_quality_score", 3, 3)),
    "extraction_complete_pct": ("v_match", pct(n_if("NOT missing_dob AND NOT missing_ssn4"), N)),
    "documents_received": ("v_intake", "SUM(total_docs)"),
    "escalations": ("v_calls", n_if("disposition = 'escalated'")),
    "avg_call_score": ("v_calls", mean("call_score", 1)),
    "high_risk_calls": ("v_calls", n_if("outcome_bucket = 'high_risk'")),
    "compliance_rate_pct": ("v_calls", pct(n_if("outcome_bucket = 'compliant'"), N)),
    "longest_streak": ("v_comp", "MAX(days_below_threshold)"),
}


def listed(items: dict[str, tuple[str, str]], form: str, kind: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{name}' AS name, CAST({form.format(x)} AS {kind}) AS value FROM {view}"
        for name, (view, x) in items.items()
    )


SNIPPETS = {
    "snippet_filters": listed(FILTER_COUNTS, "COUNT(*) FILTER ({})", "BIGINT"),
    "snippet_recent": listed(RECENT_COUNTS, "COUNT(*) FILTER ({})", "BIGINT"),
    "snippet_dimensions": listed(DIMENSION_COLUMNS, "COUNT(DISTINCT {})", "BIGINT"),
    "snippet_measures": listed(MEASURE_SQL, "{}", "DOUBLE"),
}

INTAKE_COLUMNS = (
    "total_docs, prior_auth_forms, clinical_notes, lab_results, imaging_reports, discharge_summaries,"
    " unreadable_docs, {q}via_fax, via_electronic, via_upload, via_mail"
)
STREAMS = {
    "stream_intake": f"SELECT intake_date, payer_code, {INTAKE_COLUMNS.format(q='avg_quality_score, ')}"
    " FROM v_intake_payer",
    "stream_intake_windows": f"SELECT intake_date, {INTAKE_COLUMNS.format(q='')} FROM v_intake",
    "stream_quality": "SELECT * FROM v_quality",
    "stream_cascade": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, t.doc_id, d.payer_code,"
        f" CAST(floor(epoch(d.ingested)) AS BIGINT) + {lag} * 60 AS stage_second FROM {cte} t JOIN docs d ON d.doc_id = t.doc_id"
        for name, cte, lag in (
            ("clinical_doc_parsed", "parsed", 5),
            ("clinical_doc_structured", "structured", 15),
            ("doc_member_match_candidates", "mcand", 30),
            ("doc_auth_match_candidates", "acand", 30),
        )
    ),
}


def all_sql() -> dict[str, str]:
    plain = {
        **VIEWS, **METRICS, **{f"question_{k}": v for k, v in QUESTIONS.items()}, **STAGES, **TABLES,
        **GOVERNANCE, **SNIPPETS, **STREAMS,
    }
    out = {name: sql(body) for name, body in plain.items()}
    out.update({name: only(body, cond) for name, (body, cond) in FILTERED.items()})
    return out
