"""Curated views as catalog views: SQL text that every query evaluates anew.

The texts give the rows of :mod:`caselight.plans.views`.  A catalog view keeps its text alone, so rows stored in
the tables after publishing count, and so do grants if the view filters by payer.  Ranks come from counts per
distinct value here too, hence no window holds the rows of a group, and an agent's rolling mean is taken block by
block of call positions, each block borrowing the calls before it.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import SparkSession

from caselight.functions import exprs as X
from caselight.plans.comments import VIEW_COMMENTS, view_comments
from caselight.plans.views import CHANNEL_COLUMNS, DOC_TYPE_COLUMNS, KPI_LABELS
from caselight.sources.registry import PAYER_TABLES
from caselight.sources.schemas import COLUMN_COMMENTS, SCHEMAS, TABLE_COMMENTS

BLOCK = 100_000  # calls of one agent that a task windows at once


def _ratio(num: str, den: str, dp: int, scale: int = 1) -> str:
    n, d, unit = f"CAST({num} AS DECIMAL(38,0))", f"nullif(CAST({den} AS DECIMAL(38,0)), CAST(0 AS DECIMAL(38,0)))", 10**dp
    whole = f"((abs({n}) * CAST({2 * scale * unit} AS BIGINT) + {d}) div ({d} * 2))"
    return f"CAST(CASE WHEN {n} < 0 THEN -{whole} ELSE {whole} END AS DOUBLE) / {float(unit)}D"


def _pct(num: str, den: str, dp: int = 2) -> str:
    return _ratio(num, den, dp, 100)


def _shown(x: str) -> str:
    return f"try_cast(CAST({x} AS DOUBLE) AS DECIMAL(38,18))"


def _mean_of(total: str, n_shown: str, n: str, plain: str, dp: int) -> str:
    found = f"CAST(round({total} / nullif({n_shown}, 0), {dp}) AS DOUBLE)"
    return f"CASE WHEN {n_shown} = {n} AND ({total} IS NOT NULL OR {n} = 0) THEN {found} ELSE round({plain}, {dp}) END"


def _mean(x: str, dp: int, over: str = "") -> str:
    d = _shown(x)
    return _mean_of(f"try_sum({d}){over}", f"count({d}){over}", f"count({x}){over}", f"avg({x}){over}", dp)


def _int_mean(x: str, dp: int, over: str = "") -> str:
    return _ratio(f"sum(CAST({x} AS BIGINT)){over}", f"count({x}){over}", dp)


def _over(order: str, keys: str = "", rows: int | None = 0) -> str:
    """Window in ``order``: plain with 0 rows, the last ``rows`` rows, or with None all rows so far."""
    by = f"PARTITION BY {keys} " if keys else ""
    start = "UNBOUNDED" if rows is None else str((rows or 1) - 1)
    frame = "" if rows == 0 else f" ROWS BETWEEN {start} PRECEDING AND CURRENT ROW"
    return f" OVER ({by}ORDER BY {order}{frame})"


def _lag(col: str, n: int, order: str, keys: str = "") -> str:
    return f"lag({col}, {n}){_over(order, keys)}"


def _before(keys: str, order: str) -> str:
    """Rows of the distinct values before this one."""
    frame = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    return f"coalesce(sum(n) OVER (PARTITION BY {keys} ORDER BY {order} {frame}), 0)"


def _columns(names: Mapping[str, str], source: str) -> str:
    return ", ".join(f"count_if({source} = '{v}') AS {k}" for k, v in names.items())


def _intake(keys: str = "") -> str:
    group = f", {keys}" if keys else ""
    seven = _over("intake_date", keys, 7)
    base = f"""SELECT to_date(ingestion_timestamp) AS intake_date{group}, count(*) AS total_docs,
        {_columns(DOC_TYPE_COLUMNS, "document_type")}, count_if(is_readable = false) AS unreadable_docs,
        {_mean("quality_score", 3)} AS avg_quality_score, {_columns(CHANNEL_COLUMNS, "source_channel")}
      FROM clinical_document GROUP BY to_date(ingestion_timestamp){group}"""
    before = _lag("total_docs", 1, "intake_date")
    global_only = f"""{before} AS prev_day_total, total_docs - {before} AS day_over_day_change,
      {_pct(f"(total_docs - {before})", before)} AS day_over_day_pct,"""
    running = f"sum(total_docs){_over('intake_date', '', None)} AS cumulative_docs,"
    return f"""SELECT *, {"" if keys else global_only}
      {_int_mean("total_docs", 1, seven)} AS rolling_7d_avg,
      {_int_mean("total_docs", 1, _over("intake_date", keys, 30))} AS rolling_30d_avg, {"" if keys else running}
      total_docs * count(total_docs){seven} > sum(total_docs){seven} * 2 AS is_volume_spike
    FROM ({base})"""


_NO_DOB, _NO_SSN4 = "coalesce(s.missing_dob, true)", "coalesce(s.missing_ssn4, true)"
_DETAIL = f"""SELECT m.doc_id, d.payer_code, d.document_type, d.source_channel,
    to_date(d.ingestion_timestamp) AS intake_date, m.match_class, m.total_weight AS match_weight,
    CASE WHEN p.unreadable_flag THEN '{X.TIER_UNREADABLE}' WHEN {_NO_DOB} AND {_NO_SSN4} THEN '{X.TIER_NONE}'
      WHEN {_NO_DOB} OR {_NO_SSN4} THEN '{X.TIER_ONE}' ELSE '{X.TIER_BOTH}' END AS doc_risk_tier,
    p.unreadable_flag, {_NO_DOB} AS missing_dob, {_NO_SSN4} AS missing_ssn4,
    s.auth_id IS NOT NULL AS has_auth_id, s.member_id_on_form IS NOT NULL AS has_member_id
  FROM doc_member_match_candidates m LEFT JOIN clinical_doc_parsed p ON p.doc_id = m.doc_id
    LEFT JOIN clinical_doc_structured s ON s.doc_id = m.doc_id LEFT JOIN clinical_document d ON d.doc_id = m.doc_id"""


def _weight_mean(key: str, name: str) -> str:
    known = "sum(CASE WHEN match_weight IS NULL THEN 0 ELSE n END)"
    shown = f"sum(CASE WHEN {_shown('match_weight')} IS NULL THEN 0 ELSE n END)"
    mean = _mean_of("try_sum(total)", shown, known, f"sum(match_weight * n) / nullif({known}, 0)", 4)
    return f"SELECT {key}, {mean} AS {name} FROM cells GROUP BY {key}"


def _ranked() -> str:
    total = "sum(n) OVER (PARTITION BY document_type)"
    below = _before("document_type", "match_weight")
    return f"""WITH detail AS ({_DETAIL}),
      cells AS (SELECT document_type, source_channel, intake_date, match_weight, count(*) AS n,
        try_sum({_shown("match_weight")}) AS total FROM detail GROUP BY ALL),
      weights AS (SELECT document_type, match_weight, sum(n) AS n FROM cells GROUP BY ALL),
      ranks AS (SELECT document_type, match_weight, {_before("document_type", "match_weight DESC")} + 1 AS place,
        CASE WHEN {total} <= 1 THEN 0D ELSE {_ratio(below, f"({total} - 1)", 4)} END AS share FROM weights),
      types AS ({_weight_mean("document_type", "mean")}), channels AS ({_weight_mean("source_channel", "mean")}),
      days AS (SELECT document_type, intake_date, sum(n) AS n FROM cells GROUP BY ALL)
    SELECT d.* EXCEPT (payer_code), r.place AS weight_rank_in_type, r.share AS weight_pctile_in_type,
      t.mean AS type_avg_weight, c.mean AS channel_avg_weight, y.n AS docs_same_day_type
    FROM detail d LEFT JOIN ranks r ON r.document_type <=> d.document_type AND r.match_weight <=> d.match_weight
      LEFT JOIN types t ON t.document_type <=> d.document_type
      LEFT JOIN channels c ON c.source_channel <=> d.source_channel
      LEFT JOIN days y ON y.document_type <=> d.document_type AND y.intake_date <=> d.intake_date"""


def _auth() -> str:
    order, key = "match_date", "match_class"
    week = _lag("candidate_count", 7, order, key)
    return f"""SELECT *, {week} AS prev_week_count,
      {_pct(f"(candidate_count - {week})", week)} AS wow_change_pct,
      {_int_mean("candidate_count", 1, _over(order, key, 7))} AS rolling_7d_avg_count,
      sum(candidate_count){_over(order, key, None)} AS class_running_total,
      {_pct("candidate_count", "sum(candidate_count) OVER (PARTITION BY match_date)")} AS daily_class_share
    FROM (SELECT to_date(pipeline_run_ts) AS match_date, match_class, count(*) AS candidate_count,
        {_mean("total_weight", 4)} AS avg_match_weight, round(min(total_weight), 4) AS min_match_weight,
        round(max(total_weight), 4) AS max_match_weight
      FROM doc_auth_match_candidates GROUP BY to_date(pipeline_run_ts), match_class)"""


def _quality() -> str:
    seven, whole = _over("parse_date", "", 7), "floor(pct_unreadable * 100D + 0.5D)"
    return f"""WITH counts AS (SELECT to_date(p.ingest_ts) AS parse_date, count(*) AS total_docs,
        count_if(p.unreadable_flag) AS unreadable_count, count_if(s.missing_dob) AS missing_dob_count,
        count_if(s.missing_ssn4) AS missing_ssn4_count,
        count_if(p.parse_error_status IS NOT NULL) AS docs_with_parse_error
      FROM clinical_doc_parsed p LEFT JOIN clinical_doc_structured s ON s.doc_id = p.doc_id
      GROUP BY to_date(p.ingest_ts)),
    days AS (SELECT parse_date, total_docs, unreadable_count,
        {_pct("unreadable_count", "total_docs")} AS pct_unreadable, missing_dob_count,
        {_pct("missing_dob_count", "total_docs")} AS pct_missing_dob, missing_ssn4_count,
        {_pct("missing_ssn4_count", "total_docs")} AS pct_missing_ssn4, docs_with_parse_error,
        CAST(NULL AS DOUBLE) AS avg_parse_confidence FROM counts)
    SELECT *, {_mean("pct_unreadable", 2, seven)} AS rolling_7d_unreadable_pct,
      {_mean("pct_missing_dob", 2, seven)} AS rolling_7d_missing_dob_pct,
      {_lag("pct_unreadable", 1, "parse_date")} AS prev_day_unreadable_pct,
      round(pct_unreadable - {_lag("pct_unreadable", 3, "parse_date")}, 2) AS unreadable_trend_3d,
      {whole} * count({whole}){seven} * 2 > sum({whole}){seven} * 3 AS dq_degradation_flag
    FROM days"""


def _kpi() -> str:
    """Counts of each table in one scan, then as rows."""
    counts = {
        "member": {"total_members": "count(*)"},
        "clinical_document": {"total_documents": "count(*)"},
        "clinical_doc_parsed": {"total_parsed": "count(*)", "unreadable_docs": "count_if(unreadable_flag)"},
        "doc_member_match_candidates": {
            "high_confidence_matches": "count_if(match_class = 'match')",
            "possible_matches": "count_if(match_class = 'possible_match')",
            "non_matches": "count_if(match_class = 'non_match')",
        },
        "doc_auth_match_candidates": {"auth_matches": "count_if(match_class = 'match')"},
    }
    parts = []
    for table, cols in counts.items():
        cells = ", ".join(f"'{KPI_LABELS[c]}', CAST({c} AS DOUBLE)" for c in cols)
        inner = ", ".join(f"{expr} AS {c}" for c, expr in cols.items())
        parts.append(f"SELECT stack({len(cols)}, {cells}) AS (metric_name, metric_value) FROM (SELECT {inner} FROM {table})")
    return f"SELECT metric_name, metric_value, 'count' AS metric_unit FROM ({' UNION ALL '.join(parts)})"


def _calls() -> str:
    mean, total = "CAST(sum(call_score * n) AS DOUBLE) / sum(CASE WHEN call_score IS NOT NULL THEN n END)", "sum(n) OVER (PARTITION BY call_type)"
    points = _ratio("sum(call_score * n)", "sum(CASE WHEN call_score IS NOT NULL THEN n END)", 1)
    five = _over("created_ts, call_id", "agent_name, block", 5)
    return f"""WITH cells AS (SELECT agent_name, agency_name, call_type, CAST(call_score AS BIGINT) AS call_score,
        count(*) AS n FROM mv_call_scores GROUP BY ALL),
      agents AS (SELECT agent_name, {points} AS mean, sum(n) AS n FROM cells GROUP BY agent_name),
      agencies AS (SELECT agency_name, {points} AS mean FROM cells GROUP BY agency_name),
      pairs AS (SELECT agency_name, agent_name, dense_rank() OVER (PARTITION BY agency_name ORDER BY mean DESC) AS place
        FROM (SELECT agency_name, agent_name, {mean} AS mean FROM cells GROUP BY agency_name, agent_name)),
      shares AS (SELECT call_type, call_score,
          CASE WHEN {total} <= 1 THEN 0D ELSE {_ratio(_before("call_type", "call_score"), f"({total} - 1)", 4)} END AS share
        FROM (SELECT call_type, call_score, sum(n) AS n FROM cells GROUP BY call_type, call_score)),
      starts AS (SELECT agent_name, day, {_before("agent_name", "day")} AS start
        FROM (SELECT agent_name, to_date(created_ts) AS day, count(*) AS n FROM mv_call_scores GROUP BY ALL)),
      placed AS (SELECT c.*, s.start - 1
          + row_number() OVER (PARTITION BY c.agent_name, to_date(c.created_ts) ORDER BY c.created_ts, c.call_id) AS at
        FROM mv_call_scores c JOIN starts s ON s.agent_name <=> c.agent_name AND s.day <=> to_date(c.created_ts)),
      dealt AS (SELECT *, explode(array_distinct(array(at div {BLOCK}, (at + 4) div {BLOCK}))) AS block FROM placed),
      rolled AS (SELECT *, {_int_mean("call_score", 1, five)} AS rolling FROM dealt)
    SELECT c.call_id, c.agent_name, c.agency_name, c.call_type, c.vendor_template, c.language, c.disposition,
      c.call_score, c.summary_of_score AS score_rationale, c.outcome_bucket, to_date(c.created_ts) AS scored_date,
      a.mean AS agent_avg_score, CAST(p.place AS BIGINT) AS agent_rank_in_agency, a.n AS agent_call_count,
      s.share AS score_pctile_in_type, g.mean AS agency_avg_score, c.call_score - g.mean AS score_vs_agency_avg,
      c.rolling AS agent_rolling_5_avg
    FROM rolled c LEFT JOIN agents a ON a.agent_name <=> c.agent_name
      LEFT JOIN agencies g ON g.agency_name <=> c.agency_name
      LEFT JOIN pairs p ON p.agency_name <=> c.agency_name AND p.agent_name <=> c.agent_name
      LEFT JOIN shares s ON s.call_type <=> c.call_type AND s.call_score <=> CAST(c.call_score AS BIGINT)
    WHERE c.block = c.at div {BLOCK}"""


_SENTIMENT = """SELECT document_id AS call_id, call_type, summary_text, sentiment_overall, sentiment_start,
    sentiment_end, sentiment_trajectory, key_topics, emotional_markers FROM gold_call_summaries_sentiment"""


def _compliance() -> str:
    keys, so_far = "agency_name, call_type", _over("day", "agency_name, call_type", None)
    week = _lag("compliance_rate", 7, "day", keys)
    bad = f"coalesce(compliance_rate < {X.COMPLIANCE_FLOOR}D, false)"
    part = "DECIMAL(30,18)"
    return f"""WITH numbered AS (SELECT day, call_type, agency_name, scored_calls, avg_call_score, compliant_calls,
        needs_review_calls, high_risk_calls, high_risk_rate, compliance_rate,
        CAST(row_number(){_over("day", keys)} AS BIGINT) AS at FROM mv_compliance_outcomes),
      runs AS (SELECT *, max(CASE WHEN NOT {bad} THEN at END){so_far} AS good FROM numbered)
    SELECT * EXCEPT (at, good), {_mean("compliance_rate", 4, _over("day", keys, 7))} AS rolling_7d_compliance,
      {_mean("high_risk_rate", 5, _over("day", keys, 7))} AS rolling_7d_high_risk, {week} AS prev_week_compliance,
      CAST(round(try_cast(compliance_rate AS {part}) - try_cast({week} AS {part}), 4) AS DOUBLE) AS wow_compliance_change,
      CAST(rank() OVER (PARTITION BY day ORDER BY compliance_rate DESC) AS BIGINT) AS agency_compliance_rank,
      CASE WHEN {bad} THEN at - coalesce(good, 1) + 1 ELSE 0 END AS days_below_threshold
    FROM runs"""


def _decisions() -> str:
    within = "count_if(coalesce(days * 24 <= target, false))"
    target = " ".join(f"WHEN '{k}' THEN {v}" for k, v in X.SLA_HOURS.items())
    states = {"approved": "Approved", "denied": "Denied", "partial": "Partial", "cancelled": "Cancelled"}
    live = "count_if(status <> 'Cancelled')"
    return f"""SELECT decision_date, payer_code, urgency, count(*) AS total_decisions, {_columns(states, "status")},
      {_pct("count_if(status = 'Approved')", live)} AS approval_rate_pct,
      {_pct("count_if(status = 'Denied')", live)} AS denial_rate_pct,
      {_int_mean("days", 2)} AS avg_days_to_decision, max(target) AS sla_target_hours,
      {within} AS within_sla_count, {_pct(within, "count(*)")} AS sla_compliance_pct
    FROM (SELECT auth_decision_date AS decision_date, payer_code, urgency, status,
        datediff(auth_decision_date, auth_requested_date) AS days, CASE urgency {target} END AS target
      FROM authorization WHERE auth_decision_date IS NOT NULL AND auth_requested_date IS NOT NULL)
    GROUP BY decision_date, payer_code, urgency"""


def _mix() -> str:
    days = "datediff(auth_decision_date, auth_requested_date)"
    return f"""SELECT d.payer_code, p.payer_name, p.payer_type, d.total_documents, d.total_prior_auth_forms,
      d.unreadable_pct, coalesce(a.n, 0) AS total_pa_decisions, coalesce(a.rate, 0D) AS pa_approval_rate_pct,
      coalesce(a.urgent, 0) AS pa_urgent_count, coalesce(a.days, 0D) AS pa_avg_days_to_decision
    FROM (SELECT payer_code, count(DISTINCT doc_id) AS total_documents,
        count_if(document_type = 'prior_auth_form') AS total_prior_auth_forms,
        {_pct("count_if(is_readable = false)", "count(*)")} AS unreadable_pct
      FROM clinical_document GROUP BY payer_code) d
    LEFT JOIN payer_dim p ON p.payer_code = d.payer_code
    LEFT JOIN (SELECT payer_code, count(*) AS n, {_pct("count_if(status = 'Approved')", "count(*)")} AS rate,
        count_if(urgency = 'urgent') AS urgent, {_int_mean(days, 2)} AS days
      FROM authorization WHERE auth_decision_date IS NOT NULL GROUP BY payer_code) a ON a.payer_code = d.payer_code"""


def _call_ops(date: str) -> str:
    return f"""SELECT to_date({date}) AS ops_date, c.agency_name, c.call_type, count(*) AS total_calls,
      {_int_mean("o.wait_seconds", 0)} AS avg_wait_seconds, {_int_mean("o.handle_seconds", 0)} AS avg_handle_seconds,
      count_if(o.fcr_flag) AS fcr_resolved_count, {_pct("count_if(o.fcr_flag)", "count(*)")} AS fcr_pct,
      count_if(o.wait_seconds > 600) AS abandoned_proxy_count
    FROM mv_call_scores c JOIN call_ops_supplemental o ON o.call_id = c.call_id
    GROUP BY to_date({date}), c.agency_name, c.call_type"""


TEXTS: dict[str, str] = {
    "intake_daily": _intake(),
    "intake_daily_by_payer": _intake("payer_code"),
    "match_detail_ranked": _ranked(),
    "match_detail_by_payer": _DETAIL,
    "auth_match_daily": _auth(),
    "data_quality_daily": _quality(),
    "kpi_snapshot": _kpi(),
    "call_scores": _calls(),
    "call_sentiment": _SENTIMENT,
    "compliance_daily": _compliance(),
    "pa_decisions_daily": _decisions(),
    "payer_mix": _mix(),
    "call_ops_daily_by_created": _call_ops("c.created_ts"),
    "call_ops_daily": _call_ops("o.synthetic_call_ts"),
}


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def view_sql(name: str, database: str, user: str | None = None) -> str:
    """Text of a view over the tables of ``database``, as ``user`` may see them: an SQL expression for the user's
    address such as ``current_user()``, or None for no filter.

    Rows without a payer are seen by everyone, as in :func:`caselight.operators.governance.visible`.
    """
    body = TEXTS[name]
    used = sorted(set(re.findall(r"[a-z_][a-z_0-9]*", body)) & set(SCHEMAS))
    sources = []
    for table in used:
        rows = f"SELECT t.* FROM {database}.{table} t"
        if user is not None and table in PAYER_TABLES:
            rows += (
                f" WHERE t.payer_code IS NULL OR EXISTS (SELECT 1 FROM {database}.payer_access_mapping g"
                f" WHERE g.user_email = {user} AND g.payer_id = t.payer_code)"
            )
        sources.append(f"{table} AS ({rows})")
    return f"WITH {', '.join(sources)} SELECT * FROM ({body})"


def create_views(
    spark: SparkSession, database: str = "default", prefix: str = "", names: Sequence[str] = (), user: str | None = None
) -> list[str]:
    """Create the views (all by default) in ``database``, whose tables they read, each with its own and its columns' comments."""
    made = []
    for name in names or TEXTS:
        text, comments = view_sql(name, database, user), view_comments(name)
        columns = ", ".join(
            f"{c} COMMENT {_quoted(comments[c])}" if c in comments else c for c in spark.sql(text).columns
        )
        full = f"{database}.{prefix}{name}"
        spark.sql(f"CREATE OR REPLACE VIEW {full} ({columns}) COMMENT {_quoted(VIEW_COMMENTS[name])} AS {text}")
        made.append(full)
    return made


def comment_tables(spark: SparkSession, database: str = "default") -> list[str]:
    """Put the documented comments on those tables of ``database`` that exist, and on their columns."""
    done = []
    for table, text in TABLE_COMMENTS.items():
        full = f"{database}.{table}"
        if not spark.catalog.tableExists(full):
            continue
        spark.sql(f"COMMENT ON TABLE {full} IS {_quoted(text)}")
        have = set(spark.table(full).columns)
        for col, about in COLUMN_COMMENTS.get(table, {}).items():
            if col in have:
                spark.sql(f"ALTER TABLE {full} ALTER COLUMN {col} COMMENT {_quoted(about)}")
        done.append(full)
    return done
