"""Curated views, each a function of the table registry.

Two of them exist in a global and a per-payer form under their own names:
``intake_daily`` / ``intake_daily_by_payer`` and ``match_detail_ranked`` /
``match_detail_by_payer``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions import exprs as X
from caselight.functions.exact import fixed, mean_exact, mean_int, mean_of, n_where, pct, ratio, shown
from caselight.operators import ranks as R
from caselight.operators import windows as Wd
from caselight.operators.ranks import null_safe
from caselight.plans.comments import view_comments
from caselight.session import materialize
from caselight.sources.registry import Registry
from caselight.sources.tables import register_view, with_comments


DOC_TYPE_COLUMNS = {
    "prior_auth_forms": "prior_auth_form",
    "clinical_notes": "clinical_note",
    "lab_results": "lab_result",
    "imaging_reports": "imaging_report",
    "discharge_summaries": "discharge_summary",
}
CHANNEL_COLUMNS = {"via_fax": "fax", "via_electronic": "electronic", "via_upload": "upload", "via_mail": "mail"}


def _rows() -> Column:
    return F.count(F.lit(1))


def intake_measures() -> list[Column]:
    """Counts per type and channel, and mean quality, of a group of documents."""
    return [
        _rows().alias("total_docs"),
        *[n_where(F.col("document_type") == v).alias(k) for k, v in DOC_TYPE_COLUMNS.items()],
        n_where(F.col("is_readable") == F.lit(False)).alias("unreadable_docs"),
        mean_exact(F.col("quality_score"), 3).alias("avg_quality_score"),
        *[n_where(F.col("source_channel") == v).alias(k) for k, v in CHANNEL_COLUMNS.items()],
    ]


def _spike(keys: list[str]) -> Column:
    total, n = Wd.trailing_sum(F.col("total_docs"), 7, keys, ["intake_date"])
    return X.above_multiple(F.col("total_docs"), total, n, 2)


def intake_days(docs: DataFrame) -> DataFrame:
    """Documents per day with day-over-day change, rolling means and spike flag."""
    base = docs.groupBy(X.day(F.col("ingestion_timestamp")).alias("intake_date")).agg(*intake_measures())
    # One row per calendar day, so a single window task is enough.
    by_day: list[str] = []
    order = ["intake_date"]
    return base.select(
        "*",
        Wd.lag_rows("total_docs", 1, by_day, order).alias("prev_day_total"),
        Wd.change("total_docs", 1, by_day, order).alias("day_over_day_change"),
        Wd.change_pct("total_docs", 1, by_day, order).alias("day_over_day_pct"),
        Wd.trailing_mean("total_docs", 7, by_day, order, 1).alias("rolling_7d_avg"),
        Wd.trailing_mean("total_docs", 30, by_day, order, 1).alias("rolling_30d_avg"),
        Wd.running_total("total_docs", by_day, order).alias("cumulative_docs"),
        _spike(by_day).alias("is_volume_spike"),
    )


def intake_daily(reg: Registry) -> DataFrame:
    return intake_days(reg.table("clinical_document"))


def intake_daily_by_payer(reg: Registry) -> DataFrame:
    """Documents per day and payer; rolling means and spikes stay within a payer."""
    base = (
        reg.table("clinical_document")
        .groupBy(X.day(F.col("ingestion_timestamp")).alias("intake_date"), "payer_code")
        .agg(*intake_measures())
    )
    keys, order = ["payer_code"], ["intake_date"]
    return base.select(
        "*",
        Wd.trailing_mean("total_docs", 7, keys, order, 1).alias("rolling_7d_avg"),
        Wd.trailing_mean("total_docs", 30, keys, order, 1).alias("rolling_30d_avg"),
        _spike(keys).alias("is_volume_spike"),
    )


def match_detail_by_payer(reg: Registry) -> DataFrame:
    """Candidate rows with document attributes, risk tier and extraction flags."""
    m = reg.table("doc_member_match_candidates").select("doc_id", "match_class", "total_weight")
    p = reg.table("clinical_doc_parsed").select("doc_id", "unreadable_flag")
    s = reg.table("clinical_doc_structured").select(
        "doc_id", "missing_dob", "missing_ssn4", "auth_id", "member_id_on_form"
    )
    d = reg.table("clinical_document").select(
        "doc_id", "payer_code", "document_type", "source_channel", "ingestion_timestamp"
    )
    joined = m.join(p, "doc_id", "left").join(s, "doc_id", "left").join(d, "doc_id", "left")
    return joined.select(
        "doc_id",
        "payer_code",
        "document_type",
        "source_channel",
        X.day(F.col("ingestion_timestamp")).alias("intake_date"),
        "match_class",
        F.col("total_weight").alias("match_weight"),
        X.risk_tier(F.col("unreadable_flag"), F.col("missing_dob"), F.col("missing_ssn4")).alias(
            "doc_risk_tier"
        ),
        "unreadable_flag",
        X.coalesce_true(F.col("missing_dob")).alias("missing_dob"),
        X.coalesce_true(F.col("missing_ssn4")).alias("missing_ssn4"),
        X.present(F.col("auth_id")).alias("has_auth_id"),
        X.present(F.col("member_id_on_form")).alias("has_member_id"),
    )


def match_detail_ranked(reg: Registry, cells_per_task: int = R.CELLS_PER_TASK) -> DataFrame:
    """Candidate rows with their rank, percentile and context within type and channel.

    Ranks come from row counts per distinct (type, channel, day, weight), a
    table that stays small because weights are sums of a few fixed terms.  It
    is written once, and each lookup derived from it is broadcast back only after
    its rows have been counted.
    """
    detail = match_detail_by_payer(reg).drop("payer_code")
    m = reg.table("doc_member_match_candidates").select("doc_id", F.col("total_weight").alias("match_weight"))
    d = reg.table("clinical_document").select(
        "doc_id", "document_type", "source_channel", X.day(F.col("ingestion_timestamp")).alias("intake_date")
    )
    cube = materialize(
        m.join(d, "doc_id", "left")
        .groupBy("document_type", "source_channel", "intake_date", "match_weight")
        .agg(_rows().alias("n"), F.try_sum(shown(F.col("match_weight"))).alias("total")),
        "match-cube",
    )
    cells = cube.count()  # bounds every table derived from it
    weight, n = F.col("match_weight"), F.col("n")
    known = F.sum(F.when(weight.isNotNull(), n).otherwise(0))
    plain = F.sum(weight * n) / F.nullif(known, F.lit(0))
    mean = mean_of(F.try_sum("total"), F.sum(F.when(shown(weight).isNotNull(), n).otherwise(0)), known, plain, 4)
    by_weight = R.value_ranks(
        cube.groupBy("document_type", "match_weight").agg(F.sum("n").alias("n")),
        ["document_type"],
        "match_weight",
        cells_per_task,
        cells,
    ).select(
        "document_type",
        "match_weight",
        R.rank_desc().alias("weight_rank_in_type"),
        R.percent_rank_asc().alias("weight_pctile_in_type"),
    )
    by_type = cube.groupBy("document_type").agg(mean.alias("type_avg_weight"))
    by_channel = cube.groupBy("source_channel").agg(mean.alias("channel_avg_weight"))
    by_day = cube.groupBy("document_type", "intake_date").agg(F.sum("n").alias("docs_same_day_type"))
    out = R.null_safe(detail, R.sized(by_weight, at_most=cells), ["document_type", "match_weight"])
    out = R.null_safe(out, R.sized(by_type, at_most=cells), ["document_type"])
    out = R.null_safe(out, R.sized(by_channel, at_most=cells), ["source_channel"])
    return R.null_safe(out, R.sized(by_day, at_most=cells), ["document_type", "intake_date"])


def auth_match_daily(reg: Registry) -> DataFrame:
    """Authorization candidates per day and class with weekly change and shares."""
    weight = F.col("total_weight")
    base = (
        reg.table("doc_auth_match_candidates")
        .groupBy(X.day(F.col("pipeline_run_ts")).alias("match_date"), "match_class")
        .agg(
            _rows().alias("candidate_count"),
            mean_exact(weight, 4).alias("avg_match_weight"),
            F.round(F.min(weight), 4).alias("min_match_weight"),
            F.round(F.max(weight), 4).alias("max_match_weight"),
        )
    )
    keys, order = ["match_class"], ["match_date"]
    return base.select(
        "*",
        Wd.lag_rows("candidate_count", 7, keys, order).alias("prev_week_count"),
        Wd.change_pct("candidate_count", 7, keys, order).alias("wow_change_pct"),
        Wd.trailing_mean("candidate_count", 7, keys, order, 1).alias("rolling_7d_avg_count"),
        Wd.running_total("candidate_count", keys, order).alias("class_running_total"),
        Wd.share("candidate_count", ["match_date"]).alias("daily_class_share"),
    )


def quality_counts() -> list[Column]:
    """Counts of a group of parsed documents joined to their extraction."""
    return [
        _rows().alias("total_docs"),
        n_where(F.col("unreadable_flag")).alias("unreadable_count"),
        n_where(F.col("missing_dob")).alias("missing_dob_count"),
        n_where(F.col("missing_ssn4")).alias("missing_ssn4_count"),
        n_where(F.col("parse_error_status").isNotNull()).alias("docs_with_parse_error"),
    ]


def quality_trend(counts: DataFrame) -> DataFrame:
    """Percentages and trend columns over daily quality counts."""
    total = F.col("total_docs")
    base = counts.select(
        "parse_date",
        "total_docs",
        "unreadable_count",
        pct(F.col("unreadable_count"), total).alias("pct_unreadable"),
        "missing_dob_count",
        pct(F.col("missing_dob_count"), total).alias("pct_missing_dob"),
        "missing_ssn4_count",
        pct(F.col("missing_ssn4_count"), total).alias("pct_missing_ssn4"),
        "docs_with_parse_error",
        F.lit(None).cast("double").alias("avg_parse_confidence"),
    )
    by_day: list[str] = []
    order = ["parse_date"]
    unread = fixed(F.col("pct_unreadable"), 2)
    total7, n7 = Wd.trailing_sum(unread, 7, by_day, order)
    change3 = Wd.change("pct_unreadable", 3, by_day, order)
    return base.select(
        "*",
        Wd.trailing_mean("pct_unreadable", 7, by_day, order, 2, exact=True).alias("rolling_7d_unreadable_pct"),
        Wd.trailing_mean("pct_missing_dob", 7, by_day, order, 2, exact=True).alias("rolling_7d_missing_dob_pct"),
        Wd.lag_rows("pct_unreadable", 1, by_day, order).alias("prev_day_unreadable_pct"),
        F.round(change3, 2).alias("unreadable_trend_3d"),
        X.above_multiple(unread, total7, n7, 3, 2).alias("dq_degradation_flag"),
    )


def data_quality_daily(reg: Registry) -> DataFrame:
    """Parsing quality per day; a NULL anchor flag counts as not missing here."""
    p = reg.table("clinical_doc_parsed").select(
        "doc_id", "unreadable_flag", "parse_error_status", X.day(F.col("ingest_ts")).alias("parse_date")
    )
    s = reg.table("clinical_doc_structured").select("doc_id", "missing_dob", "missing_ssn4")
    return quality_trend(p.join(s, "doc_id", "left").groupBy("parse_date").agg(*quality_counts()))


# Labels of the long form, in the order of the wide row.
KPI_LABELS = {
    "total_members": "Total Members",
    "total_documents": "Total Documents",
    "total_parsed": "Total Parsed",
    "unreadable_docs": "Unreadable Documents",
    "high_confidence_matches": "High Confidence Matches",
    "possible_matches": "Possible Matches",
    "non_matches": "Non Matches",
    "auth_matches": "Auth Matches",
}


def kpi_row(reg: Registry) -> DataFrame:
    """Eight counts in one row; every table is scanned once."""
    cls = F.col("match_class")
    parts = [
        reg.table("member").agg(_rows().alias("total_members")),
        reg.table("clinical_document").agg(_rows().alias("total_documents")),
        reg.table("clinical_doc_parsed").agg(
            _rows().alias("total_parsed"), n_where(F.col("unreadable_flag")).alias("unreadable_docs")
        ),
        reg.table("doc_member_match_candidates").agg(
            n_where(cls == "match").alias("high_confidence_matches"),
            n_where(cls == "possible_match").alias("possible_matches"),
            n_where(cls == "non_match").alias("non_matches"),
        ),
        reg.table("doc_auth_match_candidates").agg(n_where(cls == "match").alias("auth_matches")),
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in KPI_LABELS])


def wide_to_long(df: DataFrame, labels: dict[str, str], unit: str) -> DataFrame:
    """One (metric_name, metric_value, metric_unit) row per column of a wide row."""
    cols = [F.col(c).cast("double").alias(label) for c, label in labels.items()]
    return (
        df.select(*cols)
        .unpivot([], list(labels.values()), "metric_name", "metric_value")
        .select("metric_name", "metric_value", F.lit(unit).alias("metric_unit"))
    )


def kpi_snapshot(reg: Registry) -> DataFrame:
    return wide_to_long(kpi_row(reg), KPI_LABELS, "count")


def call_scores(reg: Registry, hot_rows: int = R.HOT_ROWS, cells_per_task: int = R.CELLS_PER_TASK) -> DataFrame:
    """Calls with agent, agency and call-type context.

    Group means, counts and ranks come from one table of row counts per
    (agent, agency, type, score).  The agent mean ignores the agency while the
    rank is taken per (agent, agency).
    """
    calls = reg.table("mv_call_scores").select(
        "call_id",
        "agent_name",
        "agency_name",
        "call_type",
        "vendor_template",
        "language",
        "disposition",
        "call_score",
        F.col("summary_of_score").alias("score_rationale"),
        "outcome_bucket",
        X.day(F.col("created_ts")).alias("scored_date"),
        "created_ts",
    )
    cube = materialize(
        reg.table("mv_call_scores")
        .groupBy("agent_name", "agency_name", "call_type", "call_score")
        .agg(_rows().alias("n")),
        "call-cube",
    )
    cells = cube.count()  # bounds every table derived from it
    points = F.sum(F.col("call_score").cast("long") * F.col("n"))
    scored = F.sum(F.when(F.col("call_score").isNotNull(), F.col("n")))
    by_agent = cube.groupBy("agent_name").agg(
        ratio(points, scored, 1).alias("agent_avg_score"), F.sum("n").alias("agent_call_count")
    )
    by_agency = cube.groupBy("agency_name").agg(ratio(points, scored, 1).alias("agency_avg_score"))
    pairs = cube.groupBy("agency_name", "agent_name").agg((points.cast("double") / scored).alias("_mean"))
    places = R.value_ranks(
        pairs.groupBy("agency_name", "_mean").agg(_rows().alias("n")), ["agency_name"], "_mean", cells_per_task, cells
    ).select("agency_name", "_mean", R.dense_rank_desc().alias("agent_rank_in_agency"))
    by_pair = R.null_safe(pairs, places, ["agency_name", "_mean"]).drop("_mean")
    by_score = R.value_ranks(
        cube.groupBy("call_type", "call_score").agg(F.sum("n").alias("n")),
        ["call_type"],
        "call_score",
        cells_per_task,
        cells,
    ).select("call_type", "call_score", R.percent_rank_asc().alias("score_pctile_in_type"))
    agent_sizes = by_agent.select("agent_name", F.col("agent_call_count").alias("n"))
    out = R.rolling_mean(
        calls, "agent_name", ["created_ts", "call_id"], "call_score", 5, 1, "agent_rolling_5_avg",
        agent_sizes, hot_rows,
    )
    out = R.null_safe(out, R.sized(by_agent, at_most=cells), ["agent_name"])
    out = R.null_safe(out, R.sized(by_pair, at_most=cells), ["agent_name", "agency_name"])
    out = R.null_safe(out, R.sized(by_score, at_most=cells), ["call_type", "call_score"])
    out = R.null_safe(out, R.sized(by_agency, at_most=cells), ["agency_name"])
    return out.select(
        "call_id",
        "agent_name",
        "agency_name",
        "call_type",
        "vendor_template",
        "language",
        "disposition",
        "call_score",
        "score_rationale",
        "outcome_bucket",
        "scored_date",
        "agent_avg_score",
        "agent_rank_in_agency",
        "agent_call_count",
        "score_pctile_in_type",
        "agency_avg_score",
        (F.col("call_score") - F.col("agency_avg_score")).alias("score_vs_agency_avg"),
        "agent_rolling_5_avg",
    )


def call_rows(reg: Registry) -> DataFrame:
    """The call-level columns of :func:`call_scores`, without its context columns."""
    return reg.table("mv_call_scores").select(
        "call_id", "agent_name", "agency_name", "call_type", "vendor_template", "language", "disposition",
        "call_score", F.col("summary_of_score").alias("score_rationale"), "outcome_bucket",
        X.day(F.col("created_ts")).alias("scored_date"),
    )


def call_sentiment(reg: Registry) -> DataFrame:
    return reg.table("gold_call_summaries_sentiment").select(
        F.col("document_id").alias("call_id"),
        "call_type",
        "summary_text",
        "sentiment_overall",
        "sentiment_start",
        "sentiment_end",
        "sentiment_trajectory",
        "key_topics",
        "emotional_markers",
    )


def explode_tags(df: DataFrame, col: str, tag: str) -> DataFrame:
    """One row per array element; rows with an empty array drop out."""
    return df.withColumn(tag, F.explode(col))


def compliance_daily(reg: Registry, mode: str = "literal") -> DataFrame:
    """Compliance per day, call type and agency with trends, ranks and streaks.

    ``agency_compliance_rank`` ranks (agency, type) rows of a day.
    """
    base = reg.table("mv_compliance_outcomes").select(
        "day", "call_type", "agency_name", "scored_calls", "avg_call_score", "compliant_calls",
        "needs_review_calls", "high_risk_calls", "high_risk_rate", "compliance_rate",
    )
    keys, order = ["agency_name", "call_type"], ["day"]
    rate = F.col("compliance_rate")
    wide = base.select(
        "*",
        Wd.trailing_mean("compliance_rate", 7, keys, order, 4, exact=True).alias("rolling_7d_compliance"),
        Wd.trailing_mean("high_risk_rate", 7, keys, order, 5, exact=True).alias("rolling_7d_high_risk"),
        Wd.lag_rows("compliance_rate", 7, keys, order).alias("prev_week_compliance"),
        F.round(
            shown(rate, "decimal(30,18)") - shown(Wd.lag_rows("compliance_rate", 7, keys, order), "decimal(30,18)"), 4
        ).cast("double").alias("wow_compliance_change"),
        Wd.rank_in(["day"], [rate.desc_nulls_last()]).alias("agency_compliance_rank"),
    )
    below = F.coalesce(rate < X.COMPLIANCE_FLOOR, F.lit(False))
    return Wd.streak(wide, keys, "day", below, "days_below_threshold", mode)


def _decided(reg: Registry) -> DataFrame:
    return reg.table("authorization").where(
        F.col("auth_decision_date").isNotNull() & F.col("auth_requested_date").isNotNull()
    )


def pa_decisions_daily(reg: Registry) -> DataFrame:
    """Decisions per day, payer and urgency; rates leave cancelled requests out."""
    days = X.days_between(F.col("auth_decision_date"), F.col("auth_requested_date"))
    status = F.col("status")
    base = _decided(reg).select(
        F.col("auth_decision_date").alias("decision_date"),
        "payer_code",
        "urgency",
        "status",
        days.alias("days"),
        X.sla_hours(F.col("urgency")).alias("target"),
    )
    rows = _rows()
    live = n_where(status != "Cancelled")
    within = n_where(X.within_sla(F.col("days"), F.col("target")))
    return base.groupBy("decision_date", "payer_code", "urgency").agg(
        rows.alias("total_decisions"),
        n_where(status == "Approved").alias("approved"),
        n_where(status == "Denied").alias("denied"),
        n_where(status == "Partial").alias("partial"),
        n_where(status == "Cancelled").alias("cancelled"),
        pct(n_where(status == "Approved"), live).alias("approval_rate_pct"),
        pct(n_where(status == "Denied"), live).alias("denial_rate_pct"),
        mean_int(F.col("days"), 2).alias("avg_days_to_decision"),
        F.max("target").alias("sla_target_hours"),
        within.alias("within_sla_count"),
        pct(within, rows).alias("sla_compliance_pct"),
    )


DOCUMENT_COUNTS = {
    "distinct": lambda: F.countDistinct("doc_id"),
    "approx": lambda: F.approx_count_distinct("doc_id"),
    "rows": _rows,
}


def payer_mix(reg: Registry, documents: str = "distinct") -> DataFrame:
    """Volume, readability and decisions per payer; approval over all decided requests.

    The exact distinct count moves every document id once.  Where the key is
    known to be unique (``governance.check_key``), ``documents="rows"`` gives
    the same number from partial counts; ``"approx"`` estimates it.
    """
    # Documents are folded per payer before they meet the dimension and the
    # decision totals, so both joins see a handful of rows.
    docs = (
        reg.table("clinical_document")
        .groupBy("payer_code")
        .agg(
            DOCUMENT_COUNTS[documents]().alias("total_documents"),
            n_where(F.col("document_type") == "prior_auth_form").alias("total_prior_auth_forms"),
            pct(n_where(F.col("is_readable") == F.lit(False)), _rows()).alias("unreadable_pct"),
        )
    )
    days = X.days_between(F.col("auth_decision_date"), F.col("auth_requested_date"))
    decided = (
        reg.table("authorization")
        .where(F.col("auth_decision_date").isNotNull())
        .groupBy("payer_code")
        .agg(
            _rows().alias("total_pa_decisions"),
            pct(n_where(F.col("status") == "Approved"), _rows()).alias("approval"),
            n_where(F.col("urgency") == "urgent").alias("urgent"),
            mean_int(days, 2).alias("days"),
        )
    )
    names = reg.table("payer_dim").select("payer_code", "payer_name", "payer_type")
    joined = docs.join(names, "payer_code", "left").join(decided, "payer_code", "left")
    return joined.select(
        "payer_code",
        "payer_name",
        "payer_type",
        "total_documents",
        "total_prior_auth_forms",
        "unreadable_pct",
        F.coalesce("total_pa_decisions", F.lit(0)).alias("total_pa_decisions"),
        F.coalesce("approval", F.lit(0.0)).alias("pa_approval_rate_pct"),
        F.coalesce("urgent", F.lit(0)).alias("pa_urgent_count"),
        F.coalesce("days", F.lit(0.0)).alias("pa_avg_days_to_decision"),
    )


def _call_ops(reg: Registry, date: Column) -> DataFrame:
    calls = reg.table("mv_call_scores").select("call_id", "agency_name", "call_type", "created_ts")
    timings = reg.table("call_ops_supplemental").select(
        "call_id", "wait_seconds", "handle_seconds", "fcr_flag", "synthetic_call_ts"
    )
    fcr = n_where(F.col("fcr_flag"))
    return (
        calls.join(timings, "call_id")
        .groupBy(X.day(date).alias("ops_date"), "agency_name", "call_type")
        .agg(
            _rows().alias("total_calls"),
            mean_int(F.col("wait_seconds"), 0).alias("avg_wait_seconds"),
            mean_int(F.col("handle_seconds"), 0).alias("avg_handle_seconds"),
            fcr.alias("fcr_resolved_count"),
            pct(fcr, _rows()).alias("fcr_pct"),
            n_where(F.col("wait_seconds") > 600).alias("abandoned_proxy_count"),
        )
    )


def call_ops_daily_by_created(reg: Registry) -> DataFrame:
    """Call timings per day of scoring, agency and type."""
    return _call_ops(reg, F.col("created_ts"))


def call_ops_daily(reg: Registry) -> DataFrame:
    """Call timings per day of the overlay call time, agency and type."""
    return _call_ops(reg, F.col("synthetic_call_ts"))


def dense_days(df: DataFrame, date: str, keys: Sequence[str], zero: Sequence[str]) -> DataFrame:
    """A daily series with its missing calendar days added, ``zero`` columns at 0.

    Row-based windows over the result count days.  The views do not use it.
    """
    span = df.groupBy(*keys).agg(F.min(date).alias("_from"), F.max(date).alias("_to"))
    calendar = span.select(*keys, F.explode(F.sequence("_from", "_to")).alias(date))
    out = null_safe(calendar, df, [*keys, date])
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in zero})


def publish_views(reg: Registry, names: Sequence[str] = ()) -> list[str]:
    """Register views (all by default) as commented temp views under the registry's prefix."""
    return [
        register_view(with_comments(VIEWS[n](reg), view_comments(n)), n, reg.prefix) for n in (names or VIEWS)
    ]


VIEWS = {
    "intake_daily": intake_daily,
    "intake_daily_by_payer": intake_daily_by_payer,
    "match_detail_ranked": match_detail_ranked,
    "match_detail_by_payer": match_detail_by_payer,
    "auth_match_daily": auth_match_daily,
    "data_quality_daily": data_quality_daily,
    "kpi_snapshot": kpi_snapshot,
    "call_scores": call_scores,
    "call_sentiment": call_sentiment,
    "compliance_daily": compliance_daily,
    "pa_decisions_daily": pa_decisions_daily,
    "payer_mix": payer_mix,
    "call_ops_daily_by_created": call_ops_daily_by_created,
    "call_ops_daily": call_ops_daily,
}
