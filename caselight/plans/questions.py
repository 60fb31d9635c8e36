"""Curated questions over the views and metric views.

"Last n days" counts back from ``as_of``; by default the newest date of the
view asked, so results do not depend on the wall clock.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.functions.exact import mean_int, n_where, pct, shown
from caselight.functions.exprs import month_to_date, since
from caselight.operators.ranks import top_ranked
from caselight.plans import metrics as M
from caselight.plans import views as V
from caselight.plans.snippets import FILTERS
from caselight.sources.registry import Registry


def newest(df: DataFrame, col: str, as_of: date | None) -> Column:
    """Reporting date: given, or the newest date found.

    A literal either way, so that date filters reach the scan.
    """
    return F.lit(as_of if as_of is not None else df.agg(F.max(col)).first()[0]).cast("date")


def _recent_intake(reg: Registry, as_of: date | None, days: int, look_back: int) -> DataFrame:
    """Intake days of the last ``days`` days, read with just enough older days.

    Window columns look back over at most ``look_back`` rows, so documents
    before the ``look_back - 1`` newest earlier days cannot matter.  Both
    dates come from a scan of the timestamp alone.
    """
    docs = reg.table("clinical_document")
    seen = docs.select(F.to_date("ingestion_timestamp").alias("d"))
    start = F.date_sub(newest(seen, "d", as_of), days)
    older = seen.where(F.col("d") < start).distinct().orderBy(F.col("d").desc()).limit(look_back - 1)
    first = F.coalesce(F.lit(older.agg(F.min("d")).first()[0]).cast("date"), start)
    kept = docs.where(F.to_date("ingestion_timestamp") >= first)
    return V.intake_days(kept).where(F.col("intake_date") >= start)


def _is(name: str) -> Column:
    return FILTERS[name][1]()


def _calls_newest(reg: Registry, as_of: date | None) -> Column:
    """Newest overlay call date, read off the narrow timings table."""
    timings = reg.table("call_ops_supplemental")
    return newest(timings.select(F.to_date("synthetic_call_ts").alias("d")), "d", as_of)


# Documents and authorizations ----------------------------------------------


def q01_urgent_sla(reg, as_of=None):
    return M.prior_auth(reg).query(
        ["decision_date", "payer_code"],
        {"sla_compliance_pct": "sla_pct"},
        where=_is("urgent_decisions"),
        order=[F.col("decision_date").desc(), F.col("payer_code").asc_nulls_first()],
        limit=30,
    )


def q02_payer_approval(reg, as_of=None):
    return M.prior_auth(reg).query(
        ["payer_code"],
        {"approval_rate_pct": "approval_pct", "sla_compliance_pct": "sla_pct"},
        order=[F.col("approval_pct").desc_nulls_last(), F.col("payer_code").asc_nulls_first()],
    )


def q03_intake_trend(reg, as_of=None):
    return (
        _recent_intake(reg, as_of, 30, 30)
        .select("intake_date", "total_docs", "rolling_7d_avg", "rolling_30d_avg", "is_volume_spike")
        .orderBy("intake_date")
    )


def q04_payer_mix(reg, as_of=None):
    return (
        V.payer_mix(reg)
        .select("payer_code", "total_documents", "total_pa_decisions", "pa_approval_rate_pct")
        .orderBy(F.col("total_documents").desc(), F.col("payer_code").asc_nulls_first())
    )


def q05_degradation_days(reg, as_of=None):
    return (
        V.data_quality_daily(reg)
        .where(_is("degradation_days"))
        .select("parse_date", "pct_unreadable", "rolling_7d_unreadable_pct", "unreadable_trend_3d")
        .orderBy(F.col("parse_date").desc())
    )


def q06_auth_trend(reg, as_of=None):
    days = V.auth_match_daily(reg)
    cutoff = newest(
        reg.table("doc_auth_match_candidates").select(F.to_date("pipeline_run_ts").alias("d")), "d", as_of
    )
    return (
        days.where(since(F.col("match_date"), cutoff, 14))
        .select(
            "match_date", "match_class", "candidate_count", "prev_week_count", "wow_change_pct",
            "daily_class_share",
        )
        .orderBy("match_date", "match_class")
    )


def q07_match_rate(reg, as_of=None):
    return M.doc_match(reg).query([], ["match_rate_pct"])


def q08_urgent_sla_by_payer(reg, as_of=None):
    return M.prior_auth(reg).query(
        ["payer_code"],
        {"sla_compliance_pct": "sla_pct"},
        where=_is("urgent_decisions"),
        order=[F.col("sla_pct").asc_nulls_first(), F.col("payer_code").asc_nulls_first()],
    )


def q09_docs_last_week(reg, as_of=None):
    docs = reg.table("clinical_document").select(F.to_date("ingestion_timestamp").alias("intake_date"))
    return docs.where(since(F.col("intake_date"), newest(docs, "intake_date", as_of), 7)).agg(
        F.count(F.lit(1)).alias("docs_last_7_days")
    )


# Calls ----------------------------------------------------------------------


def _scored_with_sentiment(reg: Registry) -> DataFrame:
    sentiment = V.call_sentiment(reg).drop("call_type")
    return V.call_rows(reg).join(sentiment, "call_id")


def q21_high_risk_declining(reg, as_of=None):
    return (
        _scored_with_sentiment(reg)
        .where(_is("high_risk_calls") & _is("declining_sentiment"))
        .select(
            "call_id", "agent_name", "call_score", "disposition", "sentiment_overall",
            "sentiment_trajectory", "summary_text",
        )
        .orderBy("call_score", "call_id")
    )


def _streaks(reg: Registry, cond: Column) -> DataFrame:
    return (
        V.compliance_daily(reg)
        .where(cond)
        .orderBy(F.col("days_below_threshold").desc(), F.col("day").desc(), "agency_name", "call_type")
    )


def q22_streaks_above_3(reg, as_of=None):
    return _streaks(reg, _is("systemic_compliance")).select(
        "agency_name", "call_type", "day", "compliance_rate", "days_below_threshold"
    )


def q22b_streaks_from_3(reg, as_of=None):
    return _streaks(reg, F.col("days_below_threshold") >= 3).select(
        "agency_name", "call_type", "day", "days_below_threshold"
    )


def q23_low_fcr(reg, as_of=None):
    return M.call_ops(reg).query(
        ["agency_name"],
        {"fcr_pct": "fcr"},
        having=F.col("fcr") < 70,
        order=[F.col("fcr").asc(), F.col("agency_name")],
    )


def q24_aht_by_type(reg, as_of=None):
    return M.call_ops(reg).query(
        ["ops_date", "call_type"],
        {"avg_handle_seconds": "aht_sec"},
        where=since(F.col("ops_date"), _calls_newest(reg, as_of), 14),
        order=[F.col("ops_date").desc(), F.col("aht_sec").desc(), F.col("call_type")],
    )


def q25_agency_ops(reg, as_of=None):
    return M.call_ops(reg).query(
        ["agency_name"],
        {"fcr_pct": "fcr", "avg_handle_seconds": "aht_sec", "avg_wait_seconds": "asa_sec"},
        order=[F.col("fcr").desc(), F.col("agency_name")],
    )


def _agents(reg: Registry, n_name: str) -> DataFrame:
    return V.call_rows(reg).groupBy("agent_name", "agency_name").agg(
        mean_int(F.col("call_score"), 1).alias("avg_score"), F.count(F.lit(1)).alias(n_name)
    )


def _ends(df: DataFrame, score: Column, k: int = 10) -> DataFrame:
    return df.orderBy(score, "agent_name", "agency_name").limit(k)


def q26_bottom_agents(reg, as_of=None):
    return _ends(_agents(reg, "calls"), F.col("avg_score").asc_nulls_first())


def q26b_bottom_agents_20(reg, as_of=None):
    """Ordered on the rounded mean, names breaking ties."""
    return _ends(_agents(reg, "n_calls").where(F.col("n_calls") >= 20), F.col("avg_score").asc_nulls_first())


def q27_escalated_sentiment(reg, as_of=None):
    return (
        _scored_with_sentiment(reg)
        .where(_is("escalated_calls"))
        .groupBy("sentiment_overall", "sentiment_trajectory")
        .agg(F.count(F.lit(1)).alias("call_count"))
        .orderBy(F.col("call_count").desc(), "sentiment_overall", "sentiment_trajectory")
    )


def q28_agency_ranking(reg, as_of=None):
    days = V.compliance_daily(reg)
    cutoff = newest(reg.table("mv_compliance_outcomes"), "day", as_of)
    return (
        days.where(since(F.col("day"), cutoff, 7))
        .select("agency_name", "day", "compliance_rate", "rolling_7d_compliance", "agency_compliance_rank")
        .orderBy(F.col("day").desc(), "agency_compliance_rank", "agency_name")
    )


def q29_declining_by_type(reg, as_of=None):
    return (
        V.call_sentiment(reg)
        .where(_is("declining_sentiment"))
        .groupBy("call_type", "sentiment_start", "sentiment_end")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "call_type", "sentiment_start", "sentiment_end")
        .limit(20)
    )


def q30_escalation_type_sentiment(reg, as_of=None):
    """Literal form: no call type holds "escal", so it is empty; see q27."""
    return (
        V.call_sentiment(reg)
        .where(F.col("call_type").ilike("%escal%"))
        .groupBy("sentiment_overall")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "sentiment_overall")
    )


def q31_low_compliance_month(reg, as_of=None):
    table = reg.table("mv_compliance_outcomes")
    # Four decimals of the rate are two of the percentage; the floor is held against the unrounded mean.
    rate = F.col("compliance_rate")
    digits = shown(rate)
    mean = F.when(F.count(digits) == F.count(rate), F.try_sum(digits) / F.nullif(F.count(digits), F.lit(0)))
    return (
        table.where(month_to_date(F.col("day"), newest(table, "day", as_of)))
        .groupBy("agency_name")
        .agg(mean.alias("_mean"))
        .where(F.col("_mean") < F.lit("0.85").cast("decimal(2,2)"))
        .select("agency_name", (F.round("_mean", 4).cast("decimal(10,4)") * 100).cast("double").alias("avg_compliance_pct"))
        .orderBy("avg_compliance_pct", "agency_name")
    )


def _agent_rows(reg: Registry) -> tuple[DataFrame, DataFrame]:
    """Call rows with the agent's mean and count, and row counts per mean."""
    agents = V.call_rows(reg).groupBy("agent_name").agg(
        mean_int(F.col("call_score"), 1).alias("agent_avg_score"),
        F.count(F.lit(1)).alias("agent_call_count"),
    )
    cells = agents.where(_is("enough_calls")).groupBy("agent_avg_score").agg(
        F.sum("agent_call_count").alias("n")
    )
    return agents, cells


def q32_top_ranked_rows(reg, as_of=None):
    """Literal form: RANK runs over call rows, so the best agents repeat per call."""
    agents, cells = _agent_rows(reg)
    best = top_ranked(agents.where(_is("enough_calls")), "agent_avg_score", 10, cells)
    calls = V.call_rows(reg).select("agent_name", "call_id")
    # The call id lets the sort cut a large agent over several ranges.
    return (
        calls.join(best, "agent_name")
        .orderBy("rk", "agent_name", "call_id")
        .select("agent_name", "agent_avg_score", "agent_call_count")
    )


def q33_top_agents(reg, as_of=None):
    return _ends(_agents(reg, "n_calls").where(F.col("n_calls") >= 20), F.col("avg_score").desc_nulls_last())


def q34_fcr_by_agency(reg, as_of=None):
    return M.call_ops(reg).query(
        ["agency_name"], {"fcr_pct": "fcr"}, order=[F.col("fcr").desc(), F.col("agency_name")]
    )


def q35_aht_by_agency(reg, as_of=None):
    return M.call_ops(reg).query(
        ["agency_name"],
        {"avg_handle_seconds": "aht_sec"},
        order=[F.col("aht_sec").desc(), F.col("agency_name")],
    )


def q36_compliance_by_day(reg, as_of=None):
    view = M.call_quality(reg)
    return view.query(
        ["scored_date"],
        {"compliance_rate_pct": "comp_pct"},
        where=since(F.col("scored_date"), newest(view.source, "scored_date", as_of), 14),
        order=[F.col("scored_date").desc()],
    )


def q37_agents_trending_down(reg, as_of=None):
    """Agents whose last five calls average below their overall mean.

    Only the five newest calls of an agent are needed, so every task keeps at
    most five rows per agent before the shuffle.
    """
    calls = reg.table("mv_call_scores").select("agent_name", "created_ts", "call_id", "call_score")
    newest_first = W.partitionBy("agent_name").orderBy(F.col("created_ts").desc(), F.col("call_id").desc())
    last = (
        calls.withColumn("_k", F.row_number().over(newest_first))
        .where(F.col("_k") <= 5)
        .groupBy("agent_name")
        .agg(mean_int(F.col("call_score"), 1).alias("agent_rolling_5_avg"))
    )
    agents, _ = _agent_rows(reg)
    return (
        last.join(agents, "agent_name")
        .where(F.col("agent_rolling_5_avg") < F.col("agent_avg_score"))
        .select("agent_name", "agent_rolling_5_avg", "agent_avg_score", "agent_call_count")
        .orderBy("agent_name")
    )


def q38_high_risk_markers(reg, as_of=None):
    calls = _scored_with_sentiment(reg).where(_is("high_risk_calls"))
    return (
        V.explode_tags(calls.select("emotional_markers"), "emotional_markers", "marker")
        .groupBy("marker")
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.col("n").desc(), "marker")
    )


def q39_declining_complaints(reg, as_of=None):
    return (
        _scored_with_sentiment(reg)
        .where(_is("declining_sentiment") & (F.col("disposition") == "complaint"))
        .select("call_id", "agent_name", "agency_name", "call_type", "call_score", "sentiment_start", "sentiment_end")
        .orderBy("call_id")
    )


# Sample questions without golden text ------------------------------------------


def s01_tier_breakdown(reg, as_of=None):
    return M.doc_match(reg).query(
        ["doc_risk_tier"], ["document_count", "match_rate_pct"], order=[F.col("doc_risk_tier")]
    )


def s02_worst_match_by_type(reg, as_of=None):
    return M.doc_match(reg).query(
        ["document_type"], ["document_count", "match_rate_pct"],
        order=[F.col("match_rate_pct").asc(), F.col("document_type")],
    )


def s03_fax_vs_electronic(reg, as_of=None):
    return M.doc_match(reg).query(
        ["source_channel"],
        ["document_count", "match_rate_pct", "avg_match_weight", "extraction_completeness_pct"],
        where=F.col("source_channel").isin("fax", "electronic"),
        order=[F.col("source_channel")],
    )


def s04_docs_without_anchors(reg, as_of=None):
    return (
        V.match_detail_by_payer(reg)
        .where(_is("high_risk_documents"))
        .select("doc_id", "payer_code", "document_type", "source_channel", "intake_date", "match_class")
        .orderBy("doc_id")
    )


def s05_spikes_this_week(reg, as_of=None):
    return (
        _recent_intake(reg, as_of, 7, 7)
        .select("intake_date", "total_docs", "rolling_7d_avg", "is_volume_spike")
        .orderBy("intake_date")
    )


def s06_docs_yesterday(reg, as_of=None):
    """Documents of the day before the reporting date."""
    docs = reg.table("clinical_document").select(F.to_date("ingestion_timestamp").alias("d"))
    return docs.where(F.col("d") == F.date_sub(newest(docs, "d", as_of), 1)).agg(
        F.count(F.lit(1)).alias("docs_yesterday")
    )


def s07_pa_time_by_payer(reg, as_of=None):
    return M.prior_auth(reg).query(
        ["payer_code"],
        ["pa_volume", "avg_days_to_decision"],
        order=[F.col("avg_days_to_decision").desc(), F.col("payer_code").asc_nulls_first()],
    )


def s08_sla_by_urgency(reg, as_of=None):
    return M.prior_auth(reg).query(
        ["urgency"], ["pa_volume", "sla_compliance_pct", "denial_rate_pct"], order=[F.col("urgency")]
    )


def s09_aht_variation(reg, as_of=None):
    return M.call_ops(reg).query(
        ["call_type"], ["total_calls", "avg_handle_seconds", "avg_wait_seconds"], order=[F.col("call_type")]
    )


def s10_top_agents_by_agency(reg, as_of=None):
    return (
        V.call_scores(reg)
        .where(F.col("agent_rank_in_agency") <= 3)
        .groupBy("agency_name", "agent_name")
        .agg(F.max("agent_rank_in_agency").alias("agent_rank_in_agency"), F.count(F.lit(1)).alias("calls"))
        .orderBy("agency_name", "agent_rank_in_agency", "agent_name")
    )


def s11_negative_by_type(reg, as_of=None):
    negative = n_where(F.col("sentiment_overall") == "negative")
    return (
        V.call_sentiment(reg)
        .groupBy("call_type")
        .agg(negative.alias("negative_calls"), pct(negative, F.count(F.lit(1))).alias("negative_pct"))
        .orderBy(F.col("negative_calls").desc(), "call_type")
    )


def s12_asa_trend(reg, as_of=None):
    return M.call_ops(reg).query(
        ["ops_date"],
        {"avg_wait_seconds": "asa_sec"},
        where=since(F.col("ops_date"), _calls_newest(reg, as_of), 30),
        order=[F.col("ops_date")],
    )


def s13_fcr_this_week(reg, as_of=None):
    return M.call_ops(reg).query(
        [], {"fcr_pct": "fcr", "total_calls": "calls"},
        where=since(F.col("ops_date"), _calls_newest(reg, as_of), 7),
    )


def s14_score_by_agency(reg, as_of=None):
    return M.call_quality(reg).query(
        ["agency_name"], ["total_calls", "avg_call_score", "high_risk_pct", "escalation_rate_pct"],
        order=[F.col("avg_call_score").desc(), F.col("agency_name")],
    )


def s15_compliance_30_days(reg, as_of=None):
    view = M.call_quality(reg)
    return view.query(
        ["scored_date"], ["compliance_rate_pct", "high_risk_pct", "escalation_count"],
        where=since(F.col("scored_date"), newest(view.source, "scored_date", as_of), 30),
        order=[F.col("scored_date")],
    )


def x01_spike_then_calls(reg, days: int = 1, as_of=None):
    """Spike or degradation days beside the call volume and score ``days`` later."""
    spikes = V.intake_daily(reg).select("intake_date", "total_docs", "is_volume_spike")
    quality = V.data_quality_daily(reg).select(F.col("parse_date").alias("intake_date"), "dq_degradation_flag")
    cause = spikes.join(quality, "intake_date", "left").where(
        F.col("is_volume_spike") | F.coalesce("dq_degradation_flag", F.lit(False))
    )
    effect = M.call_quality(reg).query(["scored_date"], ["total_calls", "avg_call_score"])
    return lead_lag(cause, "intake_date", effect, "scored_date", days)


def lead_lag(cause: DataFrame, cause_day: str, effect: DataFrame, effect_day: str, days: int) -> DataFrame:
    """Rows of ``cause`` beside the ``effect`` row ``days`` later, if there is one."""
    return cause.join(effect, F.date_add(F.col(cause_day), days) == F.col(effect_day), "left")


QUESTIONS: dict[str, Callable[..., DataFrame]] = {
    name: fn for name, fn in list(globals().items()) if name[:1] in "qsx" and name[1:3].isdigit()
}
