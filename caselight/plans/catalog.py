"""Every query of the package by name; each takes a table registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.functions import exprs as X
from caselight.functions.exact import n_where
from caselight.operators import governance as G
from caselight.operators import linkage as L
from caselight.operators import maintenance as Mt
from caselight.operators.calls import compliance_rollup
from caselight.operators.intake import extract_fields, parse_docs
from caselight.plans import metrics as M
from caselight.plans import snippets as Sn
from caselight.plans import views as V
from caselight.plans.questions import QUESTIONS
from caselight.session import shared_dir
from caselight.sources import fixtures as Fx
from caselight.sources.registry import Registry
from caselight.sources.tables import append_missing, ensure_columns, merge_update, update_where
from caselight.sources.versions import VersionedTable
from caselight.streaming import stream as St

Query = Callable[[Registry], DataFrame]

AS_OF = date(2024, 6, 30)  # reporting date of the backfill queries


def _text_arrays(reg: Registry) -> DataFrame:
    return V.call_sentiment(reg).withColumns(
        {c: F.concat_ws("|", c) for c in ("key_topics", "emotional_markers")}
    )


VIEW_QUERIES: dict[str, Query] = {f"view_{n}": fn for n, fn in V.VIEWS.items()}
VIEW_QUERIES["view_call_sentiment"] = _text_arrays
VIEW_QUERIES["view_compliance_daily_documented"] = lambda r: V.compliance_daily(r, "documented")


def _metric(name: str, dims: list[str], **kw) -> Query:
    def run(reg: Registry) -> DataFrame:
        view = M.METRIC_VIEWS[name](reg, **kw)
        return view.query(dims, list(view.measures))

    return run


METRIC_QUERIES: dict[str, Query] = {
    "metric_doc_intake": _metric("doc_intake", ["is_volume_spike"]),
    "metric_doc_intake_global": _metric("doc_intake", ["is_volume_spike"], by_payer=False),
    "metric_doc_intake_by_date": _metric("doc_intake", ["intake_date"]),
    "metric_doc_match_by_type": _metric("doc_match", ["document_type"]),
    "metric_doc_match_by_channel_tier": _metric("doc_match", ["source_channel", "doc_risk_tier"]),
    "metric_doc_match_total": _metric("doc_match", []),
    "metric_call_quality_by_agency": _metric("call_quality", ["agency_name"]),
    "metric_call_quality_by_type_bucket": _metric("call_quality", ["call_type", "outcome_bucket"]),
    "metric_prior_auth_by_payer": _metric("prior_auth", ["payer_code", "urgency"]),
    "metric_prior_auth_by_date": _metric("prior_auth", ["decision_date"]),
    "metric_payer_volume_by_type": _metric("payer_volume", ["payer_type"]),
    "metric_call_ops_by_agency_type": _metric("call_ops", ["agency_name", "call_type"]),
    "metric_call_ops_by_date": _metric("call_ops", ["ops_date"]),
}

QUESTION_QUERIES: dict[str, Query] = {f"question_{n}": fn for n, fn in QUESTIONS.items()}


# Stages and linkage ------------------------------------------------------------


def stage_parse(reg: Registry) -> DataFrame:
    parsed = parse_docs(reg.raw("_documents"), F.col("parse_error_code"))
    return parsed.select(
        "doc_id", "unreadable_flag", "page_count_detected", "parse_error_status",
        F.to_date("ingest_ts").alias("ingest_day"), "payer_code",
    )


def stage_extract(reg: Registry) -> DataFrame:
    s = extract_fields(
        reg.raw("clinical_doc_parsed"), Fx.form_fields(reg.raw("_documents"), reg.raw("member"))
    )
    return s.withColumn("extraction_day", F.to_date("extraction_ts")).drop("extraction_ts")


def _run_day(df: DataFrame) -> DataFrame:
    return df.withColumn("run_day", F.to_date("pipeline_run_ts")).drop("pipeline_run_ts")


def link_members(reg: Registry) -> DataFrame:
    """Recomputed from the sources, not read from the stored candidates."""
    return _run_day(Fx.member_candidates(reg))


def link_auths(reg: Registry) -> DataFrame:
    return _run_day(Fx.auth_candidates(reg))


def link_best_candidate(reg: Registry) -> DataFrame:
    """Best of two candidate sets per document: all fields, and anchors only."""
    s, m = reg.raw("clinical_doc_structured"), reg.raw("member")
    anchors = L.link_members(s.withColumn("name_on_form", F.lit(None).cast("string")), m)
    both = reg.raw("doc_member_match_candidates").unionByName(anchors)
    return _run_day(L.best_candidate(both, "candidate_member_id")).select(
        "doc_id", "candidate_member_id", "total_weight", "match_class", "run_day"
    )


def link_events(reg: Registry) -> DataFrame:
    return reg.table("match_events").withColumn("event_day", F.to_date("event_ts")).drop("event_ts")


def link_class_counts(reg: Registry) -> DataFrame:
    return L.value_counts(reg.table("doc_member_match_candidates"), "match_class")


def _patterns(reg: Registry) -> DataFrame:
    docs, targets = L.member_evidence(reg.raw("clinical_doc_structured"), reg.raw("member"))
    return L.agreement_patterns(docs, targets, ["name", "dob", "ssn4"])


def link_patterns(reg: Registry) -> DataFrame:
    return _patterns(reg).select("there", "agreed", F.col("pairs").cast("long").alias("pairs"))


def link_estimate_mu(reg: Registry) -> DataFrame:
    found = L.estimate_mu(_patterns(reg), ["name", "dob", "ssn4"])
    return found.select("field", F.round("m", 4).alias("m"), F.round("u", 4).alias("u"), "converged")


def quality_by_batch(reg: Registry) -> DataFrame:
    batch = X.batch_id(F.to_date("ingest_ts"), F.expr("1 + cast(substring(doc_id, 4) as bigint) % 50"))
    return L.dq_summary(
        reg.table("clinical_doc_parsed"),
        reg.table("clinical_doc_structured"),
        reg.table("doc_member_match_candidates"),
        batch,
    ).drop("run_ts")


def rollup_compliance(reg: Registry) -> DataFrame:
    return compliance_rollup(reg.table("mv_call_scores")).drop("source_schema")


def score_bands(reg: Registry) -> DataFrame:
    return (
        V.call_rows(reg)
        .groupBy("agency_name", X.score_band(F.col("call_score")).alias("band"))
        .agg(F.count(F.lit(1)).alias("calls"))
    )


def document_batches(reg: Registry) -> DataFrame:
    return reg.table("clinical_document").groupBy("mrm_batch_id").agg(
        F.count(F.lit(1)).alias("docs"), F.min("auth_id").alias("first_auth"), F.max("page_count").alias("pages")
    )


STAGE_QUERIES: dict[str, Query] = {
    "stage_parse_docs": stage_parse,
    "stage_extract_fields": stage_extract,
    "link_member_candidates": link_members,
    "link_auth_candidates": link_auths,
    "link_best_candidate": link_best_candidate,
    "link_match_events": link_events,
    "link_class_counts": link_class_counts,
    "link_agreement_patterns": link_patterns,
    "link_estimate_mu": link_estimate_mu,
    "kpi_row": V.kpi_row,
    "rollup_compliance": rollup_compliance,
    "quality_by_batch": quality_by_batch,
    "call_score_bands": score_bands,
    "document_batches": document_batches,
}


# Table maintenance ----------------------------------------------------------------


def table_append_missing(reg: Registry) -> DataFrame:
    """Timings held for first-contact calls only, completed from the full derivation."""
    full = reg.table("call_ops_supplemental").select("call_id", "wait_seconds", "handle_seconds", "fcr_flag")
    held = full.where("fcr_flag").withColumn("wait_seconds", F.lit(0))
    return append_missing(held, full, ["call_id"])


def table_update_where(reg: Registry) -> DataFrame:
    """Old-row semantics: both new values are computed from the row before."""
    a = reg.table("authorization").select("auth_id", "auth_requested_date", "auth_decision_date", "status")
    gap = F.greatest(F.lit(0), X.days_between(F.col("auth_decision_date"), F.col("auth_requested_date")))
    new = F.date_add("auth_decision_date", 100)
    return update_where(
        a,
        F.col("auth_decision_date").isNotNull() & (F.col("status") != "Cancelled"),
        {"auth_decision_date": new, "auth_requested_date": F.date_sub(new, gap)},
    )


def table_merge_update(reg: Registry) -> DataFrame:
    """Payers restored from the documents where readable stage rows lost their own."""
    parsed = reg.table("clinical_doc_parsed").select(
        "doc_id", "parse_error_status", F.when(F.col("unreadable_flag"), F.col("payer_code")).alias("payer_code")
    )
    docs = reg.table("clinical_document").select("doc_id", F.lower("payer_code").alias("payer_code"))
    return merge_update(
        parsed, docs, ["doc_id"], {"payer_code": F.col("s.payer_code")}, when=F.col("t.payer_code").isNull()
    )


def table_partition_merge(reg: Registry) -> DataFrame:
    """A versioned table by day, whose last three days get their payers in lower case; which days were rewritten."""
    rows = reg.raw("clinical_document").select("doc_id", "payer_code", F.to_date("ingestion_timestamp").alias("day"))
    table = VersionedTable(reg.spark, f"{shared_dir(reg.spark)}/by-day-{uuid.uuid4().hex}")
    table.create(rows, ["day"])
    last = rows.agg(F.max("day")).scalar()
    source = rows.where(F.col("day") > F.date_sub(last, 3)).select("doc_id", F.lower("payer_code").alias("payer_code"))
    table.merge(source, ["doc_id"], {"payer_code": F.col("s.payer_code")}, when=F.col("t.payer_code").isNotNull())
    _, _, touched = table.history()[-1]
    return table.read().groupBy("day").agg(
        F.count(F.lit(1)).alias("docs"),
        n_where(F.col("payer_code") == F.lower("payer_code")).alias("lowered"),
        F.any_value(F.concat(F.lit("day="), F.col("day").cast("string")).isin(touched)).alias("rewritten"),
    )


def table_ensure_columns(reg: Registry) -> DataFrame:
    docs = reg.table("clinical_document").select("doc_id", "payer_code")
    return ensure_columns(docs, {"payer_code": "string", "urgency": "string"})


def _stages(reg: Registry, pick: Callable[[str], Column]) -> DataFrame:
    """One column of the documents and the four stage tables, under each other."""
    return _union(
        [
            reg.raw(n).select(F.lit(n).alias("table_name"), pick(n))
            for n in ("clinical_document", *Mt.STAGE_LAG)
        ]
    )


def backfill_payer(reg: Registry) -> DataFrame:
    """Rows per payer after hash assignment on documents and the cascade to the stage tables."""
    out = _stages(Mt.backfill_payers(reg), lambda _n: F.col("payer_code"))
    return out.groupBy("table_name", "payer_code").agg(F.count(F.lit(1)).alias("rows"))


def backfill_urgency(reg: Registry) -> DataFrame:
    auths = Mt.assign_urgency(reg.raw("authorization").drop("urgency"))
    return auths.groupBy("urgency").agg(F.count(F.lit(1)).alias("rows"))


def backfill_call_timings(reg: Registry) -> DataFrame:
    held = reg.raw("call_ops_supplemental").where("fcr_flag")
    full = Mt.add_call_timings(held, reg.raw("mv_call_scores"), F.lit(AS_OF).cast("timestamp"))
    return full.select("call_id", "wait_seconds", "handle_seconds", "fcr_flag")


def spread_documents(reg: Registry) -> DataFrame:
    """Rows per day and stage after one intake day is spread over ninety days."""
    column = {"clinical_document": "ingestion_timestamp", **{n: c for n, (c, _) in Mt.STAGE_LAG.items()}}
    out = _stages(
        Mt.spread_dates(reg, AS_OF, date(2024, 1, 10)), lambda n: F.to_date(column[n]).alias("day")
    )
    return out.groupBy("table_name", "day").agg(F.count(F.lit(1)).alias("rows"))


def shift_decisions(reg: Registry) -> DataFrame:
    """Decisions per new day and gap; the gaps equal those before the shift."""
    a = Mt.shift_decisions(reg.raw("authorization"), AS_OF).where(F.col("auth_decision_date").isNotNull())
    gap = X.days_between(F.col("auth_decision_date"), F.col("auth_requested_date"))
    return a.groupBy(
        "payer_code", "urgency", gap.cast("long").alias("gap_days"), F.col("auth_decision_date").alias("decision_day")
    ).agg(F.count(F.lit(1)).alias("decisions"))


def overlay_call_ts(reg: Registry) -> DataFrame:
    blank = reg.raw("call_ops_supplemental").withColumn("synthetic_call_ts", F.lit(None).cast("timestamp"))
    return Mt.overlay_call_ts(blank, AS_OF).select("call_id", F.to_date("synthetic_call_ts").alias("call_day"))


TABLE_QUERIES: dict[str, Query] = {
    "table_append_missing": table_append_missing,
    "table_update_where": table_update_where,
    "table_merge_update": table_merge_update,
    "table_ensure_columns": table_ensure_columns,
    "table_partition_merge": table_partition_merge,
    "backfill_payer": backfill_payer,
    "backfill_urgency": backfill_urgency,
    "backfill_call_timings": backfill_call_timings,
    "spread_documents": spread_documents,
    "shift_decisions": shift_decisions,
    "overlay_call_ts": overlay_call_ts,
}


# Governance -------------------------------------------------------------------------


def _as_user(user: str, view: Callable[[Registry], DataFrame]) -> Query:
    return lambda reg: view(reg.as_user(user))


def key_report(reg: Registry) -> DataFrame:
    # An event key repeated on purpose shows up as duplicated.
    checks = [("clinical_document", ["doc_id"]), ("authorization", ["auth_id"]), ("payer_dim", ["payer_code"])]
    out = G.check_key(reg.table("clinical_document"), "clinical_document_member", ["member_id"])
    for name, cols in checks:
        out = out.unionByName(G.check_key(reg.table(name), name, cols))
    return out


def reference_report(reg: Registry) -> DataFrame:
    docs, auths, payers = (reg.table(n) for n in ("clinical_document", "authorization", "payer_dim"))
    checks = [
        (docs, "clinical_document", "payer_code", payers, "payer_code"),
        (auths, "authorization", "payer_code", payers, "payer_code"),
        (reg.table("doc_member_match_candidates"), "doc_member_match_candidates", "doc_id", docs, "doc_id"),
        (reg.table("doc_auth_match_candidates"), "doc_auth_match_candidates", "doc_id", docs, "doc_id"),
        (docs, "clinical_document", "auth_id", reg.table("clinical_doc_structured"), "auth_id"),
    ]
    first, *rest = checks
    out = G.check_ref(*first)
    for c in rest:
        out = out.unionByName(G.check_ref(*c))
    return out


def grants_for_seen_payers(reg: Registry) -> DataFrame:
    """Grant one user every payer that owns a document."""
    seen = reg.raw("clinical_document").where(F.col("payer_code").isNotNull()).select("payer_code").distinct()
    grants = G.grant_all(
        reg.raw("payer_access_mapping"), "two@example.org", seen, F.lit(AS_OF).cast("timestamp"), "query"
    )
    return grants.select("user_email", "payer_id")


GOVERNANCE_QUERIES: dict[str, Query] = {
    "grants_for_seen_payers": grants_for_seen_payers,
    "row_filter_intake": _as_user("two@example.org", V.intake_daily),
    "row_filter_match_ranked": _as_user("two@example.org", V.match_detail_ranked),
    "row_filter_payer_mix_all": _as_user("all@example.org", V.payer_mix),
    "row_filter_payer_mix_none": _as_user("none@example.org", V.payer_mix),
    "row_filter_decisions": _as_user("two@example.org", V.pa_decisions_daily),
    "key_report": key_report,
    "reference_report": reference_report,
}


# Snippets -----------------------------------------------------------------------------


def _view(reg: Registry, name: str) -> DataFrame:
    return V.VIEWS[name](reg)


def _long(df: DataFrame, kind: str) -> DataFrame:
    cols = [F.col(c).cast(kind).alias(c) for c in df.columns]
    return df.select(*cols).unpivot([], df.columns, "name", "value")


def _by_view(items: dict[str, tuple]) -> dict[str, list[str]]:
    grouped: dict[str, list[str]] = {}
    for name, (view, _) in items.items():
        grouped.setdefault(view, []).append(name)
    return grouped


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def snippet_filters(reg: Registry) -> DataFrame:
    """Rows each named filter keeps; one pass per view."""
    return _union(
        [
            _long(_view(reg, v).agg(*[n_where(Sn.FILTERS[n][1]()).alias(n) for n in names]), "bigint")
            for v, names in _by_view(Sn.FILTERS).items()
        ]
    )


def snippet_recent(reg: Registry) -> DataFrame:
    """Rows each relative filter keeps, from a fixed reporting date."""
    at = F.lit(date(2024, 3, 20))
    return _union(
        [
            _long(_view(reg, v).agg(*[n_where(Sn.RECENT[n][1](at)).alias(n) for n in names]), "bigint")
            for v, names in _by_view(Sn.RECENT).items()
        ]
    )


def snippet_dimensions(reg: Registry) -> DataFrame:
    """Distinct values of each named dimension."""
    return _union(
        [
            _long(
                _view(reg, v).agg(*[F.countDistinct(Sn.DIMENSIONS[n][1]).alias(n) for n in names]), "bigint"
            )
            for v, names in _by_view(Sn.DIMENSIONS).items()
        ]
    )


def snippet_measures(reg: Registry) -> DataFrame:
    return _union(
        [
            _long(_view(reg, v).agg(*[Sn.MEASURES[n][1]().alias(n) for n in names]), "double")
            for v, names in _by_view(Sn.MEASURES).items()
        ]
    )


SNIPPET_QUERIES: dict[str, Query] = {
    "snippet_filters": snippet_filters,
    "snippet_recent": snippet_recent,
    "snippet_dimensions": snippet_dimensions,
    "snippet_measures": snippet_measures,
}


# Streams ----------------------------------------------------------------------------------


def _paths(reg: Registry, tag: str) -> tuple[str, str]:
    base = f"{shared_dir(reg.spark)}/{tag}-{uuid.uuid4().hex}"
    return f"{base}/sink", f"{base}/state"


def _doc_stream(reg: Registry, sf_dir: str) -> DataFrame:
    return Fx.document_projection(St.read_stream(reg.spark, sf_dir, "events"))


def stream_intake(reg: Registry, sf_dir: str) -> DataFrame:
    sink, state = _paths(reg, "stream-intake")
    St.intake_stream(_doc_stream(reg, sf_dir), sink, state).awaitTermination()
    return St.intake_base(reg.spark, sink, by_payer=True)


def stream_intake_windows(reg: Registry, sf_dir: str) -> DataFrame:
    sink, state = _paths(reg, "stream-windows")
    St.intake_windows(_doc_stream(reg, sf_dir), sink, state).awaitTermination()
    return St.window_days(reg.spark, sink)


def stream_quality(reg: Registry, sf_dir: str) -> DataFrame:
    sink, state = _paths(reg, "stream-quality")

    def extract(batch: DataFrame) -> DataFrame:
        parsed = parse_docs(batch, F.col("parse_error_code"))
        return extract_fields(parsed, Fx.form_fields(batch, reg.raw("member")))

    St.quality_stream(_doc_stream(reg, sf_dir), extract, sink, state).awaitTermination()
    return V.quality_trend(St.quality_base(reg.spark, sink))


def stream_cascade(reg: Registry, sf_dir: str) -> DataFrame:
    sink, state = _paths(reg, "stream-cascade")
    St.cascade_stream(_doc_stream(reg, sf_dir), sink, state).awaitTermination()
    log = VersionedTable(reg.spark, sink).read()

    def stage(name: str) -> DataFrame:
        column, _ = Mt.STAGE_LAG[name]
        blank = reg.raw(name).select("doc_id", F.lit(None).cast("string").alias("payer_code"), F.lit(None).cast("timestamp").alias(column))
        done = St.cascaded(blank, log, name)
        return done.select(F.lit(name).alias("table_name"), "doc_id", "payer_code", F.unix_seconds(column).alias("stage_second"))

    return _union([stage(name) for name in Mt.STAGE_LAG])


STREAM_QUERIES = {
    "stream_intake": stream_intake,
    "stream_intake_windows": stream_intake_windows,
    "stream_quality": stream_quality,
    "stream_cascade": stream_cascade,
}

BATCH_QUERIES: dict[str, Query] = {
    **VIEW_QUERIES,
    **METRIC_QUERIES,
    **QUESTION_QUERIES,
    **STAGE_QUERIES,
    **TABLE_QUERIES,
    **GOVERNANCE_QUERIES,
    **SNIPPET_QUERIES,
}
