import datetime as dt

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.functions import exprs as X
from caselight.functions.exact import fixed, ratio
from caselight.operators.calls import compliance_rollup
from caselight.plans import metrics as M
from caselight.plans import views as V
from caselight.plans.catalog import BATCH_QUERIES
from caselight.sources.registry import Registry
from caselight.sources.schemas import SCHEMAS
from conftest import same


def day(n, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)


def table(spark, name, data):
    """Rows given as dicts under the declared schema."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(d.get(f) for f in schema.fieldNames()) for d in data], schema)


def micro(spark, **tables):
    reg = Registry(spark, {n: (lambda _r, s=s: spark.createDataFrame([], s)) for n, s in SCHEMAS.items()})
    for name, data in tables.items():
        reg.put(name, table(spark, name, data))
    return reg


def docs_per_day(counts, payer=None):
    out = []
    for i, n in enumerate(counts):
        out += [
            {"doc_id": f"{payer}{i}-{j}", "document_type": "clinical_note", "source_channel": "fax",
             "is_readable": True, "quality_score": 0.5, "ingestion_timestamp": day(i, 5), "payer_code": payer}
            for j in range(n)
        ]
    return out


@pytest.mark.parametrize("last, flagged", [(25, True), (24, False)])
def test_spike_needs_more_than_twice_its_own_mean(spark, last, flagged):
    reg = micro(spark, clinical_document=docs_per_day([10] * 6 + [last]))
    got = V.intake_daily(reg).orderBy("intake_date").collect()
    assert got[-1].is_volume_spike is flagged
    assert not any(r.is_volume_spike for r in got[:-1])
    assert got[-1].day_over_day_change == last - 10 and got[-1].cumulative_docs == 60 + last


def test_unassigned_payer_is_its_own_series(spark):
    reg = micro(spark, clinical_document=docs_per_day([4, 2]) + docs_per_day([1, 9], "VERITAS"))
    got = {(r.payer_code, r.intake_date.day): r.rolling_7d_avg for r in V.intake_daily_by_payer(reg).collect()}
    assert got == {(None, 1): 4.0, (None, 2): 3.0, ("VERITAS", 1): 1.0, ("VERITAS", 2): 5.0}
    mix = {r.payer_code: r for r in V.payer_mix(reg).collect()}
    assert mix[None].total_documents == 6 and mix[None].payer_name is None
    assert mix["VERITAS"].total_pa_decisions == 0 and mix["VERITAS"].pa_approval_rate_pct == 0.0


def test_payer_rows_add_up_to_the_global_view(reg):
    counts = ["total_docs", *V.DOC_TYPE_COLUMNS, "unreadable_docs", *V.CHANNEL_COLUMNS]
    summed = V.intake_daily_by_payer(reg).groupBy("intake_date").agg(*[F.sum(c).alias(c) for c in counts])
    same(summed, V.intake_daily(reg).select("intake_date", *counts))


def test_document_counts_of_a_unique_key(reg):
    same(V.payer_mix(reg, documents="rows"), V.payer_mix(reg))
    exact = {r.payer_code: r.total_documents for r in V.payer_mix(reg).collect()}
    for r in V.payer_mix(reg, documents="approx").collect():
        assert abs(r.total_documents - exact[r.payer_code]) <= 0.2 * exact[r.payer_code]


def candidate(doc, weight=1.0, cls="non_match"):
    return {"doc_id": doc, "candidate_member_id": "m", "total_weight": weight, "match_class": cls}


def test_tiers_of_unreadable_and_unknown_documents(spark):
    reg = micro(
        spark,
        doc_member_match_candidates=[candidate("gone"), candidate("blurred"), candidate("read")],
        clinical_doc_parsed=[{"doc_id": "blurred", "unreadable_flag": True}, {"doc_id": "read", "unreadable_flag": False}],
        clinical_doc_structured=[{"doc_id": "read", "missing_dob": False, "missing_ssn4": True, "auth_id": "x"}],
        clinical_document=[{"doc_id": "read", "document_type": "lab_result", "ingestion_timestamp": day(0)}],
    )
    got = {r.doc_id: r for r in V.match_detail_by_payer(reg).collect()}
    assert got["gone"].doc_risk_tier == X.TIER_NONE and got["gone"].unreadable_flag is None
    assert got["blurred"].doc_risk_tier == X.TIER_UNREADABLE
    assert got["read"].doc_risk_tier == X.TIER_ONE and got["read"].has_auth_id and not got["read"].has_member_id
    ranked = {r.doc_id: r for r in V.match_detail_ranked(reg).collect()}
    assert ranked["gone"].weight_rank_in_type == 1 and ranked["gone"].docs_same_day_type == 2
    assert ranked["read"].weight_pctile_in_type == 0.0


def plain_match_ranks(reg):
    """The view's context columns as ordinary windows."""
    d = V.match_detail_by_payer(reg).drop("payer_code")
    by_type = W.partitionBy("document_type")
    n = F.count(F.lit(1))

    def mean(part):
        return ratio(F.sum(fixed(F.col("match_weight"), 4)).over(part), n.over(part) * 10**4, 4)

    below = F.rank().over(by_type.orderBy(F.col("match_weight").asc_nulls_first())) - 1
    return d.select(
        "*",
        F.rank().over(by_type.orderBy(F.col("match_weight").desc_nulls_last())).cast("long").alias("weight_rank_in_type"),
        F.coalesce(ratio(below, n.over(by_type) - 1, 4), F.lit(0.0)).alias("weight_pctile_in_type"),
        mean(by_type).alias("type_avg_weight"),
        mean(W.partitionBy("source_channel")).alias("channel_avg_weight"),
        n.over(W.partitionBy("document_type", "intake_date")).alias("docs_same_day_type"),
    )


@pytest.mark.parametrize("cells_per_task", [200_000, 10])
def test_ranked_detail_equals_plain_windows(reg, cells_per_task):
    same(V.match_detail_ranked(reg, cells_per_task), plain_match_ranks(reg))


def test_lookups_above_the_broadcast_bound_give_the_same_rows(reg, spark, monkeypatch):
    expected = V.match_detail_ranked(reg), V.call_scores(reg)
    monkeypatch.setattr(V.R, "sized", lambda df, **_: df)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for plain, df in zip((V.match_detail_ranked(reg), V.call_scores(reg)), expected):
            assert "Broadcast" not in plain._jdf.queryExecution().executedPlan().toString()
            same(plain, df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_call_scores_do_not_depend_on_the_split(reg):
    base = V.call_scores(reg)
    same(V.call_scores(reg, hot_rows=25, cells_per_task=7), base)
    agents = base.groupBy("agent_name").agg(F.count(F.lit(1)).alias("n"), F.max("agent_call_count").alias("c"))
    assert agents.where("n <> c").count() == 0
    assert base.where("agent_rank_in_agency = 1").select("agency_name").distinct().count() == 4


def decision(auth, status, urgency="urgent", days=1, decided=True):
    return {"auth_id": auth, "status": status, "urgency": urgency, "payer_code": "VERITAS",
            "auth_requested_date": day(0).date(), "auth_decision_date": day(days).date() if decided else None}


def test_only_cancelled_decisions_have_no_rate(spark):
    reg = micro(spark, authorization=[decision("a", "Cancelled"), decision("b", "Pending", decided=False)])
    (row,) = V.pa_decisions_daily(reg).collect()
    assert row.approval_rate_pct is None and row.denial_rate_pct is None
    assert row.total_decisions == 1 and row.sla_compliance_pct == 100.0
    (measure,) = M.prior_auth(reg).query([], ["approval_rate_pct", "sla_compliance_pct"]).collect()
    assert measure.approval_rate_pct is None and measure.sla_compliance_pct == 100.0


def test_unknown_urgency_is_never_within_sla(spark):
    reg = micro(spark, authorization=[decision("a", "Approved", urgency=None, days=0)])
    (row,) = V.pa_decisions_daily(reg).collect()
    assert row.sla_target_hours is None and row.within_sla_count == 0 and row.sla_compliance_pct == 0.0


def test_anchor_flags_count_differently_in_the_two_views(reg):
    quality = V.data_quality_daily(reg).agg(F.sum("missing_dob_count")).first()[0]
    # Unreadable documents have no extraction row: not missing here, missing in the detail.
    assert quality == reg.table("clinical_doc_structured").where("missing_dob").count()


def test_shares_and_totals(reg):
    daily = V.auth_match_daily(reg)
    off = daily.groupBy("match_date").agg(F.sum("daily_class_share").alias("s")).where("abs(s - 100) > 0.05")
    assert off.count() == 0
    last = daily.groupBy("match_class").agg(F.max("class_running_total").alias("t"), F.sum("candidate_count").alias("n"))
    assert last.where("t <> n").count() == 0
    ranks = V.compliance_daily(reg).groupBy("day").agg(F.min("agency_compliance_rank").alias("r"))
    assert ranks.where("r <> 1").count() == 0


def test_rates_of_the_rollup(spark):
    calls = table(spark, "mv_call_scores", [
        {"call_id": str(i), "call_type": "t", "agency_name": "a", "call_score": s, "outcome_bucket": b, "created_ts": day(0, 9)}
        for i, (s, b) in enumerate([(90, "compliant"), (70, "needs_review"), (50, "high_risk")])
    ])
    (row,) = compliance_rollup(calls).collect()
    assert (row.scored_calls, row.avg_call_score, row.high_risk_rate) == (3, 70.0, 0.33333)
    assert row.compliance_rate == round(1 / 3, 16)


@pytest.mark.parametrize("name", sorted(V.VIEWS))
def test_views_over_empty_tables(spark, name):
    reg = micro(spark)
    out = V.VIEWS[name](reg).collect()
    assert len(out) == (8 if name == "kpi_snapshot" else 0)
    if name == "kpi_snapshot":
        assert {r.metric_value for r in out} == {0.0}


def test_metric_view_rejects_unknown_names(reg):
    view = M.call_quality(reg)
    with pytest.raises(KeyError):
        view.query(["day"], ["total_calls"])
    with pytest.raises(KeyError):
        view.query(["agency_name"], ["nothing"])
    assert view.query(["agency_name"]).count() == 4
    top = view.query(["agency_name"], {"total_calls": "n"}, having=F.col("n") > 0, order=[F.col("n").desc()], limit=2)
    assert [r.n for r in top.collect()] == sorted([r.n for r in top.collect()], reverse=True) and top.count() == 2


def test_reporting_date_is_a_parameter(reg):
    fn = BATCH_QUERIES["question_q03_intake_trend"]
    from caselight.plans.questions import q03_intake_trend

    assert q03_intake_trend(reg, dt.date(2024, 3, 1)).count() == 0
    assert fn(reg).count() == 30
