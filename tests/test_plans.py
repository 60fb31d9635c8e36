"""Plan shapes that matter at scale."""

import datetime as dt

from caselight.plans.catalog import BATCH_QUERIES
from caselight.plans import views as V


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_daily_intake_shuffles_partial_aggregates_once(reg):
    plan = plan_of(V.intake_daily(reg))
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan
    assert plan.count("FileScan") == 1 and "props" not in plan and ",value#" not in plan


def test_ranked_detail_never_shuffles_by_type(reg):
    plan = plan_of(V.match_detail_ranked(reg))
    assert "BroadcastHashJoin" in plan and "Window [rank" not in plan
    # All four are over the small cube: weights, their ranks, types, type days.
    assert plan.count("Exchange hashpartitioning(document_type") == 4
    assert plan.count("match-cube") == 4


def test_recent_questions_filter_the_scan(reg, spark, tmp_path):
    from caselight.plans.questions import q03_intake_trend
    from caselight.sources.registry import Registry

    reg.table("clinical_document").write.parquet(f"{tmp_path}/clinical_document.parquet")
    stored = Registry.from_folder(spark, str(tmp_path), ["clinical_document"])
    day = dt.date(2024, 1, 28)
    plan = plan_of(q03_intake_trend(stored, day))
    assert "GreaterThanOrEqual(ingestion_timestamp" in plan
    assert q03_intake_trend(stored, day).collect() == q03_intake_trend(reg, day).collect()


def test_kpis_scan_each_table_once(reg):
    plan = plan_of(V.kpi_snapshot(reg))
    assert plan.count("member-candidates") == 1 and "Expand" in plan


def test_top_k_is_not_a_full_sort(reg):
    plan = plan_of(BATCH_QUERIES["question_q26_bottom_agents"](reg))
    assert "TakeOrderedAndProject" in plan


def test_newest_calls_are_limited_before_the_shuffle(reg):
    assert "WindowGroupLimit" in plan_of(BATCH_QUERIES["question_q37_agents_trending_down"](reg))
