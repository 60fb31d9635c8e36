import pytest
from pyspark.sql import functions as F

from caselight.operators import governance as G
from caselight.plans import views as V
from caselight.sources.registry import PAYER_TABLES, Registry
from caselight.sources.schemas import SCHEMAS
from conftest import rows


@pytest.mark.parametrize("inline", [500, 0])
def test_filter_keeps_granted_and_unassigned_rows(spark, inline):
    df = spark.createDataFrame([(1, "A"), (2, "B"), (3, None), (4, "C")], "id int, payer_code string")
    grants = spark.createDataFrame([("u", "A"), ("u", "A"), ("u", "C"), ("v", "B")], "user_email string, payer_id string")
    assert [r[0] for r in rows(G.visible(df, grants, "u", inline=inline))] == [1, 3, 4]
    assert [r[0] for r in rows(G.visible(df, grants, "nobody", inline=inline))] == [3]


def test_filter_reaches_the_scan(spark, tmp_path):
    df = spark.createDataFrame([(1, "A"), (2, None)], "id int, payer_code string")
    df.write.parquet(f"{tmp_path}/t")
    grants = spark.createDataFrame([("u", "A")], "user_email string, payer_id string")
    plan = G.visible(spark.read.parquet(f"{tmp_path}/t"), grants, "u", inline=500)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(IsNull(payer_code)" in plan


def test_revoked_grants_count_at_once(spark, reg, tmp_path):
    for name in ("clinical_document", "payer_access_mapping"):
        reg.raw(name).write.parquet(f"{tmp_path}/{name}.parquet")
    names, user = ["clinical_document", "payer_access_mapping"], "two@example.org"
    stored = Registry.from_folder(spark, str(tmp_path), names, user=user, live=True)
    every = {r[0] for r in stored.raw("clinical_document").select("payer_code").distinct().collect()}

    def seen():
        return {r[0] for r in stored.table("clinical_document").select("payer_code").distinct().collect()}

    held = seen()
    assert held < every and V.intake_daily(stored).count()
    first = sorted(p for p in held if p)[0]
    left = spark.createDataFrame(reg.raw("payer_access_mapping").where(~((F.col("user_email") == user) & (F.col("payer_id") == first))).collect(), reg.raw("payer_access_mapping").schema)
    left.write.mode("overwrite").parquet(f"{tmp_path}/payer_access_mapping.parquet")
    assert seen() == held - {first}


def test_filter_prunes_payer_folders(spark, tmp_path):
    rows_ = [(i, p) for i in range(40) for p in ("A", "B", "C", None)]
    df = spark.createDataFrame(rows_, "id int, payer_code string")
    df.write.partitionBy("payer_code").parquet(f"{tmp_path}/t")
    spark.createDataFrame([("u", "A"), ("v", "B")], "user_email string, payer_id string").write.parquet(f"{tmp_path}/g")
    found = G.visible(spark.read.parquet(f"{tmp_path}/t"), spark.read.parquet(f"{tmp_path}/g"), "u")
    assert {r.payer_code for r in found.collect()} == {"A", None} and found.count() == 80
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruningexpression" in plan and "LeftSemi" in plan


def test_all_grants_show_everything(reg):
    everyone = reg.as_user("all@example.org")
    for name in PAYER_TABLES:
        assert everyone.table(name).count() == reg.table(name).count()
    assert rows(V.intake_daily(everyone)) == rows(V.intake_daily(reg))


def test_filter_acts_before_windows(reg):
    two = reg.as_user("two@example.org")
    seen = V.match_detail_ranked(two)
    assert seen.where("weight_rank_in_type = 1").select("document_type").distinct().count() == 5
    assert rows(V.auth_match_daily(two).groupBy("match_date").agg(
        (F.abs(F.sum("daily_class_share") - 100) < 0.05).alias("ok")).select("ok").distinct()) == [(True,)]
    calls = V.call_rows(two).count()
    assert calls == V.call_rows(reg).count()  # call tables carry no payer


def test_grants_are_added_once(reg, spark):
    empty = spark.createDataFrame([], SCHEMAS["payer_access_mapping"])
    at = F.lit("2024-01-01").cast("timestamp")
    once = G.grant_all(empty, "u", reg.table("payer_dim"), at, "bootstrap")
    assert once.count() == 5
    assert G.grant_all(once, "u", reg.table("payer_dim"), at, "bootstrap").count() == 5
    assert G.grant_all(once, "w", reg.table("payer_dim"), at, "bootstrap").count() == 10


def test_key_and_reference_reports(spark):
    df = spark.createDataFrame([("a",), ("a",), (None,), ("b",)], "k string")
    assert rows(G.check_key(df, "t", ["k"])) == [("t", "k", 4, 1, 1)]
    parent = spark.createDataFrame([("a",)], "p string")
    assert rows(G.check_ref(df, "t", "k", parent, "p")) == [("t", "k", 4, 1, 1)]
    empty = df.limit(0)
    assert rows(G.check_key(empty, "t", ["k"])) == [("t", "k", 0, 0, 0)]
    assert rows(G.check_ref(empty, "t", "k", parent, "p")) == [("t", "k", 0, 0, 0)]


def test_views_carry_no_identifiers(reg):
    for name, view in V.VIEWS.items():
        assert G.check_no_identifiers(view(reg)) == [], name
    assert "ssn4" in G.check_no_identifiers(reg.table("member"))
