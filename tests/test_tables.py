import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caselight.sources import tables as Tb
from caselight.sources.registry import Registry
from caselight.sources.schemas import COLUMN_COMMENTS, SCHEMAS, TABLE_COMMENTS
from conftest import rows

PARSED = SCHEMAS["clinical_doc_parsed"]


def test_round_trip_under_declared_schema(spark, tmp_path):
    ts = dt.datetime(2024, 1, 1, 3)
    df = spark.createDataFrame([("d1", False, 3, None, ts, "VERITAS")], PARSED)
    Tb.write_table(df, f"{tmp_path}/clinical_doc_parsed.parquet")
    back = Tb.read_table(spark, str(tmp_path), "clinical_doc_parsed")
    assert rows(back) == rows(df)
    assert back.schema["doc_id"].metadata["comment"] == COLUMN_COMMENTS["clinical_doc_parsed"]["doc_id"]
    Tb.overwrite_table(df.select("doc_id"), f"{tmp_path}/clinical_doc_parsed.parquet")
    assert spark.read.parquet(f"{tmp_path}/clinical_doc_parsed.parquet").columns == ["doc_id"]


def test_ensure_table_creates_once(spark, tmp_path):
    path = f"{tmp_path}/t"
    assert Tb.ensure_table(spark, path, PARSED).count() == 0
    spark.createDataFrame([("d1", True, 0, "unreadable", None, None)], PARSED).write.mode("append").parquet(path)
    assert Tb.ensure_table(spark, path, PARSED).count() == 1


def test_ensure_columns_keeps_existing(spark):
    df = spark.createDataFrame([(1, "x")], "a int, b string")
    out = Tb.ensure_columns(df, {"b": "string", "c": "double"})
    assert rows(out) == [(1, "x", None)] and out.schema["c"].dataType == T.DoubleType()


def test_seed_and_append_are_repeatable(spark):
    dim = spark.createDataFrame([("A", "kept")], "code string, name string")
    once = Tb.seed_dim(dim, [("A", "new"), ("B", "b")], "code")
    assert rows(once) == [("A", "kept"), ("B", "b")]
    assert rows(Tb.seed_dim(once, [("A", "new"), ("B", "b")], "code")) == rows(once)


def test_update_sees_the_old_row(spark):
    df = spark.createDataFrame([(1, 10), (2, 20)], "a int, b int")
    out = Tb.update_where(df, F.col("a") == 1, {"a": F.col("b"), "b": F.col("a")})
    assert rows(out) == [(2, 20), (10, 1)]


def test_merge_updates_matched_rows_only(spark):
    t = spark.createDataFrame([(1, None), (2, "keep"), (3, None)], "k int, v string")
    s = spark.createDataFrame([(1, "new"), (2, "new"), (9, "new")], "k int, v string")
    out = Tb.merge_update(t, s, ["k"], {"v": F.col("s.v")}, when=F.col("t.v").isNull())
    assert rows(out) == [(1, "new"), (2, "keep"), (3, None)]
    again = Tb.merge_update(out, s, ["k"], {"v": F.col("s.v")}, when=F.col("t.v").isNull())
    assert rows(again) == rows(out)


def test_merge_raises_on_duplicate_source(spark):
    t = spark.createDataFrame([(1, None)], "k int, v string")
    s = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="several rows"):
        Tb.merge_update(t, s, ["k"], {"v": F.col("s.v")}).collect()
    other = spark.createDataFrame([(2, None)], "k int, v string")
    assert rows(Tb.merge_update(other, s, ["k"], {"v": F.col("s.v")})) == [(2, None)]


def test_iso_text_becomes_dates(spark):
    df = spark.createDataFrame([("d1", "2024-01-02T03:04:05"), ("d2", "garbled")], "doc_id string, ingest_ts string")
    out = Tb.typed(df, PARSED)
    assert [f.dataType for f in out.schema.fields] == [f.dataType for f in PARSED.fields]
    assert [r.ingest_ts for r in out.orderBy("doc_id").collect()] == [dt.datetime(2024, 1, 2, 3, 4, 5), None]


def test_registry_over_stored_tables(spark, reg, tmp_path):
    names = ["clinical_document", "authorization", "payer_dim", "payer_access_mapping"]
    for n in names:
        Tb.write_table(reg.table(n), f"{tmp_path}/{n}.parquet")
    stored = Registry.from_folder(spark, str(tmp_path), names, prefix="mart_")
    from caselight.plans.views import intake_daily, payer_mix

    assert rows(intake_daily(stored)) == rows(intake_daily(reg))
    assert rows(payer_mix(stored)) == rows(payer_mix(reg))
    assert "mart_payer_dim" in stored.publish()
    assert spark.sql("SELECT count(*) FROM mart_payer_dim").first()[0] == 5
    with pytest.raises(KeyError):
        stored.table("nothing")


def test_views_can_be_published_for_sql(spark, reg):
    from caselight.plans.views import VIEWS, publish_views

    other = reg.as_user(None)
    other.prefix = "mart_"
    assert publish_views(other) == [f"mart_{n}" for n in VIEWS]
    for n in VIEWS:
        assert all(f.metadata.get("comment") for f in spark.table(f"mart_{n}").schema.fields), n
    assert spark.sql("SELECT sum(total_docs) FROM mart_intake_daily").first()[0] == reg.table("clinical_document").count()


def test_bucketed_tables_join_without_shuffle(spark, reg):
    Tb.save_bucketed(
        reg.table("clinical_doc_parsed"), "b_parsed", "doc_id", 4, TABLE_COMMENTS["clinical_doc_parsed"]
    )
    Tb.save_bucketed(reg.table("clinical_document").select("doc_id", "payer_code"), "b_docs", "doc_id", 4)
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        joined = spark.table("b_parsed").drop("payer_code").join(spark.table("b_docs"), "doc_id")
        shown = {r.col_name: r.data_type for r in spark.sql("DESCRIBE EXTENDED b_parsed").collect()}
        assert shown["Comment"] == TABLE_COMMENTS["clinical_doc_parsed"]
        assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()
        assert joined.count() == reg.table("clinical_doc_parsed").count()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE b_parsed")
        spark.sql("DROP TABLE b_docs")


def test_comments_name_known_columns():
    for table, comments in COLUMN_COMMENTS.items():
        assert set(comments) <= set(SCHEMAS[table].fieldNames())
    assert set(TABLE_COMMENTS) <= set(SCHEMAS)


def test_tables_with_text_dates(spark, reg, tmp_path):
    docs = reg.table("clinical_document")
    stamps = [f.name for f in docs.schema.fields if f.dataType == T.TimestampType()]
    text = docs.withColumns({c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS") for c in stamps})
    text.write.parquet(f"{tmp_path}/clinical_document.parquet")
    stored = Registry.from_folder(spark, str(tmp_path), ["clinical_document"], text_dates=True)
    from caselight.plans.views import intake_daily

    assert rows(intake_daily(stored)) == rows(intake_daily(reg))


class _Fake:
    """Just enough of a session to ask for its folder."""

    def __init__(self, master, folder=None):
        self.conf = type("C", (), {"get": lambda _s, _k, default: folder or default})()
        self.sparkContext = type("S", (), {"master": master, "applicationId": "app-test"})()


def test_shared_folder_comes_from_the_cluster(tmp_path):
    from caselight.session import shared_dir

    assert shared_dir(_Fake("spark://x", "hdfs://shared/dir/")) == "hdfs://shared/dir"
    with pytest.raises(RuntimeError):
        shared_dir(_Fake("spark://x"))
    local = shared_dir(_Fake("local[2]"))
    assert local == shared_dir(_Fake("local[2]"))


def test_materialized_tables_can_be_cleared(spark):
    from caselight import session as S

    kept = dict(S._written)
    S._written.clear()
    try:
        df = S.materialize(spark.range(5), "probe")
        assert df.count() == 5 and df.inputFiles()
        path = S._written[spark.sparkContext.applicationId][0]
        assert S.clear_materialized(spark) == 1 and not Tb.table_exists(spark, path)
    finally:
        S._written.update(kept)


def test_stored_table_is_replaced_by_its_own_update(spark, tmp_path):
    path = f"{tmp_path}/payer_dim.parquet"
    dim = spark.createDataFrame([("A", "a", "old", True, None), ("B", "b", "old", True, None)], SCHEMAS["payer_dim"])
    Tb.write_table(dim, path)
    stored = Tb.read_table(spark, str(tmp_path), "payer_dim")
    Tb.replace_table(Tb.update_where(stored, F.col("payer_code") == "A", {"payer_type": F.lit("new")}), path)
    again = Tb.read_table(spark, str(tmp_path), "payer_dim")
    assert [(r.payer_code, r.payer_type) for r in again.orderBy("payer_code").collect()] == [("A", "new"), ("B", "old")]
    assert [p.name for p in tmp_path.iterdir()] == ["payer_dim.parquet"]


def test_other_formats(spark, tmp_path):
    dim = spark.createDataFrame([("A", "a", "x", True, None)], SCHEMAS["payer_dim"])
    Tb.write_table(dim, f"{tmp_path}/payer_dim.orc", fmt="orc")
    stored = Registry.from_folder(spark, str(tmp_path), ["payer_dim"], fmt="orc")
    assert rows(stored.table("payer_dim")) == rows(dim)
