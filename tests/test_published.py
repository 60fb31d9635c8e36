"""Catalog views: same rows as the DataFrame views, evaluated by each query, commented."""

import pytest
from pyspark.sql import functions as F

from caselight.plans import published as P
from caselight.plans.views import VIEWS
from caselight.sources.schemas import SCHEMAS, TABLE_COMMENTS
from conftest import rows

DB = "published_views"


@pytest.fixture(scope="module")
def stored(spark, reg):
    spark.sql(f"CREATE DATABASE {DB}")
    for name in set(reg.names()) & set(SCHEMAS):
        reg.table(name).write.saveAsTable(f"{DB}.{name}")
    P.comment_tables(spark, DB)
    assert P.create_views(spark, DB, "v_") == [f"{DB}.v_{n}" for n in VIEWS]
    yield DB
    spark.sql(f"DROP DATABASE {DB} CASCADE")


def flat(df):
    return df.select(*[F.concat_ws("|", c).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])


@pytest.mark.parametrize("name", list(VIEWS))
def test_view_equals_its_frame(spark, reg, stored, name):
    want, got = flat(VIEWS[name](reg)), flat(spark.table(f"{stored}.v_{name}"))
    assert dict(got.dtypes) == dict(want.dtypes)
    assert rows(got.select(want.columns)) == rows(want)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_blocks_of_calls_borrow_the_calls_before(spark, reg, stored, monkeypatch):
    monkeypatch.setattr(P, "BLOCK", 7)
    monkeypatch.setitem(P.TEXTS, "call_scores", P._calls())
    got = spark.sql(P.view_sql("call_scores", stored))
    want = VIEWS["call_scores"](reg)
    assert rows(got.select(want.columns)) == rows(want)


def test_comments_of_views_tables_and_columns(spark, stored):
    def shown(name):
        found = spark.sql(f"DESCRIBE EXTENDED {stored}.{name}").collect()
        return {r.col_name: r.comment for r in found}, {r.col_name: r.data_type for r in found}

    for name in VIEWS:
        cols, about = shown(f"v_{name}")
        assert about["Comment"] == P.VIEW_COMMENTS[name]
        assert all(cols[c] for c in spark.table(f"{stored}.v_{name}").columns)
    cols, about = shown("clinical_doc_parsed")
    assert about["Comment"] == TABLE_COMMENTS["clinical_doc_parsed"] and cols["doc_id"] == "Document key"


def test_rows_stored_after_publishing_count(spark, stored):
    total = f"SELECT sum(total_docs) FROM {stored}.v_intake_daily"
    before = spark.sql(total).first()[0]
    spark.sql(f"""INSERT INTO {stored}.clinical_document BY NAME
      SELECT 'late' AS doc_id, TIMESTAMP '2031-01-01 05:00:00' AS ingestion_timestamp, 'fax' AS source_channel""")
    assert spark.sql(total).first()[0] == before + 1
    last = spark.sql(f"SELECT * FROM {stored}.v_intake_daily ORDER BY intake_date DESC LIMIT 1").first()
    assert (last.total_docs, last.via_fax, last.cumulative_docs) == (1, 1, before + 1)


def test_grants_given_and_revoked_after_publishing_count(spark, stored):
    me, table = "late.reader@example.org", f"{stored}.payer_access_mapping"
    P.create_views(spark, stored, "own_", ["payer_mix", "intake_daily_by_payer"], user=f"'{me}'")

    def seen():
        return {r[0] for r in spark.sql(f"SELECT DISTINCT payer_code FROM {stored}.own_intake_daily_by_payer").collect()}

    others = seen() - {None}
    assert others == set()
    spark.sql(f"INSERT INTO {table} BY NAME SELECT '{me}' AS user_email, 'VERITAS' AS payer_id")
    assert seen() - {None} == {"VERITAS"}
    left = spark.table(table).where(F.col("user_email") != me)
    left.write.saveAsTable(f"{table}_left")
    spark.sql(f"INSERT OVERWRITE {table} SELECT * FROM {table}_left")
    assert seen() - {None} == set()
