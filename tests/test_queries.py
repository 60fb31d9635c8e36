"""Every query against its SQL counterpart in DuckDB, and free of Python and pairwise operators."""

import pytest

import __spark_entry__ as entry
from tools.check import compare, connect

FORBIDDEN = ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin", "MapInPandas")
OWN = set(entry.catalog.BATCH_QUERIES) | set(entry.catalog.STREAM_QUERIES)
QUERIES = {k: v for k, v in entry.queries().items() if k in OWN}
ORACLE = {k: v for k, v in entry.oracle_sql().items() if k in OWN}


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


def test_names_line_up():
    assert set(ORACLE) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]
    assert compare(df, duck.sql(ORACLE[name])) == ""


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "intake_date"
