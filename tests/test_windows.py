import datetime as dt
import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.functions.exact import ratio
from caselight.operators import ranks as R
from caselight.operators import windows as Wd
from conftest import rows, same


def days(n, start=dt.date(2024, 1, 1)):
    return [start + dt.timedelta(days=i) for i in range(n)]


@pytest.mark.parametrize(
    "mode, expected", [("literal", [1, 2, 0, 2, 3, 0, 0, 2]), ("documented", [1, 2, 0, 1, 2, 0, 0, 1])]
)
def test_streak(spark, mode, expected):
    rates = [0.5, 0.5, 0.9, 0.5, 0.4, 0.9, 0.95, 0.1]
    df = spark.createDataFrame([("a", d, r) for d, r in zip(days(8), rates)], "k string, day date, rate double")
    out = Wd.streak(df, ["k"], "day", F.col("rate") < 0.85, "run", mode)
    assert [r.run for r in out.orderBy("day").collect()] == expected
    with pytest.raises(ValueError):
        Wd.streak(df, ["k"], "day", F.col("rate") < 0.85, "run", "other")


def test_lag_counts_rows_not_days(spark):
    data = [(dt.date(2024, 1, 1), 5), (dt.date(2024, 1, 9), 7), (dt.date(2024, 1, 10), 14)]
    df = spark.createDataFrame(data, "d date, n int")
    got = df.select("d", Wd.lag_rows("n", 1, [], ["d"]), Wd.change_pct("n", 1, [], ["d"])).orderBy("d").collect()
    assert [tuple(r)[1:] for r in got] == [(None, None), (5, 40.0), (7, 100.0)]


def test_trailing_and_share(spark):
    df = spark.createDataFrame([("a", d, n) for d, n in zip(days(4), (1, 2, 4, 8))] + [("b", days(1)[0], 3)], "k string, d date, n int")
    out = df.select(
        "k", "d", Wd.trailing_mean("n", 2, ["k"], ["d"], 1).alias("m"),
        Wd.running_total("n", ["k"], ["d"]).alias("t"), Wd.share("n", ["d"]).alias("s"),
    )
    got = rows(out)
    assert [r[2] for r in got if r[0] == "a"] == [1.0, 1.5, 3.0, 6.0]
    assert [r[3] for r in got if r[0] == "a"] == [1, 3, 7, 15]
    assert [r[4] for r in got if r[1] == days(1)[0]] == [25.0, 75.0]


def _scores(spark, n=400, seed=3):
    rnd = random.Random(seed)
    data = [
        (f"c{i:04d}", rnd.choice(["hot"] * 5 + ["x", "y", None]), rnd.choice([None] + list(range(40, 60))),
         dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rnd.choice([0, 0, 5, i])))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id string, k string, score int, ts timestamp")


@pytest.mark.parametrize("cells_per_task", [1_000_000, 4])
def test_value_ranks_equal_window_ranks(spark, cells_per_task):
    df = _scores(spark)
    cells = df.groupBy("k", "score").agg(F.count(F.lit(1)).alias("n"))
    got = R.null_safe(df, R.value_ranks(cells, ["k"], "score", cells_per_task), ["k", "score"]).select(
        "id", R.rank_desc().alias("r"), R.dense_rank_desc().alias("dr"), R.percent_rank_asc().alias("p")
    )
    part = W.partitionBy("k")
    rank = F.rank().over(part.orderBy(F.col("score").asc_nulls_first()))
    expected = df.select(
        "id",
        F.rank().over(part.orderBy(F.col("score").desc_nulls_last())).cast("long").alias("r"),
        F.dense_rank().over(part.orderBy(F.col("score").desc_nulls_last())).cast("long").alias("dr"),
        F.coalesce(ratio(rank - 1, F.count(F.lit(1)).over(part) - 1, 4), F.lit(0.0)).alias("p"),
    )
    same(got, expected)


def test_single_row_partition_has_percentile_zero(spark):
    cells = spark.createDataFrame([("a", 5, 1)], "k string, v int, n long")
    assert R.value_ranks(cells, ["k"], "v").select(R.percent_rank_asc()).first()[0] == 0.0


@pytest.mark.parametrize("hot_rows", [10**9, 60, 7])
def test_rolling_mean_of_hot_keys(spark, hot_rows):
    df = _scores(spark)
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    got = R.rolling_mean(df, "k", ["ts", "id"], "score", 5, 1, "m", counts, hot_rows).select("id", "m")
    frame = W.partitionBy("k").orderBy("ts", "id").rowsBetween(-4, 0)
    value = F.col("score").cast("long")
    expected = df.select("id", ratio(F.sum(value).over(frame), F.count(value).over(frame), 1).alias("m"))
    same(got, expected)


def test_rolling_mean_when_all_rows_share_one_timestamp(spark):
    df = _scores(spark).withColumn("ts", F.lit(dt.datetime(2024, 1, 1)))
    counts = df.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    args = (df, "k", ["ts", "id"], "score", 5, 1, "m", counts)
    same(R.rolling_mean(*args, 20).select("id", "m"), R.rolling_mean(*args, 10**9).select("id", "m"))


def test_top_ranked_keeps_all_ties(spark):
    df = spark.createDataFrame([(v,) for v in [9] * 12 + [8] * 3 + [7]], "v int")
    cells = df.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    got = R.top_ranked(df, "v", 10, cells)
    assert rows(got) == [(9, 1)] * 12
    assert R.top_ranked(df, "v", 13, cells).count() == 15


def test_sized_hint_only_below_the_limit(spark):
    df = spark.range(100)

    def plan(d):
        return d._jdf.queryExecution().optimizedPlan().toString()

    fact = spark.range(1000)
    assert "strategy=broadcast" in plan(fact.join(R.sized(df, 100), "id"))
    assert "strategy=broadcast" not in plan(fact.join(R.sized(df, 99), "id"))
    assert "strategy=broadcast" in plan(fact.join(R.sized(df, 100, at_most=100), "id"))
    assert "strategy=broadcast" not in plan(fact.join(R.sized(df, 99, at_most=200), "id"))


def test_dense_calendar(spark):
    from caselight.plans.views import dense_days

    df = spark.createDataFrame([("a", days(1)[0], 5), ("a", days(4)[3], 7), (None, days(1)[0], 1)], "k string, d date, n int")
    got = rows(dense_days(df, "d", ["k"], ["n"]))
    assert [r[2] for r in got if r[0] == "a"] == [5, 0, 0, 7] and len(got) == 5
