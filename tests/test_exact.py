from fractions import Fraction
from math import isnan

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from caselight.functions.exact import fixed, mean_exact, mean_int, n_where, pct, ratio


def half_up(value: Fraction, dp: int) -> float:
    unit = 10**dp
    n = abs(value) * unit
    whole = (2 * n.numerator + n.denominator) // (2 * n.denominator)
    return (-whole if value < 0 else whole) / unit


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-(10**12), 10**12), st.integers(0, 10**6)), min_size=1, max_size=60))
def test_ratio_is_exact_half_up(spark, pairs):
    df = spark.createDataFrame(pairs, "a long, b long")
    got = df.select("a", "b", ratio(F.col("a"), F.col("b"), 4).alias("r"), pct(F.col("a"), F.col("b")).alias("p"))
    for r in got.collect():
        if r.b == 0:
            assert r.r is None and r.p is None
        else:
            assert r.r == half_up(Fraction(r.a, r.b), 4)
            assert r.p == half_up(Fraction(100 * r.a, r.b), 2)


def test_narrow_ratio_agrees_with_wide(spark):
    df = spark.createDataFrame([(7, 8), (-7, 8), (1, 3), (5, 0), (None, 2)], "a long, b long")
    pairs = df.select(ratio(F.col("a"), F.col("b"), 2), ratio(F.col("a"), F.col("b"), 2, wide=False)).collect()
    assert all(x == y for x, y in pairs)
    assert pairs[0][0] == 0.88 and pairs[1][0] == -0.88


def test_fixed_point(spark):
    df = spark.createDataFrame([(0.575,), (-3.1626,), (None,)], "x double")
    assert [r[0] for r in df.select(fixed(F.col("x"), 4)).collect()] == [5750, -31626, None]


def test_means_skip_nulls_and_do_not_depend_on_order(spark):
    values = [0.1, 0.2, 0.3, None, 0.7]
    for order in (values, values[::-1]):
        df = spark.createDataFrame([(v,) for v in order], "x double").repartition(3)
        assert df.agg(mean_exact(F.col("x"), 3)).first()[0] == 0.325
    ints = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    assert ints.agg(mean_int(F.col("x"), 1)).first()[0] == 1.5


@pytest.mark.parametrize("parts", [1, 3, 7])
def test_means_cut_no_digits(spark, parts):
    rates = [0.8512345678901234, 0.1, 0.2000000000000001, 4.9e-7, 0.7]
    df = spark.createDataFrame([(x,) for x in rates], "x double").repartition(parts)
    assert df.agg(mean_exact(F.col("x"), 15)).first()[0] == half_up(sum(map(Fraction, map(str, rates))) / 5, 15)
    tiny = spark.createDataFrame([(4.9e-7,), (4.9e-7,), (None,)], "x double").repartition(parts)
    assert tiny.agg(mean_exact(F.col("x"), 9)).first()[0] == 4.9e-7
    ties = spark.createDataFrame([(0.57,), (0.58,)], "x double").repartition(parts)
    assert ties.agg(mean_exact(F.col("x"), 2)).first()[0] == 0.58
    # 1e16 + 1 - 1e16 and the like: doubles lose the one in most orders.
    wide = spark.createDataFrame([(x,) for x in (1e16, 1.0, -1e16, 2.0)], "x double").repartition(parts)
    assert wide.agg(mean_exact(F.col("x"), 4)).first()[0] == 0.75


def test_means_of_values_without_digits(spark):
    def mean(*values):
        df = spark.createDataFrame([(v,) for v in values], "x double")
        return df.agg(mean_exact(F.col("x"), 2)).first()[0]

    assert isnan(mean(1.0, float("nan"))) and mean(float("inf"), 1.0) == float("inf")
    assert mean(1e300, 1e300) == 1e300 and mean(9e19, 9e19) == 9e19 and mean(None) is None and mean() is None
    frame = W.orderBy("k").rowsBetween(-1, 0)
    df = spark.createDataFrame([(1, 0.1), (2, 0.2), (3, None), (4, 0.5)], "k int, x double")
    assert [r[0] for r in df.select(mean_exact(F.col("x"), 3, frame)).collect()] == [0.1, 0.15, 0.2, 0.5]


def test_conditional_count_of_null_conditions_is_zero(spark):
    df = spark.createDataFrame([(None,), (None,)], "x boolean")
    assert df.agg(n_where(F.col("x"))).first()[0] == 0
