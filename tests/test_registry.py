"""Replacing a table in one registry: what the others and derived tables see."""

from caselight.sources.registry import Registry


def test_put_stays_in_its_registry(spark):
    first, second = spark.range(3), spark.range(5)
    reg = Registry(spark, {"t": lambda _reg: first})
    assert reg.raw("t").count() == 3
    other = reg.as_user("someone")
    other.put("t", second)
    assert other.raw("t").count() == 5 and reg.raw("t").count() == 3
    reg.put("t", spark.range(7))
    assert reg.raw("t").count() == 7 and other.raw("t").count() == 5


def test_put_renews_derived_tables(spark):
    reg = Registry(spark, {"base": lambda _reg: spark.range(3), "twice": lambda r: r.raw("base").union(r.raw("base"))})
    assert reg.raw("twice").count() == 6
    reg.put("base", spark.range(4))
    assert reg.raw("twice").count() == 8
