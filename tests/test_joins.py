"""The split outer join against Spark's own, with hot keys and nulls on both sides."""

import random

import pytest

from splitlens.operators import joins
from tests.helpers import assert_same


def sides(spark, seed=3, n=400):
    rng = random.Random(seed)
    left = [(rng.choice([1, 1, 1, 1, 2, 3, None, rng.randrange(4, 60)]), f"l{i % 5}") for i in range(n)]
    right = [(rng.choice([1, 2, 2, 2, 5, None, rng.randrange(30, 99)]), i % 3) for i in range(n // 4)]
    return (spark.createDataFrame(left, "k long, a string"),
            spark.createDataFrame(right, "k long, b int"))


@pytest.mark.parametrize("rows", [1, 10, 10 ** 6])
def test_equals_full_join(spark, rows):
    left, right = sides(spark)
    for a, b in ((left, right), (right, left), (left, right.limit(0)), (left.limit(0), right)):
        want = a.join(b, "k", "full").toPandas()
        assert_same(joins.full_outer(a, b, "k", rows=rows).toPandas(), want)


def test_several_columns(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, None, 2), (2, "y", 3)], "k int, m string, a int")
    b = spark.createDataFrame([(1, "x", 5), (1, None, 6), (3, "z", 7)], "k int, m string, b int")
    want = a.join(b, ["k", "m"], "full").toPandas()
    assert_same(joins.full_outer(a, b, ["k", "m"], rows=1).toPandas(), want)


def test_hot_keys_are_dealt_evenly(spark):
    """Copies of one row on the hot side are spread; the other side is repeated per salt."""
    left = spark.range(1000).selectExpr("7L as k", "1 as a")
    right = spark.createDataFrame([(7, 1), (8, 2)], "k long, b int")
    hot = joins.hot_keys(left, right, ["k"], 100)
    assert [tuple(r) for r in hot.collect()] == [(7, 10, True)]
    sizes = [r["count"] for r in joins._salted(left, ["k"], hot, True).groupBy("_salt").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 110
    assert joins._salted(right, ["k"], hot, False).count() == 11
    assert joins.full_outer(left, right, "k", rows=100).count() == 1001


def test_adaptive_execution_splits_the_skewed_side(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        left = spark.range(20000).repartition(8).selectExpr("if(id % 4 = 0, id, 7) as k", "id as a")
        right = spark.range(0, 30000, 3).selectExpr("id as k", "id as b")
        out = joins.full_outer(left, right, "k", rows=10 ** 6)
        out.write.format("noop").mode("overwrite").save()
        rows = out.collect()
        assert len(rows) == left.join(right, "k", "full").count()
        text = out._sc._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "simple")
        assert "skew=true" in text
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
