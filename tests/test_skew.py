"""Joins that deal hot keys, found by a sketch, over several tasks."""

import pytest
from pyspark.sql import functions as F

from tallyline.functions.ordered import heavy_keys, join_spread


@pytest.fixture
def fixed_plan(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    spark.conf.unset("spark.sql.adaptive.enabled")
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def facts(spark, rows=60_000):
    """A third of the rows under one key, the rest under many, some under none."""
    key = F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 1000 == 1, None).otherwise(F.col("id") % 5000)
    return spark.range(rows, numPartitions=8).select(key.alias("k"), (F.col("id") % 97).cast("double").alias("v"), "id")


def test_only_hot_keys_are_found(spark):
    heavy = heavy_keys(facts(spark), ["k"], 16)
    hot = spark.range(1).select(F.xxhash64(F.lit(-1).cast("bigint"))).first()[0]
    assert heavy == {hot: 6}
    assert heavy_keys(spark.range(10_000).withColumnRenamed("id", "k"), ["k"], 16) == {}
    assert heavy_keys(spark.createDataFrame([], "k int"), ["k"], 16) == {}
    two = facts(spark).withColumn("j", F.lit("x"))
    assert list(heavy_keys(two, ["k", "j"], 16).values()) == [6]


def test_hot_key_is_spread_without_adaptive_execution(spark, fixed_plan):
    left = facts(spark)
    right = left.dropna(subset=["k"]).groupBy("k").agg(F.max("v").alias("top"))
    spread = join_spread(left, right, ["k"], tasks=16)
    plain = left.join(right, "k")
    by_task, whole = ([r["count"] for r in df.filter("k = -1").groupBy(F.spark_partition_id()).count().collect()] for df in (spread, plain))
    assert whole == [20_000] and len(by_task) >= 4 and max(by_task) <= 10_000 and sum(by_task) == 20_000
    assert spread.columns == plain.columns
    assert spread.exceptAll(plain).count() == 0 and plain.exceptAll(spread).count() == 0


@pytest.mark.parametrize("tasks", [1, 2, 500])
def test_result_does_not_depend_on_the_tasks(spark, tasks):
    left = facts(spark, 6_000).union(facts(spark, 300))
    right = spark.createDataFrame([(-1, "hot"), (7, "seven"), (8, None), (None, "nothing")], "k long, name string")
    got = sorted(tuple(r) for r in join_spread(left, right, ["k"], tasks).select("k", "id", F.coalesce("name", F.lit("")).alias("n")).collect())
    want = sorted(tuple(r) for r in left.join(right, "k").select("k", "id", F.coalesce("name", F.lit("")).alias("n")).collect())
    assert got == want and got
