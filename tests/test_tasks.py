"""Groupings by order and ranks by entity keep few rows in a task, however many a split or a shuffle partition holds."""

import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from tallyline import session
from tallyline.catalog import QUERIES, fixtures as fx
from tallyline.operators import dependence
from tallyline.operators.legs import ticket_table
from tallyline.session import TASK_ROWS


@pytest.fixture
def sales(spark, tmp_path):
    n = F.col("id")
    lines = spark.range(4_000).select((n / 4).cast("long").alias("l_orderkey"), (n % 5).alias("l_partkey"), (n % 7).alias("l_suppkey"), (n % 4).cast("int").alias("l_linenumber"),
                                      (n % 9).cast("double").alias("l_quantity"), F.lit(0.05).alias("l_discount"), F.lit(0.02).alias("l_tax"),
                                      F.lit("R").alias("l_returnflag"), F.lit("O").alias("l_linestatus"))
    orders = spark.range(1_000).select(n.alias("o_orderkey"), F.lit(datetime.date(2020, 1, 1)).alias("o_orderdate"), F.lit("O").alias("o_orderstatus"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    orders.coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    hot = lines.withColumn("l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, 1).otherwise(F.col("l_orderkey")))
    hot.coalesce(1).write.parquet(f"{tmp_path}/hot/lineitem.parquet")
    spark.conf.set(TASK_ROWS, "100")
    yield str(tmp_path)
    spark.conf.unset(TASK_ROWS)


def fullest(df):
    return max(r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect())


def test_orders_are_dealt_by_rows(spark, sales):
    assert fullest(fx.box(spark, sales)) <= 300 and fullest(fx.legs(spark, sales)) <= 300
    assert fx.order_tasks(spark, sales) == 40 and fx.order_tasks(spark, f"{sales}/hot") is None


def test_ranks_are_dealt_by_rows(spark, sales):
    games = spark.range(4_000).select((F.col("id") % 200).alias("player_id"), (F.col("id") % 11).alias("pts"), (F.col("id") % 5).alias("ast"))
    ranked = dependence._ranked(games, ["player_id"], ["pts", "ast"])
    assert fullest(ranked) <= 300
    spark.conf.set(TASK_ROWS, "1000000")
    whole = dependence._ranked(games, ["player_id"], ["pts", "ast"])
    assert rows(ranked, "player_id", "pts", "ast") == rows(whole, "player_id", "pts", "ast")


@pytest.fixture
def shop(spark, tmp_path):
    """Orders that come twice with another status, line items that come twice, nulls, parts of several brands."""
    n = F.col("id")

    def unless(condition, c):
        return F.when(~condition, c)

    lines = spark.range(3_000).select(
        unless(n % 97 == 0, (n / 5).cast("long")).alias("l_orderkey"), unless(n % 31 == 0, n % 40).alias("l_partkey"), unless(n % 41 == 0, n % 7).alias("l_suppkey"),
        (n % 8).cast("int").alias("l_linenumber"), unless(n % 53 == 0, (n % 9).cast("double")).alias("l_quantity"), (n % 6 / 100).alias("l_discount"), (n % 4 / 100).alias("l_tax"),
        F.when(n % 3 == 0, "R").otherwise("N").alias("l_returnflag"), F.when(n % 2 == 0, "O").otherwise("F").alias("l_linestatus"))
    orders = spark.range(600).select(n.alias("o_orderkey"), unless(n % 19 == 0, F.date_add(F.lit(datetime.date(2020, 1, 1)), (n % 300).cast("int"))).alias("o_orderdate"),
                                     F.when(n % 3 == 0, "O").otherwise("F").alias("o_orderstatus"))
    part = spark.range(50).select((n % 45).alias("p_partkey"), (n % 12).cast("int").alias("p_size"), F.concat(F.lit("Brand#"), n % 9).alias("p_brand"))
    for name, whole, again in (("lineitem", lines, "l_linenumber = 2"), ("orders", orders, "o_orderkey % 7 = 0"), ("part", part, "p_partkey = 3")):
        twice = whole.filter(again)
        whole.unionByName(twice.withColumn("o_orderstatus", F.lit("P")) if name == "orders" else twice).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    spark.conf.set(TASK_ROWS, "500")
    yield str(tmp_path)
    spark.conf.unset(TASK_ROWS)


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_tickets_meet_where_line_items_were_dealt(spark, shop, monkeypatch, broadcast):
    """No exchange is behind a join: before, legs, results and quotes were dealt again by the keys of each."""
    before, plans, write = spark.conf.get("spark.sql.autoBroadcastJoinThreshold"), [], session.stored

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df)

    monkeypatch.setattr(session, "stored", noted)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        made = fx.tickets(spark, shop)
        plain = ticket_table(fx.leg_rows(spark, shop, 0))
        assert rows(made, "builder_id") == rows(plain, "builder_id")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plans[0].count("Exchange hashpartitioning(l_orderkey") == plans[0].count("Exchange hashpartitioning(o_orderkey") == 3
    # Line items and parts meet first, by part.
    assert plans[0].count("Exchange hashpartitioning") == (6 if broadcast != "-1" else 8)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


@pytest.mark.parametrize("name", ["ticket_returns_by_size", "ticket_rollup", "equity_curve", "drawdown"])
def test_ticket_queries_read_stored_tickets(spark, shop, name):
    assert "lineitem" not in QUERIES[name](spark, shop)._jdf.queryExecution().executedPlan().toString()
