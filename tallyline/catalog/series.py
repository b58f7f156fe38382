"""Order-dependent queries: rest gaps, rolling and trailing means, streaks, running totals."""

from pyspark.sql import functions as F

from ..operators import cleaning, windows as ops
from . import fixtures as fx
from .registry import R, query

fx.SQL["gaps"] = """
SELECT *, date_diff('day', LAG(game_date) OVER (PARTITION BY player_id ORDER BY game_date, event_id), game_date) AS gap FROM ev
"""


@query("rest_days", """SELECT event_id, player_id, CAST(COALESCE(gap, (SELECT quantile_cont(gap, 0.5) FROM gaps)) AS DOUBLE) AS days_rest FROM gaps""",
       ("ev", "gaps"))
def rest_days(spark, folder):
    return ops.rest_days(fx.ev(spark, folder), tiebreak="event_id").select("event_id", "player_id", "days_rest")


@query("context_features", f"""
WITH g AS (SELECT *, date_diff('day', LAG(game_date) OVER (PARTITION BY player_id ORDER BY game_date, game_id), game_date) AS gap FROM box)
SELECT player_id, {R("AVG(CASE WHEN home_away = 'H' THEN 1 ELSE 0 END)")} AS home_share,
       {R('AVG(COALESCE(gap, (SELECT quantile_cont(gap, 0.5) FROM g)))')} AS mean_rest FROM g GROUP BY player_id""", ("box",))
def context_features(spark, folder):
    return cleaning.context_features(fx.stored(fx.box(spark, folder))).groupBy("player_id").agg(
        F.avg("is_home").alias("home_share"), F.avg("days_rest").alias("mean_rest"))


@query("rolling_means", f"""
SELECT event_id, {', '.join(f'''{R(f"""AVG(value) OVER (PARTITION BY player_id ORDER BY game_date, event_id
  ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)""", 4)} AS value_rolling_{w}''' for w in (5, 10, 20))} FROM ev""", ("ev",))
def rolling_means(spark, folder):
    rolled = ops.rolling_means(fx.ev(spark, folder), ["value"], tiebreak="event_id")
    return rolled.select("event_id", *[(F.rint(F.col(f"value_rolling_{w}") * 1e4) / 1e4).alias(f"value_rolling_{w}") for w in (5, 10, 20)])


fx.SQL["nightly"] = """
SELECT game_date, COUNT(*) AS n_events, SUM(CASE WHEN stat = 'purchase' THEN 1 ELSE 0 END) AS hits,
       SUM(CASE WHEN stat = 'purchase' THEN 1 ELSE 0 END) * 5 > COUNT(*) AS won FROM ev GROUP BY game_date
"""


def nightly(spark, folder):
    hits = F.count_if(F.col("stat") == "purchase")
    return fx.ev(spark, folder).groupBy("game_date").agg(
        F.count(F.lit(1)).alias("n_events"), hits.alias("hits"), (hits * 5 > F.count(F.lit(1))).alias("won"))


@query("trailing_win_rate", f"""SELECT CAST(game_date AS VARCHAR) AS game_date,
{R('AVG(CAST(won AS INTEGER)) OVER (ORDER BY game_date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)')} AS win_rate FROM nightly""", ("ev", "nightly"))
def trailing_win_rate(spark, folder):
    nights = nightly(spark, folder).withColumn("w", F.col("won").cast("int"))
    return ops.trailing_mean(nights, "w", 7, order=["game_date"], out="win_rate").select("game_date", "win_rate")


STREAKS = """
WITH c AS (SELECT *, CASE WHEN won = LAG(won) OVER (PARTITION BY player_id ORDER BY event_id) THEN 0 ELSE 1 END AS fresh
  FROM (SELECT player_id, event_id, value > 5000 AS won FROM ev) e),
g AS (SELECT *, SUM(fresh) OVER (PARTITION BY player_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS island FROM c),
s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY player_id, island ORDER BY event_id) AS len FROM g)
"""


@query("streaks", f"""{STREAKS} SELECT player_id, event_id, CASE WHEN won THEN len ELSE 0 END AS win_streak,
CASE WHEN won THEN 0 ELSE len END AS loss_streak FROM s""", ("ev",))
def streaks(spark, folder):
    rows = fx.ev(spark, folder).select("player_id", "event_id", (F.col("value") > 5000).alias("won"))
    return ops.streaks(rows, "won", order=["event_id"], keys=["player_id"]).select("player_id", "event_id", "win_streak", "loss_streak")


@query("longest_streaks", f"""{STREAKS} SELECT player_id, CAST(MAX(CASE WHEN won THEN len ELSE 0 END) AS BIGINT) AS max_win_streak,
CAST(MAX(CASE WHEN won THEN 0 ELSE len END) AS BIGINT) AS max_loss_streak FROM s GROUP BY player_id""", ("ev",))
def longest_streaks(spark, folder):
    rows = fx.ev(spark, folder).select("player_id", "event_id", (F.col("value") > 5000).alias("won"))
    return ops.longest_streaks(rows, "won", order=["event_id"], keys=["player_id"])


@query("cumulative_counts", """SELECT event_id, CAST(SUM(CASE WHEN stat = 'purchase' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS cum_hits,
CAST(COUNT(*) OVER w AS BIGINT) AS n_so_far FROM ev WINDOW w AS (PARTITION BY player_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""", ("ev",))
def cumulative_counts(spark, folder):
    return ops.cumulative(fx.ev(spark, folder), {"cum_hits": (F.col("stat") == "purchase").cast("int")}, order=["event_id"],
                          keys=["player_id"]).select("event_id", "cum_hits", "n_so_far")


@query("average_ranks", f"""
SELECT player_id, value, CAST(COUNT(*) AS BIGINT) AS weight, {R('AVG(rk + (ties - 1) / 2.0)')} AS avg_rank FROM (
  SELECT player_id, value, RANK() OVER (PARTITION BY player_id ORDER BY value) AS rk, COUNT(*) OVER (PARTITION BY player_id, value) AS ties FROM ev) t
GROUP BY player_id, value""", ("ev",))
def average_ranks(spark, folder):
    from ..functions.ordered import average_ranks as ranks
    return ranks(fx.ev(spark, folder), ["player_id"], "value").select("player_id", "value", "weight", "avg_rank")
