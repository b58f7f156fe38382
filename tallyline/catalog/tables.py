"""Sources, sinks, profiles, cross-table checks and cleaning."""

import uuid

from pyspark.sql import functions as F

from ..functions.exprs import to_number
from ..operators import cleaning, season
from ..session import ensure_checkpoint_dir
from ..sources import checks, readers, writers
from . import fixtures as fx
from .registry import R, query


def scratch(spark, name):
    """A new folder beside the checkpoints, reachable by every executor."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("source_game_logs", f"""
SELECT player_id, CAST(COUNT(*) AS BIGINT) AS games, {R('SUM(GREATEST(pts - 20, 0))')} AS pts, {R('SUM(CASE WHEN ast > 1 THEN NULL ELSE ast END)')} AS ast FROM (
  SELECT CAST(player_id AS VARCHAR) AS player_id, pts, ast FROM box) b GROUP BY player_id""", ("box",))
def source_game_logs(spark, folder):
    """Game logs through CSV: negative points are clamped and unreadable assists become missing."""
    path = scratch(spark, "logs")
    fx.box(spark, folder).withColumns({
        "pts": F.col("pts") - 20, "ast": F.when(F.col("ast") > 1, "n/a").otherwise(F.col("ast").cast("string"))
    }).write.option("header", True).csv(path)
    return readers.read_game_logs(spark, path).groupBy("player_id").agg(F.count(F.lit(1)).alias("games"), F.sum("pts").alias("pts"), F.sum("ast").alias("ast"))


@query("source_quoted_lines", f"""SELECT stat, book, CAST(COUNT(*) AS BIGINT) AS n_lines, {R('SUM(line - 10)')} AS total FROM quoted WHERE line - 10 >= 0 GROUP BY stat, book""", ("quoted",))
def source_quoted_lines(spark, folder):
    path = scratch(spark, "lines")
    fx.quoted(spark, folder).withColumn("line", F.col("line") - 10).write.option("header", True).csv(path)
    return readers.read_quoted_lines(spark, path).groupBy("stat", "book").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("line").alias("total"))


@query("source_ticket_legs", f"""SELECT lower(direction) AS direction, CAST(COUNT(*) AS BIGINT) AS n_legs, {R('SUM(CASE WHEN stake - 1.04 <= 0 THEN 1.0 ELSE stake - 1.04 END)', 4)} AS staked
FROM legs WHERE stat <> 'blk' GROUP BY 1""", ("legs",))
def source_ticket_legs(spark, folder):
    path = scratch(spark, "legs")
    fx.legs(spark, folder).withColumns({"stake": F.col("stake") - 1.04, "direction": F.when(F.col("stat") == "blk", "push").otherwise(F.col("direction"))}).write.option(
        "header", True).csv(path)
    return readers.read_ticket_legs(spark, path).groupBy("direction").agg(F.count(F.lit(1)).alias("n_legs"), (F.rint(F.sum("stake") * 1e4) / 1e4).alias("staked"))


SEASON_SQL = """
SELECT 'P ' || CAST(l_suppkey AS VARCHAR) AS player_name, CAST(l_shipdate AS DATE) AS game_date_only, dayname(l_shipdate) AS day_of_week, month(l_shipdate) AS month,
  week(l_shipdate) AS week, l_quantity AS minutes_played, l_linenumber AS "PTS", l_linenumber - 3 AS "FGA", l_linenumber - 2 AS "FGM", l_linestatus = 'O' AS win
FROM lineitem WHERE l_quantity >= 5"""


@query("clean_season", f"""
WITH s AS ({SEASON_SQL}) SELECT day_of_week, CAST(month AS BIGINT) AS month, CAST(week AS BIGINT) AS week, win, CAST(COUNT(*) AS BIGINT) AS games, CAST(COUNT(DISTINCT player_name) AS BIGINT) AS players,
  {R('SUM(CASE WHEN "FGA" > 0 THEN CAST("FGM" AS DOUBLE) / "FGA" ELSE 0 END)')} AS fg_pct_total, {R('SUM("PTS" / minutes_played)')} AS pts_per_min_total FROM s GROUP BY 1, 2, 3, 4""")
def clean_season(spark, folder):
    """A wide season file written as CSV, read with its schema and cleaned."""
    path = scratch(spark, "season")
    n = F.col("l_linenumber")
    fx.table(spark, folder, "lineitem").select(
        F.lit("P").alias("firstName"), F.col("l_suppkey").cast("string").alias("lastName"), F.col("l_suppkey").alias("personId"), F.col("l_orderkey").alias("gameId"),
        F.col("l_shipdate").cast("timestamp").alias("gameDate"), F.lit("City").alias("playerteamCity"), F.lit("Team").alias("playerteamName"),
        F.lit("Other").alias("opponentteamCity"), F.lit("Side").alias("opponentteamName"), (F.col("l_linestatus") == "O").cast("int").alias("win"),
        (n % 2).alias("home"), F.col("l_quantity").alias("numMinutes"), n.alias("points"), n.alias("assists"), n.alias("reboundsTotal"), n.alias("threePointersMade"),
        n.alias("threePointersAttempted"), n.alias("freeThrowsMade"), n.alias("freeThrowsAttempted"), (n - 2).alias("fieldGoalsMade"), (n - 3).alias("fieldGoalsAttempted"),
    ).write.option("header", True).csv(path)
    clean = cleaning.clean_season(readers.read_season_box(spark, path))
    return clean.groupBy("day_of_week", "month", "week", "win").agg(
        F.count(F.lit(1)).alias("games"), F.count_distinct("player_name").alias("players"), F.sum("FG_PCT").alias("fg_pct_total"), F.sum("PTS_PER_MIN").alias("pts_per_min_total"))


@query("sink_partitioned_table", """SELECT CAST(game_date AS VARCHAR) AS game_date, CAST(COUNT(*) AS BIGINT) AS games FROM box
WHERE game_date BETWEEN DATE '1997-01-01' AND DATE '1997-03-31' GROUP BY game_date""", ("box",))
def sink_partitioned_table(spark, folder):
    """Written by month and date, read back with a partition filter."""
    path = scratch(spark, "box")
    writers.write_table(fx.box(spark, folder).withColumn("month", F.date_format("game_date", "yyyy-MM")), path, ["month"])
    back = readers.read_table(spark, path).filter(F.col("month").between("1997-01", "1997-03"))
    return back.groupBy("game_date").agg(F.count(F.lit(1)).alias("games"))


def _profile(table, columns):
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", '{t}' AS "type", CAST(COUNT({c}) AS BIGINT) AS non_null, CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS nulls,
        CAST(COUNT(DISTINCT {c}) AS BIGINT) AS "distinct" FROM {table}""" for c, t in columns.items())


@query("column_profile", _profile("legs", {"builder_id": "bigint", "stat": "string", "line": "double", "stake": "double", "game_date": "date"}), ("legs",))
def column_profile(spark, folder):
    return checks.column_profile(fx.legs(spark, folder), ["builder_id", "stat", "line", "stake", "game_date"])


D = ("l_quantity", "l_extendedprice", "l_discount")


@query("describe_measures", " UNION ALL ".join(f"""SELECT '{c}' AS "column", CAST(COUNT({c}) AS BIGINT) AS count, {R(f'AVG({c})', 4)} AS mean, {R(f'STDDEV_SAMP({c})', 4)} AS std,
{R(f'MIN({c})')} AS "min", {R(f'MAX({c})')} AS "max", CAST(COUNT(*) - COUNT({c}) AS BIGINT) AS missing, {R(f'quantile_cont({c}, 0.25)')} AS p25, {R(f'quantile_cont({c}, 0.5)')} AS p50,
{R(f'quantile_cont({c}, 0.75)')} AS p75, CAST(COUNT(DISTINCT {c}) AS BIGINT) AS "distinct", {R(f'(COUNT(*) - COUNT({c})) * 100.0 / COUNT(*)')} AS missing_pct FROM lineitem""" for c in D))
def describe_measures(spark, folder):
    table = season.describe(fx.table(spark, folder, "lineitem"), D)
    return table.withColumns({c: F.rint(F.col(c) * 1e4) / 1e4 for c in ("mean", "std")})


@query("value_counts_topk", f"""SELECT p_brand AS value, CAST(COUNT(*) AS BIGINT) AS "rows", {R('COUNT(*) * 1.0 / (SELECT COUNT(*) FROM part)')} AS share FROM part
GROUP BY p_brand ORDER BY "rows" DESC, value LIMIT 20""")
def value_counts_topk(spark, folder):
    return season.value_counts_table(fx.table(spark, folder, "part"), "p_brand")


# Logs without every seventh player and every eleventh game.
fx.SQL["thin_box"] = "SELECT * FROM box WHERE player_id % 7 <> 0 AND game_id % 11 <> 0"


def thin_box(spark, folder):
    return fx.box(spark, folder).filter("player_id % 7 <> 0 and game_id % 11 <> 0")


@query("consistency_counts", """
SELECT 'games_missing_from_logs' AS "check", CAST((SELECT COUNT(*) FROM (SELECT game_id FROM legs EXCEPT SELECT game_id FROM thin_box) a) AS VARCHAR) AS value
UNION ALL SELECT 'players_missing_from_logs', CAST((SELECT COUNT(*) FROM (SELECT player_id FROM legs EXCEPT SELECT player_id FROM thin_box) a) AS VARCHAR)
UNION ALL SELECT 'n_games_logs', CAST(COUNT(DISTINCT game_id) AS VARCHAR) FROM thin_box
UNION ALL SELECT 'n_games_tickets', CAST(COUNT(DISTINCT game_id) AS VARCHAR) FROM legs
UNION ALL SELECT 'n_players_logs', CAST(COUNT(DISTINCT player_id) AS VARCHAR) FROM thin_box
UNION ALL SELECT 'n_players_tickets', CAST(COUNT(DISTINCT player_id) AS VARCHAR) FROM legs
UNION ALL SELECT 'n_tickets', CAST(COUNT(DISTINCT builder_id) AS VARCHAR) FROM legs
UNION ALL SELECT 'first_date_logs', CAST(MIN(game_date) AS VARCHAR) FROM thin_box UNION ALL SELECT 'last_date_logs', CAST(MAX(game_date) AS VARCHAR) FROM thin_box
UNION ALL SELECT 'first_date_tickets', CAST(MIN(game_date) AS VARCHAR) FROM legs UNION ALL SELECT 'last_date_tickets', CAST(MAX(game_date) AS VARCHAR) FROM legs""",
       ("box", "legs", "thin_box"))
def consistency_counts(spark, folder):
    return checks.consistency_counts(thin_box(spark, folder), fx.legs(spark, folder))


@query("consistency_missing_keys", "SELECT DISTINCT player_id FROM legs WHERE player_id NOT IN (SELECT player_id FROM thin_box)", ("box", "legs", "thin_box"))
def consistency_missing_keys(spark, folder):
    return checks.missing_keys(fx.legs(spark, folder), thin_box(spark, folder), "player_id")


@query("invalid_odds", """SELECT 'over_odds' AS "column", CAST(COUNT(*) AS BIGINT) AS n_invalid FROM quoted WHERE over_odds - 0.8 < 1
UNION ALL SELECT 'under_odds', CAST(COUNT(*) AS BIGINT) FROM quoted WHERE under_odds - 0.8 < 1""", ("quoted",))
def invalid_odds(spark, folder):
    shifted = fx.quoted(spark, folder).withColumns({c: F.col(c) - 0.8 for c in ("over_odds", "under_odds")})
    return checks.invalid_odds(shifted, ["over_odds", "under_odds"])


@query("run_summary", f"""
SELECT 'n_games' AS metric, CAST(COUNT(DISTINCT game_id) AS DOUBLE) AS value FROM box UNION ALL SELECT 'n_players', CAST(COUNT(DISTINCT player_id) AS DOUBLE) FROM box
UNION ALL SELECT 'n_tickets', CAST(COUNT(*) AS DOUBLE) FROM tickets UNION ALL SELECT 'n_legs', CAST(SUM(n_legs) AS DOUBLE) FROM tickets
UNION ALL SELECT 'mean_legs', {R('AVG(n_legs)')} FROM tickets UNION ALL SELECT 'hit_rate', {R('AVG(builder_hit)')} FROM tickets""", fx.TICKET_FIXTURES)
def run_summary(spark, folder):
    return checks.run_summary(fx.box(spark, folder), fx.tickets(spark, folder, "n_legs", "builder_hit"))


@query("numeric_coercion", f"""SELECT event_type, CAST(COUNT(value) AS BIGINT) - CAST(SUM(CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS readable,
{R('SUM(CASE WHEN event_id % 5 <> 0 THEN value END)', 4)} AS total FROM events GROUP BY event_type""")
def numeric_coercion(spark, folder):
    text = F.when(F.col("event_id") % 10 == 0, "NaN").when(F.col("event_id") % 5 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return fx.table(spark, folder, "events").withColumn("v", to_number(text)).groupBy("event_type").agg(
        F.count("v").alias("readable"), (F.rint(F.sum("v") * 1e4) / 1e4).alias("total"))


@query("impute_median", f"""
WITH g AS (SELECT event_id, event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, event_type, {R('COALESCE(v, (SELECT quantile_cont(v, 0.5) FROM g))')} AS v FROM g""")
def impute_median(spark, folder):
    holes = fx.table(spark, folder, "events").select("event_id", "event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return cleaning.impute(holes, "median", ["v"])


@query("impute_mean", f"""
WITH g AS (SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_id, {R('COALESCE(v, (SELECT AVG(v) FROM g))')} AS v FROM g""")
def impute_mean(spark, folder):
    holes = fx.table(spark, folder, "events").select("event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    return cleaning.impute(holes, "mean", ["v"])


@query("impute_zero_or_drop", f"""
WITH g AS (SELECT event_type, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events)
SELECT event_type, 'zero' AS strategy, CAST(COUNT(*) AS BIGINT) AS "rows", {R('SUM(v)', 4)} AS total FROM g GROUP BY event_type
UNION ALL SELECT event_type, 'drop', CAST(COUNT(v) AS BIGINT), {R('SUM(v)', 4)} FROM g GROUP BY event_type""")
def impute_zero_or_drop(spark, folder):
    holes = fx.table(spark, folder, "events").select("event_type", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("v"))
    parts = [cleaning.impute(holes, s, ["v"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("rows"), (F.rint(F.sum("v") * 1e4) / 1e4).alias("total")).withColumn(
        "strategy", F.lit(s)) for s in ("zero", "drop")]
    return parts[0].unionByName(parts[1])


@query("active_entities", """SELECT event_id, player_id, stat FROM ev WHERE player_id IN (SELECT player_id FROM ev GROUP BY player_id HAVING COUNT(*) >= 65 AND AVG(value) >= 4800)""", ("ev",))
def active_entities(spark, folder):
    return cleaning.active_entities(fx.ev(spark, folder), min_games=65, minutes="value", min_minutes=4800.0).select("event_id", "player_id", "stat")


@query("guarded_ratios", f"""SELECT l_orderkey, {R('SUM(CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 0 END)')} AS tax_share,
{R('SUM(CASE WHEN l_linenumber - 3 > 0 THEN l_quantity / (l_linenumber - 3) ELSE 0 END)')} AS per_line FROM lineitem GROUP BY l_orderkey""")
def guarded_ratios(spark, folder):
    rows = fx.table(spark, folder, "lineitem").withColumn("den", F.col("l_linenumber") - 3)
    return cleaning.guarded_ratios(rows, {"a": ("l_tax", "l_discount"), "b": ("l_quantity", "den")}).groupBy("l_orderkey").agg(
        F.sum("a").alias("tax_share"), F.sum("b").alias("per_line"))


@query("date_parts", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS game_date_only, dayname(o_orderdate) AS day_of_week, CAST(month(o_orderdate) AS BIGINT) AS month,
CAST(week(o_orderdate) AS BIGINT) AS week FROM orders""")
def date_parts(spark, folder):
    return cleaning.date_parts(fx.table(spark, folder, "orders"), "o_orderdate").select("o_orderkey", "game_date_only", "day_of_week", "month", "week")


@query("category_codes", """SELECT event_id, DENSE_RANK() OVER (ORDER BY event_type) - 1 AS event_type_code, CASE WHEN event_id % 4 = 0 THEN -1
ELSE DENSE_RANK() OVER (ORDER BY CASE WHEN event_id % 4 = 0 THEN NULL ELSE user_id END NULLS LAST) - 1 END AS who_code FROM events""")
def category_codes(spark, folder):
    rows = fx.table(spark, folder, "events").select("event_id", "event_type", F.when(F.col("event_id") % 4 != 0, F.col("user_id")).alias("who"))
    return cleaning.category_codes(rows, ["event_type", "who", "absent"]).select("event_id", "event_type_code", "who_code")
