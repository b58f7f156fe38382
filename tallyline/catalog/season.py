"""Season aggregates, consistency, hit rates and rankings."""

from pyspark.sql import functions as F

from ..operators import cleaning, season as ops
from . import fixtures as fx
from .registry import R, query


def R2(e):
    return f"round_even(({e})*100,0)/100"


def R3(e):
    return f"round_even(({e})*1000,0)/1000"


SPREAD = {"PTS": "PPG", "AST": "APG", "REB": "RPG", "FG3M": "FG3M_PG"}
fx.SQL["season"] = f"""
SELECT *, {R3('"PTS_STD" / NULLIF("PPG", 0)')} AS "PTS_CV", {R3('"AST_STD" / NULLIF("APG", 0)')} AS "AST_CV",
       {R3('"REB_STD" / NULLIF("RPG", 0)')} AS "REB_CV", {R3('"FG3M_STD" / NULLIF("FG3M_PG", 0)')} AS "FG3M_CV"
FROM (SELECT player_name, MIN("personId") AS player_id, COUNT("gameId") AS games_played,
  {', '.join(f'{R2(f"""AVG(CAST("{c}" AS DOUBLE))""")} AS "{n}"' for n, c in ops.PLAYER_AVERAGES.items())},
  {', '.join(f'{R2(f"""STDDEV_SAMP("{s}")""")} AS "{s}_STD"' for s in SPREAD)}, MIN(player_team) AS team
FROM games GROUP BY player_name HAVING COUNT("gameId") >= 10) s
"""
S = ("games", "season")


def season(spark, folder):
    return ops.player_season(fx.games(spark, folder), spread=SPREAD)


@query("season_aggregate", f"""
SELECT player_name, player_id, games_played, {', '.join(f'{R(chr(34) + n + chr(34))} AS "{n}"' for n in ops.PLAYER_AVERAGES)},
       {R('"PPG" + "APG"')} AS "PTS_AST", {R('"PPG" + "RPG"')} AS "PTS_REB", {R('"PPG" + "APG" + "RPG"')} AS "PTS_AST_REB" FROM season""", S)
def season_aggregate(spark, folder):
    return ops.player_season(fx.games(spark, folder), team=None)


@query("consistency_cv", f"""
SELECT player_name, {', '.join(f'{R(f"""{q}{s}_STD{q}""")} AS "{s}_STD", {R(f"""{q}{s}_CV{q}""")} AS "{s}_CV"' for q in ['"'] for s in SPREAD)}
FROM season""", S)
def consistency_cv(spark, folder):
    return season(spark, folder).select("player_name", *[f"{s}_{k}" for s in SPREAD for k in ("STD", "CV")])


@query("prop_candidates", f"""SELECT player_name, games_played, {R('"PPG"')} AS "PPG" FROM season WHERE games_played >= 12 AND "PPG" >= 100""", S)
def prop_candidates(spark, folder):
    return ops.prop_candidates(season(spark, folder), 12, ("PPG", 100.0)).select("player_name", "games_played", "PPG")


@query("elite_consistency", """SELECT player_name, games_played FROM season
WHERE games_played >= 10 AND "PTS_CV" < 0.5 AND "AST_CV" < 0.5 AND "REB_CV" < 0.6""", S)
def elite_consistency(spark, folder):
    return ops.elite_consistency(season(spark, folder), ("PTS", "AST"), 10, 0.5).filter(F.col("REB_CV") < 0.6).select("player_name", "games_played")


@query("consistent_by_stat", f"""
SELECT stat, player_name, games_played, {R('average')} AS average, {R('std')} AS std, {R('cv')} AS cv FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY stat ORDER BY average DESC, player_name) AS k FROM (
    {' UNION ALL '.join(f'''SELECT '{s}' AS stat, player_name, games_played, "{a}" AS average, "{s}_STD" AS std, "{s}_CV" AS cv FROM season
      WHERE games_played >= 10 AND "{a}" >= {f} AND "{s}_CV" < 0.5''' for s, (a, f) in ops.CONSISTENCY_FLOORS.items())}) a) b WHERE k <= 20""", S)
def consistent_by_stat(spark, folder):
    return ops.consistent_by_stat(season(spark, folder), min_games=10, max_cv=0.5)


@query("consistency_bands", """SELECT CASE WHEN "PTS_CV" < 0.4 THEN 'consistent' WHEN "PTS_CV" < 0.6 THEN 'mid' ELSE 'poor' END AS band,
CAST(COUNT(*) AS BIGINT) AS players FROM season GROUP BY 1""", S)
def consistency_bands(spark, folder):
    return season(spark, folder).groupBy(ops.consistency_band("PTS_CV").alias("band")).agg(F.count(F.lit(1)).alias("players"))


TEAM = {"avg_PTS": "PTS", "avg_AST": "AST", "avg_REB": "REB", "avg_3PM": "FG3M", "avg_STL": "STL", "avg_BLK": "BLK", "avg_TOV": "TOV",
        "avg_FG_PCT": "FG_PCT", "avg_3P_PCT": "FG3_PCT", "win_rate": "win", "avg_plus_minus": "PLUS_MINUS"}


@query("team_aggregate", f"""
SELECT player_team, COUNT("gameId") AS total_player_games,
  {', '.join(f'{R2(f"""AVG(CAST("{c}" AS DOUBLE))""")} + 0.0 AS "{n}"' for n, c in TEAM.items())}, COUNT(DISTINCT "personId") AS unique_players
FROM games GROUP BY player_team""", ("games",))
def team_aggregate(spark, folder):
    return ops.team_season(fx.games(spark, folder), averages=TEAM)


HOME = {"avg_PTS": "PTS", "avg_AST": "AST", "avg_REB": "REB", "FG_PCT": "FG_PCT", "win_rate": "win", "avg_plus_minus": "PLUS_MINUS"}
WIN = {"avg_PTS": "PTS", "avg_AST": "AST", "avg_REB": "REB", "avg_TOV": "TOV", "avg_STL": "STL", "avg_BLK": "BLK"}


def _split_sql(by, labels, columns):
    names = ["games", *columns]
    agg = ", ".join(f'{R3(f"""AVG(CAST("{c}" AS DOUBLE))""")} AS "{n}"' for n, c in columns.items())
    return f"""WITH s AS (SELECT "{by}" AS side_flag, CAST(COUNT("gameId") AS DOUBLE) AS games, {agg} FROM games GROUP BY "{by}")
SELECT CASE WHEN side_flag THEN '{labels[1]}' ELSE '{labels[0]}' END AS side, {', '.join(f'{R(chr(34) + n + chr(34))} AS "{n}"' for n in names)} FROM s
UNION ALL SELECT 'Difference', {', '.join(R(f'MAX("{n}") FILTER (side_flag) - MAX("{n}") FILTER (NOT side_flag)') for n in names)} FROM s HAVING COUNT(*) = 2"""


@query("home_away_diff", _split_sql("home", ("Away", "Home"), HOME), ("games",))
def home_away_diff(spark, folder):
    return ops.split_profile(fx.games(spark, folder), "home", HOME)


@query("win_loss_diff", _split_sql("win", ("Loss", "Win"), WIN), ("games",))
def win_loss_diff(spark, folder):
    return ops.split_profile(fx.games(spark, folder), "win", WIN, labels=("Loss", "Win"))


DAY = {"avg_PTS": "PTS", "avg_AST": "AST", "avg_REB": "REB", "win_rate": "win"}


@query("weekday_profile", f"""
SELECT CAST(isodow(game_date_only) - 1 AS BIGINT) AS day_index, dayname(game_date_only) AS day_of_week, COUNT("gameId") AS games,
  {', '.join(f'{R2(f"""AVG(CAST("{c}" AS DOUBLE))""")} + 0.0 AS "{n}"' for n, c in DAY.items())} FROM games GROUP BY 1, 2""", ("games",))
def weekday_profile(spark, folder):
    return ops.weekday_profile(fx.games(spark, folder), "game_date_only", DAY)


@query("daily_series", f"""
SELECT CAST(game_date_only AS VARCHAR) AS game_date_only, COUNT("gameId") AS games,
  {', '.join(f'{R(f"""AVG(CAST("{c}" AS DOUBLE))""")} AS "{n}"' for n, c in DAY.items())} FROM games GROUP BY game_date_only""", ("games",))
def daily_series(spark, folder):
    return ops.daily_series(fx.games(spark, folder), "game_date_only", DAY)


@query("season_summary", """
SELECT 'games' AS metric, CAST(COUNT(DISTINCT "gameId") AS VARCHAR) AS value FROM games
UNION ALL SELECT 'players', CAST(COUNT(DISTINCT player_name) AS VARCHAR) FROM games
UNION ALL SELECT 'teams', CAST(COUNT(DISTINCT player_team) AS VARCHAR) FROM games
UNION ALL SELECT 'first_date', CAST(MIN(game_date_only) AS VARCHAR) FROM games
UNION ALL SELECT 'last_date', CAST(MAX(game_date_only) AS VARCHAR) FROM games
UNION ALL SELECT 'avg_PTS', printf('%.2f', AVG("PTS")) FROM games
UNION ALL SELECT 'avg_AST', printf('%.2f', AVG("AST")) FROM games
UNION ALL SELECT 'avg_REB', printf('%.2f', AVG("REB")) FROM games
UNION ALL SELECT 'win_rate_pct', printf('%.1f', AVG(CAST(win AS DOUBLE)) * 100) FROM games
UNION ALL SELECT 'home_win_rate_pct', printf('%.1f', AVG(CAST(win AS DOUBLE)) FILTER (home) * 100) FROM games
UNION ALL SELECT 'away_win_rate_pct', printf('%.1f', AVG(CAST(win AS DOUBLE)) FILTER (NOT home) * 100) FROM games""", ("games",))
def season_summary(spark, folder):
    return ops.season_summary(fx.games(spark, folder), game="gameId", entity="player_name", team="player_team", date="game_date_only",
                              measures=["PTS", "AST", "REB"])


@query("modal_team", """
SELECT player_name, team FROM (SELECT player_name, CAST("AST" AS BIGINT)::VARCHAR AS team, COUNT(*) AS n,
  ROW_NUMBER() OVER (PARTITION BY player_name ORDER BY COUNT(*) DESC, CAST("AST" AS BIGINT)::VARCHAR) AS k FROM games GROUP BY 1, 2) t WHERE k = 1""", ("games",))
def modal_team(spark, folder):
    """The line count stands in for the team, so that a player has several."""
    traded = fx.games(spark, folder).withColumn("player_team", F.col("AST").cast("bigint").cast("string"))
    return ops.modal_team(traded)


RATE_STATS = {"PTS": "PPG", "AST": "APG", "REB": "RPG"}
OFFSETS = (-10, -5, 5, 10)
fx.SQL["rates"] = " UNION ALL ".join(f"""
SELECT g.player_name, s.team, COUNT(*) AS games, '{stat}' AS stat, s."{avg}" AS average, CAST({o} AS DOUBLE) AS "offset",
       CASE WHEN s."{avg}" <> 0 THEN AVG(CAST(COALESCE(g."{stat}" > s."{avg}" + {o}, FALSE) AS INTEGER)) * 100.0 END AS hit_rate
FROM games g JOIN season s USING (player_name) GROUP BY g.player_name, s.team, s."{avg}" HAVING COUNT(*) >= 10""" for stat, avg in RATE_STATS.items() for o in OFFSETS)
RATES = ("games", "season", "rates")


def rates(games):
    return ops.line_hit_rates(games, ops.player_season(games, spread=SPREAD), RATE_STATS)


@query("line_hit_rates", f"""SELECT player_name, team, games, stat, {R('average')} AS average, "offset", {R('hit_rate')} AS hit_rate FROM rates""", RATES)
def line_hit_rates(spark, folder):
    return rates(fx.stored(fx.games(spark, folder)))


@query("league_line_summary", f"""SELECT stat, "offset", {R('AVG(hit_rate)')} AS hit_rate FROM rates GROUP BY stat, "offset" """, RATES)
def league_line_summary(spark, folder):
    return ops.league_line_summary(rates(fx.stored(fx.games(spark, folder))))


@query("team_top15", f"""SELECT player_name, team, games, stat, {R('average')} AS average, "offset", {R('hit_rate')} AS hit_rate, team_rank FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY team, stat, "offset" ORDER BY average DESC, player_name) AS team_rank FROM rates) t WHERE team_rank <= 15""", RATES)
def team_top15(spark, folder):
    return ops.top_by_team(rates(fx.stored(fx.games(spark, folder))))


@query("team_roster_top15", f"""
WITH roster AS (SELECT DISTINCT CAST(CAST("AST" AS BIGINT) AS VARCHAR) AS team, player_name FROM games WHERE "AST" IS NOT NULL AND player_name IS NOT NULL)
SELECT player_name, team, games, stat, {R('average')} AS average, "offset", {R('hit_rate')} AS hit_rate, team_rank FROM (
SELECT r.player_name, o.team, games, stat, average, "offset", hit_rate, ROW_NUMBER() OVER (PARTITION BY o.team, stat, "offset" ORDER BY average DESC, r.player_name) AS team_rank
FROM rates r JOIN roster o USING (player_name)) t WHERE team_rank <= 15""", RATES)
def team_roster_top15(spark, folder):
    """The assist count stands in for the team, so that players change teams."""
    games = fx.stored(fx.games(spark, folder))
    return ops.top_by_roster(rates(games), games.withColumn("player_team", F.col("AST").cast("bigint").cast("string")))


@query("stat_top30", f"""SELECT player_name, team, games, stat, {R('average')} AS average, "offset", {R('hit_rate')} AS hit_rate, stat_rank FROM (
SELECT *, ROW_NUMBER() OVER (PARTITION BY stat, "offset" ORDER BY average DESC, player_name) AS stat_rank FROM rates) t WHERE stat_rank <= 30""", RATES)
def stat_top30(spark, folder):
    return ops.top_by_stat(rates(fx.stored(fx.games(spark, folder))))


@query("topk_games", """SELECT "gameId", player_name, "PTS", "AST", "REB" FROM games ORDER BY "PTS" DESC, "gameId" LIMIT 20""", ("games",))
def topk_games(spark, folder):
    return ops.top_rows(fx.games(spark, folder), "PTS", 20, ["gameId"]).select("gameId", "player_name", "PTS", "AST", "REB")


@query("topk_efficient", f"""SELECT player_name, {R('"FG_PCT"')} AS "FG_PCT" FROM season WHERE "PPG" >= 80 ORDER BY "FG_PCT" DESC, player_name LIMIT 20""", S)
def topk_efficient(spark, folder):
    return ops.top_rows(season(spark, folder).filter("PPG >= 80"), "FG_PCT", 20, ["player_name"]).select("player_name", "FG_PCT")


@query("two_stage_topk", f"""SELECT player_name, {R('"PPG"')} AS "PPG", {R('"PTS_CV"')} AS "PTS_CV" FROM
(SELECT * FROM season ORDER BY "PPG" DESC, player_name LIMIT 15) t ORDER BY "PTS_CV", player_name LIMIT 15""", S)
def two_stage_topk(spark, folder):
    return ops.two_stage_top(season(spark, folder), "PPG", "PTS_CV", 15, ["player_name"]).select("player_name", "PPG", "PTS_CV")


@query("bottomk_floor", f"""SELECT player_name, {R('"APG"')} AS "APG", {R('"AST_CV"')} AS "AST_CV" FROM season WHERE "APG" >= 4
ORDER BY "AST_CV" NULLS LAST, player_name LIMIT 15""", S)
def bottomk_floor(spark, folder):
    return ops.bottom_rows(season(spark, folder).filter("APG >= 4"), "AST_CV", 15, ["player_name"]).select("player_name", "APG", "AST_CV")


@query("preview_rows", f"""SELECT "gameId", "PTS", {R2('"FT_PCT"')} AS "FT_PCT", 'head' AS part FROM (SELECT * FROM games ORDER BY "gameId" LIMIT 10) a
UNION ALL SELECT "gameId", "PTS", {R2('"FT_PCT"')}, 'tail' FROM (SELECT * FROM games ORDER BY "gameId" DESC LIMIT 10) b""", ("games",))
def preview_rows(spark, folder):
    return ops.preview(fx.games(spark, folder).select("gameId", "PTS", "FT_PCT"), ["gameId"], 20)


@query("find_entities", """SELECT DISTINCT player_name, CAST(CASE WHEN lower(player_name) = 'customer#000000012' THEN 0 ELSE 1 END AS BIGINT) AS match_rank
FROM games WHERE contains(lower(player_name), 'customer#000000012')
UNION ALL SELECT DISTINCT player_name, CAST(1 AS BIGINT) FROM games WHERE contains(lower(player_name), '77')""", ("games",))
def find_entities(spark, folder):
    g = fx.games(spark, folder)
    return cleaning.find_entities(g, "player_name", "CUSTOMER#000000012").unionByName(cleaning.find_entities(g, "player_name", "77"))


@query("date_range", """SELECT CAST(game_date_only AS VARCHAR) AS game_date_only, CAST(COUNT(*) AS BIGINT) AS games FROM games
WHERE game_date_only BETWEEN DATE '1996-03-01' AND DATE '1997-02-28' GROUP BY game_date_only""", ("games",))
def date_range(spark, folder):
    return cleaning.date_range(fx.games(spark, folder), "game_date_only", "1996-03-01", "1997-02-28").groupBy("game_date_only").agg(
        F.count(F.lit(1)).alias("games"))
