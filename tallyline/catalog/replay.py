"""Template and ticket replay over nightly facts."""

from pyspark.sql import functions as F

from ..operators import replay as ops, season as season_ops
from ..operators.replay import Facts
from . import fixtures as fx
from .registry import R, query
from .season import RATES, rates

FACTS = Facts(stats=("PTS", "AST", "REB", "MIN"))
# A template whose names match one user, several users and nobody.
TEMPLATE = {"name": "three legs", "legs": [
    {"name": "first", "props": [{"player": "U12", "stat": "PTS", "line": 0.5, "over": True}, {"player": "u7", "stat": "REB", "line": 3.0, "over": False}]},
    {"name": "second", "props": [{"player": "u140", "stat": "AST", "line": 0.5, "over": False}, {"player": "u3", "stat": "MIN", "line": 40.0, "over": True}]},
    {"name": "third", "props": [{"player": "u9", "stat": "PTS", "line": 2.5, "over": False}, {"player": "nobody", "stat": "PTS", "line": 1.5, "over": True},
                                {"player": "u5", "stat": "DUNKS", "line": 1.5, "over": True}]},
]}
TICKETS = [
    {"date": f"2024-01-{day:02d}", **({"odds": 1.5 + day / 10} if day % 3 else {}), "props": [
        {"player": f"Some u{day}", "stat": "PTS", "line": 0.5, "over": True}, {"player": "u1", "stat": "REB", "line": 2.5, "over": day % 2 == 0},
        {"player": "u99", "stat": "MIN", "line": 50.0, "over": False}][: 1 + day % 3]}
    for day in range(1, 29)
] + [{"date": "2030-01-01", "odds": 9.0, "props": [{"player": "u1", "stat": "PTS", "line": 0.5, "over": True}]}]


def _values(rows):
    return ", ".join("(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)


fx.SQL["template"] = "SELECT leg, leg_name, prop, needle, stat, CAST(line AS DOUBLE) AS line, over_ FROM (VALUES " + _values(
    (i, leg["name"], j, p["player"].lower(), p["stat"], p["line"], p["over"]) for i, leg in enumerate(TEMPLATE["legs"], 1) for j, p in enumerate(leg["props"], 1)
) + ") t(leg, leg_name, prop, needle, stat, line, over_)"
RESULT = """CASE t.stat WHEN 'PTS' THEN "PTS" WHEN 'AST' THEN "AST" WHEN 'REB' THEN "REB" WHEN 'MIN' THEN "MIN" END"""
fx.SQL["night_season"] = """
SELECT *, round_even(pts_std / NULLIF(ppg, 0) * 1000, 0) / 1000 AS pts_cv, round_even(reb_std / NULLIF(rpg, 0) * 1000, 0) / 1000 AS reb_cv FROM (
  SELECT player_name, round_even(AVG("PTS") * 100, 0) / 100 AS ppg, round_even(AVG("REB") * 100, 0) / 100 AS rpg,
         round_even(STDDEV_SAMP("PTS") * 100, 0) / 100 AS pts_std, round_even(STDDEV_SAMP("REB") * 100, 0) / 100 AS reb_std
  FROM night_box GROUP BY player_name HAVING COUNT(*) >= 10) s"""
fx.SQL["lookup"] = """
SELECT leg, prop, CASE stat WHEN 'PTS' THEN pts_cv WHEN 'REB' THEN reb_cv END AS cv, CASE stat WHEN 'PTS' THEN ppg WHEN 'REB' THEN rpg END AS player_avg FROM (
  SELECT leg, prop, t.stat, s.*, ROW_NUMBER() OVER (PARTITION BY leg, prop ORDER BY ppg DESC, player_name) AS k FROM template t JOIN night_season s
  ON contains(lower(player_name), needle)) m WHERE k = 1"""
fx.SQL["settled"] = f"""
SELECT m.*, result - line AS margin, COALESCE(CASE WHEN over_ THEN result > line ELSE result < line END, FALSE) AS hit, l.cv, l.player_avg FROM (
  SELECT game_date_only AS date, leg, prop, t.stat, line, over_, player_name AS player, {RESULT} AS result,
         ROW_NUMBER() OVER (PARTITION BY game_date_only, leg, prop ORDER BY player_name, "gameId") AS k
  FROM night_box n JOIN template t ON contains(lower(player_name), needle) WHERE t.stat IN ('PTS', 'AST', 'REB', 'MIN')) m
LEFT JOIN lookup l USING (leg, prop) WHERE k = 1"""
fx.SQL["leg_nights"] = """
SELECT n.date, t.leg, t.leg_name, COALESCE(e, 0) AS props_evaluated, COALESCE(h, 0) AS props_hit, COALESCE(h * 100.0 / e, 0) AS hit_rate, COALESCE(e > 0 AND h = e, FALSE) AS leg_won
FROM (SELECT DISTINCT game_date_only AS date FROM night_box) n CROSS JOIN (SELECT DISTINCT leg, leg_name FROM template) t
LEFT JOIN (SELECT date, leg, COUNT(*) AS e, SUM(CAST(hit AS INTEGER)) AS h FROM settled GROUP BY 1, 2) s ON s.date = n.date AND s.leg = t.leg"""
fx.SQL["acca_nights"] = """
SELECT date, COUNT(*) AS legs_evaluated, SUM(CAST(leg_won AS INTEGER)) AS legs_won, BOOL_AND(leg_won) AS acca_won FROM leg_nights GROUP BY date"""
P = ("night_box", "template", "night_season", "lookup", "settled")
N = (*P, "leg_nights", "acca_nights")
# A lighter template, won often enough to show streaks.
EASY = {"name": "easy", "legs": [{"name": "only", "props": [{"player": "u1", "stat": "REB", "line": 1.5, "over": True}]}]}
fx.SQL["easy_nights"] = """
SELECT d.date, COALESCE(won, FALSE) AS acca_won, CAST(COALESCE(won, FALSE) AS INTEGER) AS w FROM (SELECT DISTINCT game_date_only AS date FROM night_box) d LEFT JOIN (
  SELECT date, v > 1.5 AS won FROM (SELECT game_date_only AS date, "REB" AS v, ROW_NUMBER() OVER (PARTITION BY game_date_only ORDER BY player_name, "gameId") AS k
  FROM night_box WHERE contains(player_name, 'u1')) f WHERE k = 1) s USING (date)"""


def night_season(nights):
    return season_ops.player_season(nights, entity_id="gameId", team=None, averages={"PPG": "PTS", "RPG": "REB"},
                                    spread={"PTS": "PPG", "REB": "RPG"}, composites={})


def replayed(spark, folder):
    nights = fx.stored(fx.night_box(spark, folder))
    lookup = ops.season_lookup(night_season(nights), TEMPLATE["legs"], averages={"PTS": "PPG", "REB": "RPG"})
    return ops.replay_template(nights, TEMPLATE, FACTS, lookup=lookup)


def easy(spark, folder):
    return ops.replay_template(fx.stored(fx.night_box(spark, folder)), EASY, FACTS).nights


@query("parlay_replay_props", f"""SELECT CAST(date AS VARCHAR) AS date, CAST(leg AS BIGINT) AS leg, CAST(prop AS BIGINT) AS prop, player, stat, {R('line')} AS line,
{R('result')} AS result, {R('margin')} AS margin, hit, {R('cv')} AS cv, {R('player_avg')} AS player_avg FROM settled""", P)
def parlay_replay_props(spark, folder):
    return replayed(spark, folder).props.drop("over")


@query("parlay_replay_legs", f"""SELECT CAST(date AS VARCHAR) AS date, CAST(leg AS BIGINT) AS leg, leg_name, CAST(props_evaluated AS BIGINT) AS props_evaluated,
CAST(props_hit AS BIGINT) AS props_hit, {R('hit_rate')} AS hit_rate, leg_won FROM leg_nights""", N)
def parlay_replay_legs(spark, folder):
    return replayed(spark, folder).legs


@query("parlay_replay_nights", """SELECT CAST(date AS VARCHAR) AS date, CAST(legs_evaluated AS BIGINT) AS legs_evaluated, CAST(legs_won AS BIGINT) AS legs_won, acca_won FROM acca_nights""", N)
def parlay_replay_nights(spark, folder):
    return replayed(spark, folder).nights


@query("parlay_replay_range", """SELECT CAST(COUNT(*) AS BIGINT) AS nights_tested, CAST(SUM(w) AS BIGINT) AS accas_won FROM easy_nights
WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'""", ("night_box", "easy_nights"))
def parlay_replay_range(spark, folder):
    run = ops.replay_template(fx.stored(fx.night_box(spark, folder)), EASY, FACTS, start="2024-01-05", end="2024-01-20")
    return ops.replay_summary(run.nights).select("nights_tested", "accas_won")


@query("parlay_legs_won", """SELECT CAST(legs_won AS BIGINT) AS legs_won, CAST(COUNT(*) AS BIGINT) AS nights FROM acca_nights GROUP BY 1""", N)
def parlay_legs_won(spark, folder):
    return ops.legs_won_counts(replayed(spark, folder).nights)


R2 = "round_even(({})*100,0)/100"


@query("parlay_prop_success", f"""SELECT player, stat, hits, total, hit_rate, avg_margin + 0.0 AS avg_margin, round_even(hit_rate * 1000, 0) / 10 AS hit_pct FROM (
SELECT player, stat, CAST(SUM(CAST(hit AS INTEGER)) AS BIGINT) AS hits, CAST(COUNT(*) AS BIGINT) AS total, {R2.format('AVG(CAST(hit AS INTEGER))')} AS hit_rate,
{R2.format('AVG(margin)')} AS avg_margin FROM settled GROUP BY player, stat) s""", P)
def parlay_prop_success(spark, folder):
    return ops.prop_success(replayed(spark, folder).props).drop("avg_cv")


@query("parlay_prop_cv", f"""SELECT player, stat, {R('AVG(cv)')} AS mean_cv FROM settled GROUP BY player, stat""", P)
def parlay_prop_cv(spark, folder):
    """A player's CV is one number; at 2 places its mean can fall on a rounding tie, so 6 are compared."""
    return replayed(spark, folder).props.groupBy("player", "stat").agg(F.avg("cv").alias("mean_cv"))


@query("parlay_success_by_stat", f"""SELECT stat, CAST(SUM(CAST(hit AS INTEGER)) AS BIGINT) AS hits, CAST(COUNT(*) AS BIGINT) AS total, {R('AVG(CAST(hit AS INTEGER)) * 100')} AS hit_pct
FROM settled GROUP BY stat""", P)
def parlay_success_by_stat(spark, folder):
    return ops.success_by(replayed(spark, folder).props, "stat", "stat")


@query("parlay_success_by_player", f"""SELECT player, CAST(SUM(CAST(hit AS INTEGER)) AS BIGINT) AS hits, CAST(COUNT(*) AS BIGINT) AS total, {R('AVG(CAST(hit AS INTEGER)) * 100')} AS hit_pct
FROM settled GROUP BY player""", P)
def parlay_success_by_player(spark, folder):
    return ops.success_by(replayed(spark, folder).props, "player", "player")


@query("parlay_weekday_rate", f"""SELECT CAST(isodow(date) - 1 AS BIGINT) AS day_index, dayname(date) AS day_of_week, CAST(COUNT(*) AS BIGINT) AS nights, {R('AVG(w) * 100')} AS win_rate
FROM easy_nights GROUP BY 1, 2""", ("night_box", "easy_nights"))
def parlay_weekday_rate(spark, folder):
    return ops.night_success_by_weekday(easy(spark, folder))


@query("parlay_night_series", f"""
WITH f AS (SELECT *, CASE WHEN acca_won = LAG(acca_won) OVER (ORDER BY date) THEN 0 ELSE 1 END AS fresh FROM easy_nights),
g AS (SELECT *, SUM(fresh) OVER (ORDER BY date) AS island FROM f)
SELECT CAST(date AS VARCHAR) AS date, acca_won, CASE WHEN acca_won THEN ROW_NUMBER() OVER (PARTITION BY island ORDER BY date) ELSE 0 END AS win_streak,
  CASE WHEN acca_won THEN 0 ELSE ROW_NUMBER() OVER (PARTITION BY island ORDER BY date) END AS loss_streak, CAST(SUM(w) OVER (ORDER BY date) AS BIGINT) AS cum_wins,
  ROW_NUMBER() OVER (ORDER BY date) AS n_so_far, {R('AVG(w) OVER (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) * 100')} AS trailing_win_rate FROM g""", ("night_box", "easy_nights"))
def parlay_night_series(spark, folder):
    return ops.night_series(easy(spark, folder)).drop("legs_evaluated", "legs_won")


@query("close_calls", f"""SELECT CAST(date AS VARCHAR) AS date, player, stat, {R('margin')} AS margin FROM settled WHERE ABS(margin) < 2""", P)
def close_calls(spark, folder):
    return ops.close_calls(replayed(spark, folder).props).select("date", "player", "stat", "margin")


@query("top_margins", f"""SELECT CAST(date AS VARCHAR) AS date, player, stat, {R('margin')} AS margin FROM settled ORDER BY margin DESC NULLS LAST, date, leg, prop LIMIT 5""", P)
def top_margins(spark, folder):
    return season_ops.top_rows(replayed(spark, folder).props, "margin", 5, ["date", "leg", "prop"]).select("date", "player", "stat", "margin")


@query("margin_summary", f"""SELECT {R('AVG(margin)')} AS mean_margin, {R('MIN(margin)')} AS min_margin, {R('MAX(margin)')} AS max_margin, {R('quantile_cont(margin, 0.5)')} AS median_margin FROM settled""", P)
def margin_summary(spark, folder):
    return ops.margin_summary(replayed(spark, folder).props)


@query("hits_by_consistency", """SELECT 'consistent' AS band, CAST(COUNT(*) AS BIGINT) AS hits FROM settled WHERE hit AND cv < 0.4
UNION ALL SELECT 'inconsistent', CAST(COUNT(*) AS BIGINT) FROM settled WHERE hit AND cv >= 0.4""", P)
def hits_by_consistency(spark, folder):
    return ops.hits_by_consistency(replayed(spark, folder).props)


@query("reliable_players", f"""SELECT player, CAST(SUM(CAST(hit AS INTEGER)) AS BIGINT) AS hits, {R('AVG(margin)')} AS avg_margin FROM settled GROUP BY player
HAVING SUM(CAST(hit AS INTEGER)) > 0""", P)
def reliable_players(spark, folder):
    return ops.reliable_players(replayed(spark, folder).props)


FLAT = [p for leg in TEMPLATE["legs"] for p in leg["props"]]


@query("sampled_replay_all", f"""SELECT CAST(date AS VARCHAR) AS date, CAST(SUM(CAST(hit AS INTEGER)) AS BIGINT) AS props_hit, CAST(COUNT(*) AS BIGINT) AS props_tested,
BOOL_AND(hit) AS acca_hit, {R('AVG(CAST(hit AS INTEGER)) * 100')} AS hit_rate FROM settled GROUP BY date""", P)
def sampled_replay_all(spark, folder):
    """Every night there is."""
    return ops.replay_sampled(fx.night_box(spark, folder), FLAT, None, FACTS)[0]


@query("sampled_replay", f"""
WITH chosen AS (SELECT DISTINCT game_date_only AS date FROM night_box WHERE game_date_only IS NOT NULL ORDER BY md5(CAST(game_date_only AS DATE)::VARCHAR || '|42'), 1 LIMIT 10)
SELECT CAST(s.date AS VARCHAR) AS date, CAST(SUM(CAST(hit AS INTEGER)) AS BIGINT) AS props_hit, CAST(COUNT(*) AS BIGINT) AS props_tested,
BOOL_AND(hit) AS acca_hit, {R('AVG(CAST(hit AS INTEGER)) * 100')} AS hit_rate FROM settled s JOIN chosen c ON s.date = c.date GROUP BY s.date""", P)
def sampled_replay(spark, folder):
    return ops.replay_sampled(fx.night_box(spark, folder), FLAT, 10, FACTS)[0]


fx.SQL["ticket_props"] = "SELECT ticket, CAST(date AS DATE) AS date, CAST(odds AS DOUBLE) AS odds, prop, needle, stat, CAST(line AS DOUBLE) AS line, over_ FROM (VALUES " + _values(
    (i, t["date"], t.get("odds", 1.0), j, p["player"].lower().split()[-1], p["stat"], p["line"], p["over"])
    for i, t in enumerate(TICKETS, 1) for j, p in enumerate(t["props"], 1)) + ") t(ticket, date, odds, prop, needle, stat, line, over_)"
fx.SQL["ticket_settled"] = f"""
SELECT m.*, result - line AS margin, COALESCE(CASE WHEN over_ THEN result > line ELSE result < line END, FALSE) AS hit FROM (
  SELECT t.*, player_name AS player, {RESULT} AS result, ROW_NUMBER() OVER (PARTITION BY ticket, prop ORDER BY player_name, "gameId") AS k
  FROM night_box n JOIN ticket_props t ON n.game_date_only = t.date AND contains(player_name, needle)) m WHERE k = 1"""
fx.SQL["dated"] = """
SELECT ticket, date, odds, COUNT(*) AS total_props, SUM(CAST(hit AS INTEGER)) AS props_hit, BOOL_AND(hit) AS leg_won, AVG(CAST(hit AS INTEGER)) * 100 AS hit_rate,
       CASE WHEN odds > 0 THEN 1 / odds ELSE 1.0 END AS implied_prob FROM ticket_settled GROUP BY ticket, date, odds"""
D = ("night_box", "ticket_props", "ticket_settled", "dated")


def dated(spark, folder):
    nights = fx.stored(fx.night_box(spark, folder))
    return ops.settle_tickets(nights, TICKETS, FACTS, season=night_season(nights), averages={"PTS": "PPG", "REB": "RPG"})


@query("dated_tickets", f"""SELECT CAST(ticket AS BIGINT) AS ticket, CAST(date AS VARCHAR) AS date, {R('odds')} AS odds, CAST(total_props AS BIGINT) AS total_props,
CAST(props_hit AS BIGINT) AS props_hit, leg_won, {R('hit_rate')} AS hit_rate, {R('implied_prob')} AS implied_prob, {R('implied_prob * 100')} AS expected_hit_rate FROM dated""", D)
def dated_tickets(spark, folder):
    return dated(spark, folder)[0]


@query("dated_ticket_props", f"""
WITH l AS (SELECT * FROM (SELECT ticket, prop, t.stat, s.*, ROW_NUMBER() OVER (PARTITION BY ticket, prop ORDER BY ppg DESC, player_name) AS k
  FROM ticket_props t JOIN night_season s ON contains(player_name, needle)) m WHERE k = 1)
SELECT CAST(t.ticket AS BIGINT) AS ticket, CAST(t.prop AS BIGINT) AS prop, t.player, t.stat, {R('t.result')} AS result, {R('t.margin')} AS margin, t.hit,
       {R("CASE t.stat WHEN 'PTS' THEN ppg WHEN 'REB' THEN rpg END")} AS player_avg, {R("CASE t.stat WHEN 'PTS' THEN pts_cv WHEN 'REB' THEN reb_cv END")} AS cv
FROM ticket_settled t LEFT JOIN l ON l.ticket = t.ticket AND l.prop = t.prop""", (*D, "night_season"))
def dated_ticket_props(spark, folder):
    return dated(spark, folder)[1].select("ticket", "prop", "player", "stat", "result", "margin", "hit", "player_avg", "cv")


@query("combined_odds", f"""SELECT CAST(COUNT(*) AS BIGINT) AS total_legs, CAST(SUM(CAST(leg_won AS INTEGER)) AS BIGINT) AS legs_won, {R('AVG(CAST(leg_won AS INTEGER)) * 100')} AS win_rate,
{R('ln(product(odds))')} AS log_combined_odds, {R('ln(product(implied_prob))')} AS log_combined_implied_prob, BOOL_AND(leg_won) AS all_won FROM dated""", D)
def combined_odds(spark, folder):
    table = ops.combined_odds(dated(spark, folder)[0])
    return table.select("total_legs", "legs_won", "win_rate", F.ln("combined_odds").alias("log_combined_odds"),
                        F.ln("combined_implied_prob").alias("log_combined_implied_prob"), "all_won")


@query("ticket_sizes", f"""SELECT CAST(total_props AS BIGINT) AS total_props, CAST(COUNT(*) AS BIGINT) AS tickets, {R('AVG(hit_rate)')} AS mean_hit_rate,
{R('AVG(CAST(leg_won AS INTEGER)) * 100')} AS win_rate FROM dated GROUP BY total_props""", D)
def ticket_sizes(spark, folder):
    return ops.ticket_size_table(dated(spark, folder)[0])


@query("cumulative_props", """SELECT CAST(ticket AS BIGINT) AS ticket, CAST(SUM(total_props) OVER (ORDER BY ticket) AS BIGINT) AS cum_props,
CAST(SUM(props_hit) OVER (ORDER BY ticket) AS BIGINT) AS cum_hits FROM dated""", D)
def cumulative_props(spark, folder):
    return ops.cumulative_props(dated(spark, folder)[0]).select("ticket", "cum_props", "cum_hits")


# A ticket of lines per order: the customer's points, assists and rebounds at the order's own offset.
fx.SQL["rate_legs"] = """
SELECT "gameId" AS ticket, player_name, s.stat, CAST(CASE WHEN "AST" >= 4 THEN 5 ELSE -5 END AS DOUBLE) AS "offset", 1.5 + "AST" AS odds
FROM games, (VALUES ('PTS'), ('AST')) s(stat)"""


@query("ticket_edge", f"""
WITH e AS (SELECT l.ticket, COUNT(*) AS n_legs, COUNT(hit_rate) AS known, MAX(odds) AS odds, product(hit_rate / 100) AS p FROM rate_legs l
  LEFT JOIN rates r ON l.player_name = r.player_name AND l.stat = r.stat AND l."offset" = r."offset" GROUP BY l.ticket),
q AS (SELECT ticket, n_legs, odds, CASE WHEN known = n_legs THEN p END AS p FROM e)
SELECT ticket, CAST(n_legs AS BIGINT) AS n_legs, {R('odds')} AS odds, {R('p')} AS probability, {R('1 / NULLIF(p, 0)')} AS fair_odds, {R('p - 1 / odds')} AS edge, p - 1 / odds > 0 AS positive_ev
FROM q""", (*RATES, "rate_legs"))
def ticket_edge(spark, folder):
    g = fx.stored(fx.games(spark, folder))
    legs = g.select(F.col("gameId").alias("ticket"), "player_name", F.explode(F.array(F.lit("PTS"), F.lit("AST"))).alias("stat"),
                    F.when(F.col("AST") >= 4, 5.0).otherwise(-5.0).alias("offset"), (F.col("AST") + 1.5).alias("odds"))
    return ops.ticket_edge(rates(g), legs)


@query("offered_line_rate", f"""
WITH v AS (SELECT player_id, 'pts' AS stat, pts AS value FROM box UNION ALL SELECT player_id, 'ast', ast FROM box UNION ALL SELECT player_id, 'reb', reb FROM box
           UNION ALL SELECT player_id, 'fg3m', fg3m FROM box),
l AS (SELECT DISTINCT player_id, stat, line FROM quoted)
SELECT l.player_id, l.stat, l.line, CAST(COUNT(*) AS BIGINT) AS games, {R('AVG(CAST(v.value > l.line AS INTEGER)) * 100')} AS hit_rate
FROM l JOIN v ON l.player_id = v.player_id AND l.stat = v.stat GROUP BY l.player_id, l.stat, l.line""", ("box", "quoted"))
def offered_line_rate(spark, folder):
    from ..functions.exprs import unpivot
    facts = unpivot(fx.stored(fx.box(spark, folder)), ["player_id"], ["pts", "fg3m", "ast", "reb"], "stat", "value")
    return ops.offered_line_rates(facts, fx.quoted(spark, folder))
