"""Leg settlement and ticket roll-ups."""

from pyspark.sql import functions as F

from ..operators import betting, legs as ops, windows
from ..operators.dependence import global_correlation
from ..sources import writers
from . import fixtures as fx
from .registry import R, query

LEG = ("box", "legs", "quoted", "leg_rows")
TICKET = fx.TICKET_FIXTURES


@query("leg_outcomes", f"""
SELECT builder_id, leg_id, stat, direction_lower, {R('realised')} AS realised, {R('line_book')} AS line_book,
       {R('effective_line')} AS effective_line, {R('over_odds')} AS over_odds, CAST(leg_hit AS BIGINT) AS leg_hit,
       {R('realised_minus_line')} AS realised_minus_line, {R('realised_pct_diff')} AS realised_pct_diff FROM leg_rows""", LEG)
def leg_outcomes(spark, folder):
    return fx.leg_rows(spark, folder).select(
        "builder_id", "leg_id", "stat", "direction_lower", "realised", "line_book", "effective_line", "over_odds", "leg_hit",
        "realised_minus_line", "realised_pct_diff")


@query("leg_outcomes_one_book", f"""
SELECT stat, direction_lower, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(SUM(leg_hit) AS BIGINT) AS hits, {R('SUM(effective_line)')} AS lines FROM leg_rows_one
GROUP BY stat, direction_lower""", ("box", "legs", "quoted", "quoted_one", "leg_rows_one"))
def leg_outcomes_one_book(spark, folder):
    rows = ops.leg_table(fx.legs(spark, folder), fx.box(spark, folder), fx.quoted(spark, folder), book="Brand#7")
    return rows.groupBy("stat", "direction_lower").agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("leg_hit").alias("hits"), F.sum("effective_line").alias("lines"))


@query("leg_outcomes_without_quotes", f"""
SELECT stat, CAST(COUNT(*) AS BIGINT) AS n_rows, CAST(SUM(CASE WHEN hit THEN 1 ELSE 0 END) AS BIGINT) AS hits FROM (
  SELECT stat, COALESCE(CASE WHEN direction = 'Over' THEN v > line ELSE v < line END, FALSE) AS hit FROM (
    SELECT legs.*, CASE stat WHEN 'pts' THEN pts WHEN 'fg3m' THEN fg3m WHEN 'ast' THEN ast WHEN 'reb' THEN reb END AS v
    FROM legs LEFT JOIN box USING (game_id, game_date, player_id)) a) b GROUP BY stat""", ("box", "legs"))
def leg_outcomes_without_quotes(spark, folder):
    rows = ops.leg_table(fx.legs(spark, folder), fx.box(spark, folder), None)
    return rows.groupBy("stat").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("leg_hit").alias("hits"))


@query("direction_hit_rate", f"""
SELECT direction_lower, CAST(COUNT(*) AS BIGINT) AS n_legs, {R('AVG(leg_hit)*100')} AS hit_rate FROM leg_rows GROUP BY direction_lower""", LEG)
def direction_hit_rate(spark, folder):
    return fx.leg_rows(spark, folder).groupBy("direction_lower").agg(
        F.count(F.lit(1)).alias("n_legs"), (F.avg("leg_hit") * 100.0).alias("hit_rate"))


@query("ticket_rollup", f"""
SELECT builder_id, CAST(game_date AS VARCHAR) AS game_date, game_id, n_legs, CAST(builder_hit AS BIGINT) AS builder_hit,
       {R('mean_abs_edge')} AS mean_abs_edge, {R('max_abs_edge')} AS max_abs_edge, {R('stake')} AS stake, {R('decimal_odds')} AS decimal_odds,
       CAST(n_over AS BIGINT) AS n_over, CAST(n_under AS BIGINT) AS n_under FROM tickets""", TICKET)
def ticket_rollup(spark, folder):
    return fx.by_ticket(spark, folder, lambda rows: ops.ticket_rollup(rows).select(
        "builder_id", "game_date", "game_id", "n_legs", "builder_hit", "mean_abs_edge", "max_abs_edge", "stake", "decimal_odds", "n_over", "n_under"))


@query("ticket_mix_flags", f"""
SELECT builder_id, {R('book_implied_prob')} AS book_implied_prob, {R('pct_over')} AS pct_over, {R('pct_under')} AS pct_under,
       CAST(is_all_over AS BIGINT) AS is_all_over, CAST(is_all_under AS BIGINT) AS is_all_under, CAST(is_mixed AS BIGINT) AS is_mixed
FROM tickets""", TICKET)
def ticket_mix_flags(spark, folder):
    return ops.ticket_rollup(fx.leg_rows(spark, folder)).select(
        "builder_id", "book_implied_prob", "pct_over", "pct_under", "is_all_over", "is_all_under", "is_mixed")


@query("stat_composition", """
SELECT builder_id, CAST(has_pts AS BIGINT) AS has_pts, CAST(has_fg3m AS BIGINT) AS has_fg3m, CAST(has_ast AS BIGINT) AS has_ast,
       CAST(has_reb AS BIGINT) AS has_reb, CAST(has_pts + has_fg3m + has_ast + has_reb AS BIGINT) AS n_unique_stats
FROM tickets""", TICKET)
def stat_composition(spark, folder):
    return ops.stat_composition(fx.leg_rows(spark, folder))


@query("player_diversity", f"""
SELECT builder_id, n_unique_players, n_total_legs, {R('CAST(n_total_legs AS DOUBLE) / n_unique_players')} AS same_player_ratio,
       CAST(n_unique_players = 1 AS BIGINT) AS is_single_player FROM tickets""", TICKET)
def player_diversity(spark, folder):
    return ops.player_diversity(fx.leg_rows(spark, folder))


@query("correlation_risk", """
SELECT CAST(n_unique_players = 1 AS BIGINT) AS high_correlation_risk, CAST(COUNT(*) AS BIGINT) AS n_tickets, CAST(SUM(builder_hit) AS BIGINT) AS hits
FROM tickets GROUP BY 1""", TICKET)
def correlation_risk(spark, folder):
    risky = ops.correlation_risk(fx.tickets(spark, folder, "builder_hit", "is_single_player"))
    return risky.groupBy("high_correlation_risk").agg(F.count(F.lit(1)).alias("n_tickets"), F.sum("builder_hit").alias("hits"))


STAT_NAMES = ("pts", "fg3m", "ast", "reb")
_MOMENTS = "CASE WHEN VAR_POP({0}) * VAR_POP({1}) > 0 THEN COVAR_POP({0}, {1}) / sqrt(VAR_POP({0}) * VAR_POP({1})) END"
fx.SQL["stat_table"] = " UNION ALL ".join(f"SELECT '{a}' AS sx, '{b}' AS sy, {_MOMENTS.format(a, b)} AS corr FROM box" for a in STAT_NAMES for b in STAT_NAMES)
fx.SQL["ticket_pairs"] = """
SELECT builder_id, COUNT(*) AS n_pairs, AVG(corr) AS mean_corr, MAX(corr) AS max_corr FROM (
  SELECT a.builder_id, CASE WHEN a.stat = b.stat THEN COALESCE(corr, 1.0) ELSE corr END AS corr
  FROM (SELECT DISTINCT builder_id, leg_id, stat FROM leg_rows) a JOIN (SELECT DISTINCT builder_id, leg_id, stat FROM leg_rows) b ON a.builder_id = b.builder_id AND (a.leg_id, a.stat) < (b.leg_id, b.stat)
  JOIN stat_table t ON t.sx = a.stat AND t.sy = b.stat) p WHERE corr IS NOT NULL GROUP BY builder_id"""


@query("ticket_pair_correlation", f"""
SELECT l.builder_id, CAST(l.n AS BIGINT) AS n_legs, CAST(COALESCE(n_pairs, 0) AS BIGINT) AS n_pairs, {R('mean_corr')} AS mean_pair_corr, {R('max_corr')} AS max_pair_corr,
       CAST(COALESCE(mean_corr >= 0.7, false) AS BIGINT) AS high_correlation_risk
FROM (SELECT builder_id, COUNT(*) AS n FROM (SELECT DISTINCT builder_id, leg_id, stat FROM leg_rows) d GROUP BY builder_id) l LEFT JOIN ticket_pairs USING (builder_id)""",
       ("box", "legs", "quoted", "leg_rows", "stat_table", "ticket_pairs"))
def ticket_pair_correlation(spark, folder):
    box = fx.stored(fx.box(spark, folder))
    return ops.ticket_pair_correlation(fx.leg_rows(spark, folder), global_correlation(box, STAT_NAMES, method="pearson"))


@query("legs_per_ticket", """
SELECT n_legs AS value, CAST(COUNT(*) AS BIGINT) AS n_tickets FROM tickets GROUP BY n_legs""", TICKET)
def legs_per_ticket(spark, folder):
    return fx.tickets(spark, folder, "n_legs").groupBy(F.col("n_legs").alias("value")).agg(F.count(F.lit(1)).alias("n_tickets"))


PROFIT = "CASE WHEN builder_hit = 1 THEN stake * (decimal_odds - 1) ELSE -stake END"
UNIT = "CASE WHEN builder_hit = 1 THEN decimal_odds - 1 ELSE -1.0 END"
RETURNS = f"""{R(f'COALESCE(SUM({PROFIT}) / NULLIF(SUM(stake), 0), 0)')} AS roi, {R(f'SUM({PROFIT})', 3)} AS profit,
       {R(f'SUM({PROFIT}) / COUNT(*)')} AS yield, {R(f'COALESCE(AVG({UNIT}) / NULLIF(STDDEV_SAMP({UNIT}), 0), 0)')} AS sharpe_ratio,
       {R('SUM(stake)', 3)} AS total_stake"""


RETURN_COLUMNS = ("builder_hit", "decimal_odds", "stake")


def _thousandths(df, *columns):
    return df.withColumns({c: F.rint(F.col(c) * 1000) / 1000 for c in columns})


@query("ticket_returns_by_size", f"""
SELECT n_legs, CAST(COUNT(*) AS BIGINT) AS n_obs, {R('AVG(builder_hit)')} AS hit_rate, {RETURNS} FROM tickets GROUP BY n_legs""", TICKET)
def ticket_returns_by_size(spark, folder):
    """The whole path: legs to results to lines to tickets to returns."""
    table = fx.tickets(spark, folder, "n_legs", *RETURN_COLUMNS).groupBy("n_legs").agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg("builder_hit").alias("hit_rate"), *betting.return_metrics())
    return _thousandths(table, "profit", "total_stake")


@query("ticket_returns", f"""SELECT CAST(COUNT(*) AS BIGINT) AS n_obs, {R('AVG(builder_hit)')} AS hit_rate, {RETURNS} FROM tickets""", TICKET)
def ticket_returns(spark, folder):
    table = fx.tickets(spark, folder, *RETURN_COLUMNS).agg(
        F.count(F.lit(1)).alias("n_obs"), F.avg("builder_hit").alias("hit_rate"), *betting.return_metrics())
    return _thousandths(table, "profit", "total_stake")


_REPORT = {
    "n_obs": "CAST(COUNT(*) AS VARCHAR)", "n_hits": "CAST(CAST(SUM(builder_hit) AS BIGINT) AS VARCHAR)", "hit_rate": "AVG(builder_hit)", "total_stake": "SUM(stake)",
    "profit": f"SUM({PROFIT})", "roi": f"SUM({PROFIT}) / SUM(stake)", "yield": f"SUM({PROFIT}) / COUNT(*)", "sharpe_ratio": f"COALESCE(AVG({UNIT}) / NULLIF(STDDEV_SAMP({UNIT}), 0), 0)"}


@query("returns_report", " UNION ALL ".join(
    f"SELECT 'overall' AS section, '{k}' AS key, {e if 'VARCHAR' in e else f'CAST(CAST(round_even(({e}) * 1000, 0) AS BIGINT) AS VARCHAR)'} AS value FROM tickets" for k, e in _REPORT.items()), TICKET)
def returns_report(spark, folder):
    """Every key of the overall section; measures that are not counts in whole thousandths, so that both sides write them alike."""
    one = fx.tickets(spark, folder, *RETURN_COLUMNS).agg(F.count(F.lit(1)).alias("n_obs"), F.sum("builder_hit").alias("n_hits"), F.avg("builder_hit").alias("hit_rate"), *betting.return_metrics())
    names = [k for k in _REPORT if k not in ("n_obs", "n_hits")]
    return writers.key_values(one.select("n_obs", "n_hits", *[F.rint(F.col(k) * 1000).cast("bigint").alias(k) for k in names]), "overall")


CURVE = f"""
WITH p AS (SELECT *, {PROFIT} AS profit FROM tickets),
c AS (SELECT *, SUM(profit) OVER (ORDER BY game_date, builder_id ROWS UNBOUNDED PRECEDING) AS cum FROM p),
m AS (SELECT *, MAX(cum) OVER (ORDER BY game_date, builder_id ROWS UNBOUNDED PRECEDING) AS peak FROM c),
d AS (SELECT *, peak - cum AS drawdown, SUM(CASE WHEN peak - cum > 0 THEN 0 ELSE 1 END)
        OVER (ORDER BY game_date, builder_id ROWS UNBOUNDED PRECEDING) AS run FROM m)
"""


def outcomes(spark, folder):
    return fx.tickets(spark, folder, "builder_id", "game_date", *RETURN_COLUMNS)


@query("equity_curve", f"""{CURVE} SELECT builder_id, {R('profit', 4)} AS profit, {R('cum', 4)} AS cum_profit, {R('peak', 4)} AS running_max,
       {R('drawdown', 4)} AS drawdown FROM d""", TICKET)
def equity_curve(spark, folder):
    curve = windows.equity_curve(outcomes(spark, folder), order=["game_date", "builder_id"])
    return curve.select("builder_id", *[(F.rint(F.col(c) * 1e4) / 1e4).alias(c) for c in ("profit", "cum_profit", "running_max", "drawdown")])


@query("drawdown", f"""{CURVE}, r AS (SELECT run, SUM(CASE WHEN drawdown > 0 THEN 1 ELSE 0 END) AS n FROM d GROUP BY run)
SELECT {R('MAX(drawdown)', 4)} AS max_drawdown, (SELECT CAST(MAX(n) AS BIGINT) FROM r) AS max_drawdown_period, {R('SUM(profit)', 4)} AS final_profit,
       {R('MAX(cum)', 4)} AS max_profit, {R('SUM(profit) / SUM(stake) * 100')} AS roi_pct, CAST(COUNT(*) AS BIGINT) AS n_bets FROM d""", TICKET)
def drawdown(spark, folder):
    table = windows.drawdown_summary(outcomes(spark, folder), order=["game_date", "builder_id"])
    return table.withColumns({c: F.rint(F.col(c) * 1e4) / 1e4 for c in ("max_drawdown", "final_profit", "max_profit")})
