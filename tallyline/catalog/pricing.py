"""Distribution summaries, count models, line probabilities and value signals."""

from pyspark.sql import functions as F

from ..operators import counts as ops
from . import fixtures as fx
from .registry import R, query

# Per player and stat of the box fixture, in long form.
fx.SQL["long_box"] = " UNION ALL ".join(
    f"SELECT game_id, game_date, player_id, '{s}' AS stat, {s} AS value FROM box" for s in ("pts", "fg3m", "ast", "reb"))
fx.SQL["summary"] = """
SELECT player_id, stat, COUNT(*) AS n_games, AVG(value) AS mean, STDDEV_SAMP(value) AS std, VAR_SAMP(value) AS var,
       quantile_cont(value, 0.1) AS p10, quantile_cont(value, 0.25) AS p25, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.75) AS p75,
       quantile_cont(value, 0.9) AS p90, MIN(value) AS "min", MAX(value) AS "max"
FROM long_box GROUP BY player_id, stat HAVING COUNT(*) >= 20
"""
fx.SQL["models"] = """
SELECT *, CASE WHEN mean <= 0 THEN 'degenerate' WHEN var IS NULL OR ABS(var - mean) <= 1e-8 + 0.1 * ABS(mean) OR var < mean THEN 'poisson'
               ELSE 'nbinom' END AS family, mean * mean / NULLIF(var - mean, 0) AS r FROM summary
"""
M = ("box", "long_box", "summary", "models")
COLUMNS = ("mean", "std", "var", "p10", "p25", "p50", "p75", "p90", "min", "max")


def summary(spark, folder):
    return ops.distribution_summary(fx.stored(fx.box(spark, folder)))


def models(spark, folder):
    return ops.attach_count_models(summary(spark, folder))


@query("distribution_summary", f"""SELECT player_id, stat, n_games, {', '.join(f'{R(chr(34) + c + chr(34))} AS "{c}"' for c in COLUMNS)} FROM summary""", M[:3])
def distribution_summary(spark, folder):
    return summary(spark, folder)


@query("distribution_summary_events", f"""
SELECT player_id, stat, COUNT(*) AS n_games, {R('AVG(value)', 4)} AS mean, {R('STDDEV_SAMP(value)', 4)} AS std, {R('quantile_cont(value, 0.1)', 4)} AS p10,
       {R('quantile_cont(value, 0.5)', 4)} AS p50, {R('quantile_cont(value, 0.9)', 4)} AS p90
FROM ev GROUP BY player_id, stat HAVING COUNT(*) >= 10""", ("ev",))
def distribution_summary_events(spark, folder):
    table = ops.distribution_summary_long(fx.ev(spark, folder), min_games=10)
    return table.select("player_id", "stat", "n_games", *[(F.rint(F.col(c) * 1e4) / 1e4).alias(c) for c in ("mean", "std", "p10", "p50", "p90")])


@query("count_models", f"""
SELECT player_id, stat, family, {R("CASE WHEN family = 'poisson' THEN mean END")} AS mu, {R("CASE WHEN family = 'nbinom' THEN r END", 3)} AS n,
       {R("CASE WHEN family = 'nbinom' THEN r / (r + mean) END")} AS p FROM models""", M)
def count_models(spark, folder):
    return models(spark, folder).select("player_id", "stat", "family", "params.mu", (F.rint(F.col("params.n") * 1e3) / 1e3).alias("n"), "params.p")


@query("family_shares", f"""SELECT family, CAST(COUNT(*) AS BIGINT) AS n_models, {R('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM models)')} AS share_pct
FROM models GROUP BY family""", M)
def family_shares(spark, folder):
    return ops.family_shares(models(spark, folder))


# Distinct (model, k) pairs are summed once: log terms over 0..k.
fx.SQL["tails"] = """
SELECT q.*, m.family, CASE WHEN m.family = 'degenerate' THEN NULL WHEN floor(q.line - 1e-9) < 0 THEN 0.0 ELSE LEAST(c.cdf, 1.0) END AS prob_under
FROM quoted q JOIN models m ON q.player_id = m.player_id AND q.stat = m.stat
LEFT JOIN (
  SELECT player_id, stat, k, SUM(CASE WHEN family = 'poisson' THEN exp(i * ln(mean) - mean - lgamma(i + 1))
      ELSE exp(lgamma(i + r) - lgamma(r) - lgamma(i + 1) + r * ln(r / (r + mean)) + i * ln(1 - r / (r + mean))) END) AS cdf
  FROM (SELECT DISTINCT m.player_id, m.stat, m.family, m.mean, m.r, CAST(floor(q.line - 1e-9) AS BIGINT) AS k
        FROM quoted q JOIN models m ON q.player_id = m.player_id AND q.stat = m.stat WHERE m.family <> 'degenerate') d,
       UNNEST(generate_series(0, k)) AS t(i)
  GROUP BY player_id, stat, k) c
ON c.player_id = q.player_id AND c.stat = q.stat AND c.k = CAST(floor(q.line - 1e-9) AS BIGINT)
"""
T = ("box", "long_box", "summary", "models", "quoted", "tails")


def tails(spark, folder):
    return ops.line_tail_probabilities(models(spark, folder), fx.quoted(spark, folder))


@query("line_tail_probs", f"""
SELECT game_id, player_id, stat, book, line, {R('1 - prob_under')} AS prob_over, {R('prob_under')} AS prob_under,
       {R('CASE WHEN prob_under > 1e-9 THEN ln(1 / prob_under) END')} AS log_odds_under FROM tails""", T)
def line_tail_probs(spark, folder):
    return tails(spark, folder).select("game_id", "player_id", "stat", "book", "line", "prob_over", "prob_under",
                                       F.when(F.col("prob_under") > 1e-9, F.ln("implied_odds_under")).alias("log_odds_under"))


fx.SQL["value_rows"] = """
SELECT game_id, player_id, stat, book, line, (1 - prob_under) * over_odds - 1 AS edge_over, prob_under * under_odds - 1 AS edge_under FROM tails
"""


@query("value_bets", f"""
SELECT game_id, player_id, stat, book, line, {R('edge_over')} AS edge_over, {R('edge_under')} AS edge_under,
       CASE WHEN edge_over > edge_under THEN 'over' ELSE 'under' END AS best_direction, {R('GREATEST(edge_over, edge_under)')} AS best_edge
FROM value_rows WHERE edge_over >= 0.05000001 OR edge_under >= 0.05000001""", (*T, "value_rows"))
def value_bets(spark, folder):
    return ops.value_bets(tails(spark, folder), min_edge=0.05000001).select(
        "game_id", "player_id", "stat", "book", "line", "edge_over", "edge_under", "best_direction", "best_edge")


@query("value_bets_any_book", f"""
SELECT t.stat, CASE WHEN e_over > e_under THEN 'over' ELSE 'under' END AS best_direction, CAST(COUNT(*) AS BIGINT) AS bets FROM (
  SELECT t.stat, (1 - prob_under) * o.over_odds - 1 AS e_over, prob_under * o.under_odds - 1 AS e_under
  FROM tails t JOIN quoted o ON t.game_id = o.game_id AND t.player_id = o.player_id AND t.stat = o.stat) t
WHERE e_over >= 0.05000001 OR e_under >= 0.05000001 GROUP BY 1, 2""", T)
def value_bets_any_book(spark, folder):
    bets = ops.value_bets(tails(spark, folder), fx.quoted(spark, folder), min_edge=0.05000001, keys=("game_id", "player_id", "stat"))
    return bets.groupBy("stat", "best_direction").agg(F.count(F.lit(1)).alias("bets"))


@query("push_probabilities", f"""
SELECT t.game_id, t.player_id, t.stat, t.book, t.line, {R('prob_under')} AS prob_under, {R('push')} AS prob_push, {R('1 - prob_under - push')} AS prob_over
FROM (SELECT t.*, CASE WHEN t.line <> floor(t.line) THEN 0 WHEN t.family = 'poisson' THEN exp(t.line * ln(m.mean) - m.mean - lgamma(t.line + 1))
        ELSE exp(lgamma(t.line + r) - lgamma(r) - lgamma(t.line + 1) + r * ln(r / (r + m.mean)) + t.line * ln(1 - r / (r + m.mean))) END AS push
      FROM tails t JOIN models m ON t.player_id = m.player_id AND t.stat = m.stat WHERE prob_under IS NOT NULL) t""", T)
def push_probabilities(spark, folder):
    """Every line, half of them whole numbers, so that the share of ties itself is compared."""
    priced = ops.line_tail_probabilities(models(spark, folder), fx.quoted(spark, folder), push="void").filter("prob_under is not null")
    return priced.select("game_id", "player_id", "stat", "book", "line", "prob_under", "prob_push", "prob_over")
