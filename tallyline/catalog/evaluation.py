"""Returns by segment, stake sizing, calibration, classifier measures, folds, model and backtests."""

from pyspark.sql import functions as F

from ..operators import betting as ops, folds, outcome
from ..operators.folds import FoldConfig
from . import fixtures as fx
from .registry import R, query

PROFIT = "CASE WHEN y = 1 THEN stake * (decimal_odds - 1) ELSE -stake END"
UNIT = "CASE WHEN y = 1 THEN decimal_odds - 1 ELSE -1.0 END"
METRICS = f"""CAST(COUNT(*) AS BIGINT) AS n_obs, {R('AVG(y)')} AS hit_rate, {R('AVG(p)')} AS pred_hit_rate, {R('AVG((p - y) * (p - y))')} AS brier,
  {R(f'SUM({PROFIT}) / SUM(stake)')} AS roi, {R(f'SUM({PROFIT})')} AS profit, {R(f'SUM({PROFIT}) / COUNT(*)')} AS yield,
  {R(f'COALESCE(AVG({UNIT}) / NULLIF(STDDEV_SAMP({UNIT}), 0), 0)')} AS sharpe_ratio, {R('SUM(stake)')} AS total_stake"""


@query("evaluate_predictions", f"SELECT {METRICS} FROM scored", ("scored",))
def evaluate_predictions(spark, folder):
    return ops.evaluate(fx.scored(spark, folder), "p", hit="y")


@query("roi_by_segment", f"SELECT lang, {METRICS} FROM scored GROUP BY lang", ("scored",))
def roi_by_segment(spark, folder):
    return ops.evaluate(fx.scored(spark, folder), "p", keys=["lang"], hit="y")


@query("stake_sizing", f"""
WITH k AS (SELECT y, decimal_odds, {UNIT} AS unit, p, GREATEST(COALESCE(((decimal_odds - 1) * p - (1 - p)) / NULLIF(decimal_odds - 1, 0), 0), 0) AS kelly FROM scored),
s AS (SELECT 'unit_stake' AS strategy, unit, 1.0 AS st FROM k UNION ALL SELECT 'full_kelly', unit, kelly FROM k UNION ALL SELECT 'fractional_kelly', unit, kelly * 0.25 FROM k
      UNION ALL SELECT 'probability_weighted', unit, p FROM k)
SELECT strategy, {R('COALESCE(SUM(st * unit) / NULLIF(SUM(st), 0), 0)')} AS roi,
  {R('SUM(st * unit) * CASE WHEN SUM(st) > 0 THEN COUNT(*) / SUM(st) ELSE 1 END', 4)} AS profit,
  {R('COALESCE(AVG(unit) / NULLIF(STDDEV_SAMP(unit), 0), 0)')} AS sharpe, {R('SUM(st) * CASE WHEN SUM(st) > 0 THEN COUNT(*) / SUM(st) ELSE 1 END / COUNT(*)')} AS avg_stake,
  {R('MAX(st) * CASE WHEN SUM(st) > 0 THEN COUNT(*) / SUM(st) ELSE 1 END')} AS max_stake FROM s GROUP BY strategy""", ("scored",))
def stake_sizing(spark, folder):
    return ops.stake_sizing(fx.scored(spark, folder), "p", hit="y").withColumn("profit", F.rint(F.col("profit") * 1e4) / 1e4)


EDGES = ", ".join(f"quantile_cont(p, {i / 10})" for i in range(1, 10))
fx.SQL["calibrated"] = f"""
SELECT CAST((SELECT COUNT(*) FROM UNNEST(e) AS t(x) WHERE x < p) AS BIGINT) AS bin, COUNT(*) AS n, AVG(p) AS predicted_prob, AVG(y) AS actual_rate
FROM scored, (SELECT [{EDGES}] AS e FROM scored) q GROUP BY 1"""


@query("calibration", f"""SELECT bin, CAST(n AS BIGINT) AS n, {R('predicted_prob')} AS predicted_prob, {R('actual_rate')} AS actual_rate,
{R('actual_rate - predicted_prob')} AS calibration_error FROM calibrated""", ("scored", "calibrated"))
def calibration(spark, folder):
    return ops.calibration_table(fx.scored(spark, folder), "p", "y")


@query("calibration_error", f"SELECT {R('AVG(ABS(actual_rate - predicted_prob))')} AS mean_abs_error FROM calibrated", ("scored", "calibrated"))
def calibration_error(spark, folder):
    return ops.calibration_error(ops.calibration_table(fx.scored(spark, folder), "p", "y"))


@query("calibration_by_segment", f"""
SELECT s.lang, CAST((SELECT COUNT(*) FROM UNNEST(e) AS t(x) WHERE x < p) AS BIGINT) AS bin, CAST(COUNT(*) AS BIGINT) AS n, {R('AVG(p)')} AS predicted_prob, {R('AVG(y)')} AS actual_rate,
       {R('AVG(y) - AVG(p)')} AS calibration_error
FROM scored s JOIN (SELECT lang, [{EDGES}] AS e FROM scored GROUP BY lang) q ON s.lang = q.lang GROUP BY 1, 2""", ("scored",))
def calibration_by_segment(spark, folder):
    return ops.calibration_table(fx.scored(spark, folder), "p", "y", keys=["lang"])


fx.SQL["roc"] = """
SELECT p AS threshold, pos, neg, SUM(neg) OVER w AS fp, SUM(pos) OVER w AS tp, SUM(pos) OVER () AS np, SUM(neg) OVER () AS nn,
       LEAD(pos) OVER w AS next_pos, LEAD(neg) OVER w AS next_neg, LAG(pos) OVER w AS last_pos
FROM (SELECT p, SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS pos, SUM(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS neg FROM scored GROUP BY p) c
WINDOW w AS (ORDER BY p DESC)"""


@query("roc_points", f"""SELECT {R('threshold')} AS threshold, {R('fp * 1.0 / nn')} AS fpr, {R('tp * 1.0 / np')} AS tpr FROM roc
WHERE next_pos IS NULL OR last_pos IS NULL OR NOT (next_pos = pos AND next_neg = neg) UNION ALL SELECT NULL, 0.0, 0.0""", ("scored", "roc"))
def roc_points(spark, folder):
    return ops.roc_points(fx.scored(spark, folder), "p", "y")


@query("classifier_metrics", f"""
SELECT {R('AVG(CAST((p >= 0.5) = (y = 1) AS INTEGER))')} AS accuracy, {R('AVG((p - y) * (p - y))')} AS brier,
  {R('AVG(-CASE WHEN y = 1 THEN ln(GREATEST(LEAST(p, 1 - 1e-7), 1e-7)) ELSE ln(1 - GREATEST(LEAST(p, 1 - 1e-7), 1e-7)) END)')} AS log_loss,
  CAST(COUNT(*) AS BIGINT) AS n_obs, {R('AVG(y)')} AS positive_rate, {R('AVG(CAST(p >= 0.5 AS INTEGER))')} AS pred_positive_rate,
  (SELECT {R('SUM(pos * ((nn - fp) + neg / 2.0)) / (MAX(np) * MAX(nn))')} FROM roc) AS roc_auc FROM scored""", ("scored", "roc"))
def classifier_metrics(spark, folder):
    return ops.classifier_metrics(fx.scored(spark, folder), "p", "y")


@query("confusion_counts", """SELECT CAST(y AS BIGINT) AS actual, CAST(p >= 0.5 AS BIGINT) AS predicted, CAST(COUNT(*) AS BIGINT) AS "rows" FROM scored GROUP BY 1, 2""", ("scored",))
def confusion_counts(spark, folder):
    return ops.confusion_counts(fx.scored(spark, folder), "p", "y")


@query("class_report", f"""
SELECT CAST(c AS BIGINT) AS label, {R('COALESCE(both_ * 1.0 / NULLIF(said, 0), 0)')} AS precision, {R('COALESCE(both_ * 1.0 / NULLIF(actual, 0), 0)')} AS recall,
  {R('COALESCE(2.0 * both_ / NULLIF(said + actual, 0), 0)')} AS f1, CAST(actual AS BIGINT) AS support FROM (
  SELECT c, SUM(CASE WHEN y = c AND CAST(p >= 0.5 AS INTEGER) = c THEN 1 ELSE 0 END) AS both_, SUM(CASE WHEN CAST(p >= 0.5 AS INTEGER) = c THEN 1 ELSE 0 END) AS said,
         SUM(CASE WHEN y = c THEN 1 ELSE 0 END) AS actual FROM scored, (VALUES (0), (1)) v(c) GROUP BY c) t""", ("scored",))
def class_report(spark, folder):
    return ops.class_report(fx.scored(spark, folder), "p", "y")


# Walk-forward folds over the order dates; the implied probability stands in for a model where SQL has to follow.
CFG = FoldConfig(train_days=180, test_days=30, min_train=200)


def settled(spark, folder):
    return fx.tickets(spark, folder, "game_date", "book_implied_prob", "builder_hit", "decimal_odds", "stake")


def _folds_sql(kind):
    low = "lo" if kind == "expanding" else "lo + CAST(slot * 30 AS INTEGER)"
    return f"""
SELECT CAST(ROW_NUMBER() OVER (ORDER BY slot) - 1 AS BIGINT) AS fold, * FROM (
  SELECT slot, MIN(game_date) FILTER (tr) AS train_start, MAX(game_date) FILTER (tr) AS train_end, MIN(game_date) FILTER (te) AS test_start,
         MAX(game_date) FILTER (te) AS test_end, COUNT(*) FILTER (tr) AS train_size, COUNT(*) FILTER (te) AS test_size
  FROM (SELECT slot, game_date, game_date >= {low} AND game_date < lo + CAST(slot * 30 + 180 AS INTEGER) AS tr,
               game_date >= lo + CAST(slot * 30 + 180 AS INTEGER) AND game_date < lo + CAST(slot * 30 + 210 AS INTEGER) AS te
        FROM tickets, (SELECT MIN(game_date) AS lo, MAX(game_date) AS hi FROM tickets) b, UNNEST(generate_series(0, CAST(date_diff('day', lo, hi) AS BIGINT) // 30)) AS g(slot)
        WHERE lo + CAST(slot * 30 + 210 AS INTEGER) <= hi) x
  GROUP BY slot HAVING COUNT(*) FILTER (tr) >= 200 AND COUNT(*) FILTER (te) > 0) f"""


fx.SQL["rolling"] = _folds_sql("rolling")
fx.SQL["expanding"] = _folds_sql("expanding")
FOLD_COLUMNS = """fold, CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end, CAST(test_start AS VARCHAR) AS test_start,
CAST(test_end AS VARCHAR) AS test_end, CAST(train_size AS BIGINT) AS train_size, CAST(test_size AS BIGINT) AS test_size"""


@query("rolling_folds", f"SELECT {FOLD_COLUMNS} FROM rolling", (*fx.TICKET_FIXTURES, "rolling"))
def rolling_folds(spark, folder):
    return folds.split_summary(fx.tickets(spark, folder, "game_date"), CFG).drop("slot")


@query("expanding_folds", f"SELECT {FOLD_COLUMNS} FROM expanding", (*fx.TICKET_FIXTURES, "expanding"))
def expanding_folds(spark, folder):
    return folds.split_summary(fx.tickets(spark, folder, "game_date"), CFG, "expanding").drop("slot")


TP = "CASE WHEN builder_hit = 1 THEN stake * (decimal_odds - 1) ELSE -stake END"
TU = "CASE WHEN builder_hit = 1 THEN decimal_odds - 1 ELSE -1.0 END"
fx.SQL["fold_results"] = f"""
SELECT fold, ANY_VALUE(f.test_start) AS test_start, COUNT(*) AS n_obs, AVG(builder_hit) AS hit_rate, AVG(book_implied_prob) AS pred_hit_rate,
  AVG((book_implied_prob - builder_hit) * (book_implied_prob - builder_hit)) AS brier, SUM({TP}) / SUM(stake) AS roi, SUM({TP}) AS profit,
  COALESCE(AVG({TU}) / NULLIF(STDDEV_SAMP({TU}), 0), 0) AS sharpe_ratio, SUM(stake) AS total_stake
FROM rolling f, tickets t, (SELECT MIN(game_date) AS lo FROM tickets) b
WHERE game_date >= lo + CAST(slot * 30 + 180 AS INTEGER) AND game_date < lo + CAST(slot * 30 + 210 AS INTEGER) GROUP BY fold"""
FR = (*fx.TICKET_FIXTURES, "rolling", "fold_results")


@query("fold_metrics", f"""SELECT fold, n_obs, {R('hit_rate')} AS hit_rate, {R('pred_hit_rate')} AS pred_hit_rate, {R('brier')} AS brier, {R('roi + 1e-10')} AS roi,
{R('profit', 4)} AS profit, {R('sharpe_ratio')} AS sharpe_ratio, {R('total_stake', 4)} AS total_stake FROM fold_results""", FR)
def fold_metrics(spark, folder):
    """A fold's return can lie half-way between two sixth digits; both sides shift it by 1e-10 before rounding."""
    table = folds.fold_metrics(settled(spark, folder), CFG, "book_implied_prob").withColumn("roi", F.col("roi") + 1e-10)
    return table.drop("yield").withColumns({c: F.rint(F.col(c) * 1e4) / 1e4 for c in ("profit", "total_stake")})


@query("backtest_summary", f"""
SELECT * EXCLUDE (r2, h), {R("1 - (SELECT SUM(exp(lgamma(0.5 + h + i) - lgamma(h) - lgamma(1.5 + i) + (0.5 + i) * ln(r2) + h * ln(1 - r2))) FROM generate_series(0, 2000) AS g(i))")} AS p_value,
       1 - (SELECT SUM(exp(lgamma(0.5 + h + i) - lgamma(h) - lgamma(1.5 + i) + (0.5 + i) * ln(r2) + h * ln(1 - r2))) FROM generate_series(0, 2000) AS g(i)) < 0.05 AS significant
FROM (SELECT CAST(COUNT(*) AS BIGINT) AS n_folds, {R('AVG(roi)')} AS mean_roi, {R('quantile_cont(roi, 0.5)')} AS median_roi, {R('STDDEV_SAMP(roi)')} AS std_roi, {R('MIN(roi)')} AS min_roi,
  {R('MAX(roi)')} AS max_roi, {R('SUM(profit)', 3)} AS total_profit, {R('SUM(total_stake)', 3)} AS total_stake, {R('SUM(profit) / SUM(total_stake)')} AS overall_roi,
  {R('AVG(CAST(roi > 0 AS INTEGER))')} AS win_rate, arg_max(fold, roi) AS best_fold, arg_min(fold, roi) AS worst_fold, {R('regr_slope(roi, x)')} AS slope,
  {R('regr_intercept(roi, x)')} AS intercept, {R('regr_r2(roi, x)')} AS r_squared, regr_r2(roi, x) AS r2, (COUNT(*) - 2) / 2.0 AS h
FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY test_start) - 1 AS x FROM fold_results) r) s""", FR)
def backtest_summary(spark, folder):
    t = settled(spark, folder)
    results = folds.fold_metrics(t, CFG, "book_implied_prob").join(folds.split_summary(t, CFG).select("fold", "test_start"), "fold")
    table = folds.backtest_summary(results)
    return table.withColumns({c: F.rint(F.col(c) * 1e3) / 1e3 for c in ("total_profit", "total_stake")})


# The model's features: the default four, and the five known before the game.
FOUR, FIVE = outcome.FEATURES, outcome.PRE_GAME_FEATURES


def _solved(size, inner):
    """SQL of the solution x0, x1 ... of a symmetric system a<i>_<j> (i <= j), r<i>, one row each, by elimination."""
    for k in range(size - 1):
        changed = {f"a{i}_{j}": f"a{i}_{j} - a{k}_{i} * a{k}_{j} / a{k}_{k}" for i in range(k + 1, size) for j in range(i, size)}
        changed |= {f"r{i}": f"r{i} - a{k}_{i} * r{k} / a{k}_{k}" for i in range(k + 1, size)}
        inner = f"SELECT * REPLACE ({', '.join(f'{e} AS {n}' for n, e in changed.items())}) FROM ({inner}) e{k}"
    for i in reversed(range(size)):
        rest = "".join(f" - a{i}_{j} * x{j}" for j in range(i + 1, size))
        inner = f"SELECT *, (r{i}{rest}) / a{i}_{i} AS x{i} FROM ({inner}) b{i}"
    return inner


def _margin(d, z="z{i}"):
    return "b0" + "".join(f" + b{i + 1} * {z.format(i=i)}" for i in range(d))


def _newton(rows, keys, d):
    """Coefficients b0 ... b<d> for each key of balanced, ridge-penalised logistic fits; rows: keys, y, v0 ... (filled)."""
    k, m = ", ".join(keys), d + 1
    zs = ["1", *(f"z{i}" for i in range(d))]
    sums = [f"SUM(w * p * (1 - p) * {zs[i]} * {zs[j]}) + {int(i == j > 0)} AS a{i}_{j}" for i in range(m) for j in range(i, m)]
    sums += [f"-SUM(w * (p - y) * {zs[i]}) - {f'b{i}' if i else 0} AS r{i}" for i in range(m)]
    bs = ", ".join(f"b{i}" for i in range(m))
    system = f"""SELECT {k}, step, {bs}, {', '.join(sums)}
      FROM (SELECT it.*, y, w, {', '.join(zs[1:])}, 1 / (1 + exp(-({_margin(d)}))) AS p FROM it JOIN d USING ({k}) WHERE step < 20) e GROUP BY {k}, step, {bs}"""
    moments = ", ".join(f"AVG(v{i}) AS mu{i}, COALESCE(NULLIF(STDDEV_POP(v{i}), 0), 1) AS sd{i}" for i in range(d))
    return f"""
WITH RECURSIVE s AS (SELECT {k}, COUNT(*) AS n, SUM(y) AS n1, {moments} FROM {rows} GROUP BY {k}),
d AS (SELECT {k}, y, {', '.join(f'(v{i} - mu{i}) / sd{i} AS z{i}' for i in range(d))}, CASE WHEN y = 1 THEN n / (2.0 * n1) ELSE n / (2.0 * (n - n1)) END AS w FROM {rows} JOIN s USING ({k}) WHERE n1 > 0 AND n1 < n),
it AS (
  SELECT {k}, 0 AS step, {', '.join(f'CAST(0 AS DOUBLE) AS b{i}' for i in range(m))} FROM s WHERE n1 > 0 AND n1 < n
  UNION ALL
  SELECT {k}, step + 1, {', '.join(f'b{i} + x{i}' for i in range(m))} FROM ({_solved(m, system)}) q)
SELECT {k}, {bs}, {', '.join(f'mu{i}, sd{i}' for i in range(d))} FROM it JOIN s USING ({k}) WHERE step = 20"""


def _fit_sql(name, features):
    """Training rows, fit and scores of one model over all tickets."""
    d = range(len(features))
    medians = "SELECT " + ", ".join(f"quantile_cont({f}, 0.5) AS m{i}" for i, f in enumerate(features)) + " FROM tickets"
    fx.SQL[f"{name}_train"] = f"SELECT 0 AS g, builder_hit AS y, {', '.join(f'COALESCE({f}, m{i}) AS v{i}' for i, f in enumerate(features))} FROM tickets, ({medians}) q"
    fx.SQL[f"{name}_fit"] = _newton(f"{name}_train", ["g"], len(features))
    z = {i: f"(COALESCE({features[i]}, m{i}) - mu{i}) / sd{i}" for i in d}
    margin = "b0" + "".join(f" + b{i + 1} * {z[i]}" for i in d)
    fx.SQL[f"{name}_scored"] = f"SELECT t.*, 1 / (1 + exp(-({margin}))) AS p FROM tickets t, {name}_fit, ({medians}) q"
    return (*fx.TICKET_FIXTURES, *(f"{name}_{x}" for x in ("train", "fit", "scored")))


ONE = ("book_implied_prob",)
ONE_FIT, FOUR_FIT, FIVE_FIT = _fit_sql("one", ONE), _fit_sql("four", FOUR), _fit_sql("five", FIVE)


def _predicted_sql(name):
    return f"SELECT builder_id, {R('p')} AS pred_prob, CAST(p >= 0.5 AS BIGINT) AS pred_hit, CAST(builder_hit AS BIGINT) AS builder_hit FROM {name}_scored"


def _model_rows(spark, folder, features):
    return fx.tickets(spark, folder, "builder_id", "builder_hit", *features)


def _walk_rows(spark, folder, features):
    return fx.tickets(spark, folder, "builder_id", "game_date", "builder_hit", "decimal_odds", "stake", *features)


def _predicted(spark, folder, features):
    t = _model_rows(spark, folder, features)
    return outcome.predict(outcome.train(t, features), t).select("builder_id", "pred_prob", "pred_hit", "builder_hit")


@query("train_predict", _predicted_sql("five"), FIVE_FIT)
def train_predict(spark, folder):
    return _predicted(spark, folder, FIVE)


@query("train_predict_one_feature", _predicted_sql("one"), ONE_FIT)
def train_predict_one_feature(spark, folder):
    return _predicted(spark, folder, ONE)


@query("saved_model_predict", _predicted_sql("five"), FIVE_FIT)
def saved_model_predict(spark, folder):
    """The model is written as a table, read again and applied without the fitted object."""
    t = _model_rows(spark, folder, FIVE)
    table = fx.stored(outcome.model_table(outcome.train(t, FIVE), FIVE))
    return outcome.predict_from_table(table, t).select("builder_id", "pred_prob", "pred_hit", "builder_hit")


def _auc(rows, keys=""):
    part, group = (f"PARTITION BY {keys}", f"GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {keys + ', ' if keys else ''}SUM(pos * (below - neg / 2.0)) / NULLIF(SUM(pos) * SUM(neg), 0) AS auc FROM (
  SELECT *, SUM(neg) OVER ({part} ORDER BY p) AS below FROM (SELECT {keys + ', ' if keys else ''}p, CAST(SUM(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS DOUBLE) AS pos, CAST(SUM(CASE WHEN y <> 1 THEN 1 ELSE 0 END) AS DOUBLE) AS neg
    FROM {rows} GROUP BY {keys + ', ' if keys else ''}p) c) r {group}"""


@query("model_metrics", f"""
SELECT {R('AVG(CAST((p >= 0.5) = (builder_hit = 1) AS INTEGER))')} AS accuracy, {R('AVG((p - builder_hit) * (p - builder_hit))')} AS brier,
  {R('AVG(-CASE WHEN builder_hit = 1 THEN ln(GREATEST(LEAST(p, 1 - 1e-7), 1e-7)) ELSE ln(1 - GREATEST(LEAST(p, 1 - 1e-7), 1e-7)) END)')} AS log_loss,
  CAST(COUNT(*) AS BIGINT) AS n_obs, {R('AVG(builder_hit)')} AS positive_rate, {R('AVG(CAST(p >= 0.5 AS INTEGER))')} AS pred_positive_rate,
  {R(f"(SELECT auc FROM ({_auc('(SELECT p, builder_hit AS y FROM five_scored) o')}) a)")} AS roc_auc FROM five_scored""", FIVE_FIT)
def model_metrics(spark, folder):
    t = _model_rows(spark, folder, FIVE)
    return outcome.evaluate_model(outcome.train(t, FIVE), t)


@query("feature_impact", " UNION ALL ".join(f"""SELECT '{f}' AS feature, {R(f'b{i + 1}')} AS coefficient, {R(f'ABS(b{i + 1})')} AS abs_coefficient, {R(f'(SELECT AVG({f}) FROM tickets)')} AS mean,
  {R(f'(SELECT STDDEV_SAMP({f}) FROM tickets)')} AS std, {R(f'(SELECT MIN({f}) FROM tickets)')} AS "min", {R(f'(SELECT MAX({f}) FROM tickets)')} AS "max" FROM four_fit""" for i, f in enumerate(FOUR)), FOUR_FIT[:-1])
def feature_impact(spark, folder):
    t = _model_rows(spark, folder, FOUR)
    return outcome.feature_impact(outcome.train(t, FOUR), t, FOUR)


def _walk_sql(kind, name, features):
    """Training rows, fits and test predictions of every fold."""
    low, d, walk = "lo" if kind == "expanding" else "lo + CAST(slot * 30 AS INTEGER)", range(len(features)), f"{kind}_{name}"
    medians = ", ".join(f"quantile_cont({f}, 0.5) OVER (PARTITION BY fold) AS m{i}" for i, f in enumerate(features))
    fx.SQL[f"{walk}_rows"] = f"""
SELECT fold, y, {', '.join(f'COALESCE({f}, m{i}) AS v{i}, m{i}' for i, f in enumerate(features))} FROM (SELECT fold, builder_hit AS y, {', '.join(features)}, {medians}
  FROM {kind} f, tickets t, (SELECT MIN(game_date) AS lo FROM tickets) b WHERE game_date >= {low} AND game_date < lo + CAST(slot * 30 + 180 AS INTEGER)) r"""
    fx.SQL[f"{walk}_fit"] = _newton(f"{walk}_rows", ["fold"], len(features))
    margin = "b0" + "".join(f" + b{i + 1} * (COALESCE({features[i]}, m{i}) - mu{i}) / sd{i}" for i in d)
    fx.SQL[f"{walk}_tested"] = f"""
SELECT f.fold + 1 AS fold, t.*, 1 / (1 + exp(-({margin}))) AS p
FROM {kind} f JOIN {walk}_fit USING (fold) JOIN (SELECT fold, {', '.join(f'ANY_VALUE(m{i}) AS m{i}' for i in d)} FROM {walk}_rows GROUP BY fold) q USING (fold), tickets t, (SELECT MIN(game_date) AS lo FROM tickets) b
WHERE game_date >= lo + CAST(slot * 30 + 180 AS INTEGER) AND game_date < lo + CAST(slot * 30 + 210 AS INTEGER)"""
    z = "(v{i} - mu{i}) / sd{i}"
    fx.SQL[f"{walk}_trained"] = f"SELECT fold + 1 AS fold, y, 1 / (1 + exp(-({_margin(len(features), z)}))) AS p FROM {walk}_rows JOIN {walk}_fit USING (fold)"
    return (*fx.TICKET_FIXTURES, kind, *(f"{walk}_{x}" for x in ("rows", "fit", "tested", "trained")))


def _backtest_sql(kind, name):
    walk = f"{kind}_{name}"
    return f"""
WITH m AS (SELECT fold, COUNT(*) AS n_obs, AVG(builder_hit) AS hit_rate, AVG(p) AS pred_hit_rate, AVG((p - builder_hit) * (p - builder_hit)) AS brier, SUM({TP}) / SUM(stake) AS roi, SUM({TP}) AS profit,
  SUM({TP}) / COUNT(*) AS yield, COALESCE(AVG({TU}) / NULLIF(STDDEV_SAMP({TU}), 0), 0) AS sharpe_ratio, SUM(stake) AS total_stake FROM {walk}_tested GROUP BY fold),
a AS ({_auc(f'{walk}_trained', 'fold')}), c AS (SELECT fold, AVG(CAST((p >= 0.5) = (y = 1) AS INTEGER)) AS accuracy FROM {walk}_trained GROUP BY fold)
SELECT m.fold, CAST(n_obs AS BIGINT) AS n_obs, {R('hit_rate')} AS hit_rate, {R('pred_hit_rate', 5)} AS pred_hit_rate, {R('brier', 5)} AS brier, {R('roi + 1e-10')} AS roi, {R('profit', 4)} AS profit, {R('yield + 1e-10', 5)} AS yield,
  {R('sharpe_ratio')} AS sharpe_ratio, {R('total_stake', 4)} AS total_stake, CAST(train_size AS BIGINT) AS train_n, CAST(test_size AS BIGINT) AS test_n, CAST(train_start AS VARCHAR) AS train_start, CAST(train_end AS VARCHAR) AS train_end,
  CAST(test_start AS VARCHAR) AS test_start, CAST(test_end AS VARCHAR) AS test_end, {R('accuracy')} AS train_accuracy, {R('auc')} AS train_roc_auc
FROM m JOIN a USING (fold) JOIN c USING (fold) JOIN {kind} f ON f.fold + 1 = m.fold"""


def _rounded(table):
    digits = {"pred_hit_rate": 5, "brier": 5, "profit": 4, "yield": 5, "total_stake": 4}
    shifted = table.withColumns({c: F.col(c) + 1e-10 for c in ("roi", "yield")})
    return shifted.withColumns({c: F.rint(F.col(c) * 10.0**d) / 10.0**d for c, d in digits.items()})


ROLLING, ROLLING_ONE, EXPANDING = _walk_sql("rolling", "five", FIVE), _walk_sql("rolling", "one", ONE), _walk_sql("expanding", "four", FOUR)


@query("rolling_backtest", _backtest_sql("rolling", "five"), ROLLING)
def rolling_backtest(spark, folder):
    return _rounded(folds.run_backtest(_walk_rows(spark, folder, FIVE), CFG, FIVE)[0])


@query("rolling_backtest_one_feature", _backtest_sql("rolling", "one"), ROLLING_ONE)
def rolling_backtest_one_feature(spark, folder):
    return _rounded(folds.run_backtest(_walk_rows(spark, folder, ONE), CFG, ONE)[0])


@query("rolling_predictions", f"""SELECT builder_id, CAST(game_date AS VARCHAR) AS game_date, {R('p')} AS pred_prob, CAST(builder_hit AS BIGINT) AS builder_hit, {R('decimal_odds')} AS decimal_odds,
{R('stake')} AS stake, fold FROM rolling_five_tested""", ROLLING[:-1])
def rolling_predictions(spark, folder):
    return folds.run_backtest(_walk_rows(spark, folder, FIVE), CFG, FIVE)[1]


@query("expanding_backtest", _backtest_sql("expanding", "four"), EXPANDING)
def expanding_backtest(spark, folder):
    return _rounded(folds.run_backtest(_walk_rows(spark, folder, FOUR), CFG, FOUR, kind="expanding")[0])
