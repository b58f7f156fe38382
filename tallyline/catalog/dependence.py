"""Correlation, rank, tail and information measures."""

from pyspark.sql import functions as F

from ..operators import dependence as ops
from ..operators.neighbours import knn_mutual_information
from . import fixtures as fx
from .registry import R, query

STATS = ("pts", "fg3m", "ast", "reb")
PAIRS = [(a, b) for i, a in enumerate(STATS) for b in STATS[i:]]
OFF = [(a, b) for a, b in PAIRS if a != b]


def _corr(a, b):
    return f"CASE WHEN VAR_POP({a}) * VAR_POP({b}) > 0 THEN COVAR_POP({a}, {b}) / sqrt(VAR_POP({a}) * VAR_POP({b})) END"


def _rank(s, keys):
    part = f"PARTITION BY {keys}" if keys else ""
    same = f"PARTITION BY {keys + ', ' if keys else ''}{s}"
    return f"RANK() OVER ({part} ORDER BY {s}) + (COUNT(*) OVER ({same}) - 1) / 2.0 AS {s}"


fx.SQL["entity_ranks"] = f"SELECT player_id, {', '.join(_rank(s, 'player_id') for s in STATS)} FROM box"
fx.SQL["global_ranks"] = f"SELECT {', '.join(_rank(s, '') for s in STATS)} FROM box"


def _entity(source):
    return " UNION ALL ".join(
        f"SELECT player_id, '{a}' AS stat_x, '{b}' AS stat_y, {_corr(a, b)} AS corr, COUNT(*) AS n_games FROM {source} GROUP BY player_id HAVING COUNT(*) >= 20"
        for a, b in PAIRS)


def _global(source):
    return " UNION ALL ".join(f"SELECT '{a}' AS stat_x, '{b}' AS stat_y, {_corr(a, b)} AS corr, COUNT(*) AS n_obs FROM {source}" for a, b in PAIRS)


fx.SQL["entity_pearson"] = _entity("box")
fx.SQL["entity_spearman"] = _entity("entity_ranks")
fx.SQL["global_pearson"] = _global("box")
fx.SQL["global_spearman"] = _global("global_ranks")


@query("entity_corr_pearson", f"SELECT player_id, stat_x, stat_y, {R('corr')} AS corr, n_games, 'pearson' AS method FROM entity_pearson", ("box", "entity_pearson"))
def entity_corr_pearson(spark, folder):
    return ops.entity_correlations(fx.stored(fx.box(spark, folder)), method="pearson")


@query("entity_corr_spearman", f"SELECT player_id, stat_x, stat_y, {R('corr')} AS corr, n_games, 'spearman' AS method FROM entity_spearman",
       ("box", "entity_ranks", "entity_spearman"))
def entity_corr_spearman(spark, folder):
    return ops.entity_correlations(fx.stored(fx.box(spark, folder)))


@query("global_corr_pearson", f"SELECT stat_x, stat_y, {R('corr')} AS corr, n_obs, 'pearson' AS method FROM global_pearson", ("box", "global_pearson"))
def global_corr_pearson(spark, folder):
    return ops.global_correlation(fx.stored(fx.box(spark, folder)), method="pearson")


@query("global_corr_spearman", f"SELECT stat_x, stat_y, {R('corr')} AS corr, n_obs, 'spearman' AS method FROM global_spearman",
       ("box", "global_ranks", "global_spearman"))
def global_corr_spearman(spark, folder):
    return ops.global_correlation(fx.stored(fx.box(spark, folder)))


@query("corr_summary", f"""SELECT stat_x, stat_y, {R('AVG(corr)')} AS mean_corr, {R('STDDEV_SAMP(corr)')} AS std_corr, {R('MIN(corr)')} AS min_corr,
{R('MAX(corr)')} AS max_corr, {R('quantile_cont(corr, 0.5)')} AS median_corr FROM entity_pearson WHERE stat_x <> stat_y GROUP BY stat_x, stat_y""", ("box", "entity_pearson"))
def corr_summary(spark, folder):
    return ops.correlation_summary(ops.entity_correlations(fx.stored(fx.box(spark, folder)), method="pearson"))


@query("corr_vs_global", f"""SELECT g.stat_x, g.stat_y, {R('ANY_VALUE(g.corr)')} AS global_corr, {R('AVG(e.corr)')} AS player_mean_corr,
{R('quantile_cont(e.corr, 0.5)')} AS player_median_corr, {R('STDDEV_SAMP(e.corr)')} AS player_std_corr
FROM global_pearson g JOIN entity_pearson e ON g.stat_x = e.stat_x AND g.stat_y = e.stat_y WHERE g.stat_x <> g.stat_y GROUP BY g.stat_x, g.stat_y""",
       ("box", "entity_pearson", "global_pearson"))
def corr_vs_global(spark, folder):
    b = fx.stored(fx.box(spark, folder))
    swapped = ops.entity_correlations(b, ("reb", "ast", "fg3m", "pts"), method="pearson")
    return ops.compare_with_global(swapped, ops.global_correlation(b, method="pearson"))


@query("high_corr_pairs", f"SELECT player_id, stat_x, stat_y, {R('corr')} AS corr, n_games FROM entity_pearson WHERE stat_x <> stat_y AND ABS(corr) >= 0.15",
       ("box", "entity_pearson"))
def high_corr_pairs(spark, folder):
    return ops.high_correlation_pairs(ops.entity_correlations(fx.stored(fx.box(spark, folder)), method="pearson"), 0.15).drop("method")


@query("high_corr_pair_counts", """SELECT stat_x, stat_y, CAST(COUNT(*) AS BIGINT) AS n_players FROM entity_pearson
WHERE stat_x <> stat_y AND ABS(corr) >= 0.15 GROUP BY stat_x, stat_y""", ("box", "entity_pearson"))
def high_corr_pair_counts(spark, folder):
    return ops.pair_counts(ops.high_correlation_pairs(ops.entity_correlations(fx.stored(fx.box(spark, folder)), method="pearson"), 0.15))


@query("strongest_corr", f"""SELECT stat_x, stat_y, {R('corr')} AS corr FROM global_pearson WHERE stat_x <> stat_y ORDER BY corr DESC, stat_x, stat_y LIMIT 3""",
       ("box", "global_pearson"))
def strongest_corr(spark, folder):
    return ops.strongest_correlations(ops.global_correlation(fx.stored(fx.box(spark, folder)), method="pearson")).select("stat_x", "stat_y", "corr")


@query("corr_matrix", f"""SELECT v.variable, {', '.join(f'''{R(f"""CASE WHEN v.variable = '{s}' THEN 1.0 ELSE MAX(g.corr) FILTER
  ((g.stat_x = v.variable AND g.stat_y = '{s}') OR (g.stat_y = v.variable AND g.stat_x = '{s}')) END""")} AS {s}''' for s in STATS)}
FROM (VALUES {', '.join(f"('{s}')" for s in STATS)}) v(variable), global_pearson g GROUP BY v.variable""", ("box", "global_pearson"))
def corr_matrix(spark, folder):
    return ops.correlation_matrix(ops.global_correlation(fx.stored(fx.box(spark, folder)), method="pearson"), STATS)


@query("corr_matrix_pairs", f"SELECT stat_x, stat_y, {R('corr')} AS corr FROM global_pearson WHERE stat_x <> stat_y", ("box", "global_pearson"))
def corr_matrix_pairs(spark, folder):
    matrix = ops.correlation_matrix(ops.global_correlation(fx.stored(fx.box(spark, folder)), method="pearson"), STATS)
    return ops.matrix_to_pairs(matrix, STATS)


# Line-item measures; the SQL of Kendall's tau counts strictly lower cells through the 50 quantities and 11 discounts.
VARS = ("l_quantity", "l_discount", "l_tax", "l_linenumber")
VPAIRS = [(a, b) for i, a in enumerate(VARS) for b in VARS[i + 1:]]
fx.SQL["item"] = "SELECT l_quantity, round_even(l_discount * 100, 0) AS l_discount, round_even(l_tax * 100, 0) AS l_tax, CAST(l_linenumber AS DOUBLE) AS l_linenumber FROM lineitem"
fx.SQL["item_ranks"] = f"SELECT {', '.join(_rank(s, '') for s in VARS)} FROM item"
fx.SQL["item_cells"] = " UNION ALL ".join(
    f"SELECT '{a}' AS var_x, '{b}' AS var_y, {a} AS x, {b} AS y, CAST(COUNT(*) AS DOUBLE) AS c FROM item GROUP BY {a}, {b}" for a, b in VPAIRS)


def item(spark, folder):
    return fx.table(spark, folder, "lineitem").select(
        "l_quantity", F.rint(F.col("l_discount") * 100).alias("l_discount"), F.rint(F.col("l_tax") * 100).alias("l_tax"),
        F.col("l_linenumber").cast("double").alias("l_linenumber"))


SPEARMAN = " UNION ALL ".join(f"SELECT '{a}' AS var_x, '{b}' AS var_y, {_corr(a, b)} AS spearman FROM item_ranks" for a, b in VPAIRS)
PEARSON = " UNION ALL ".join(f"SELECT '{a}' AS var_x, '{b}' AS var_y, {_corr(a, b)} AS pearson, COUNT(*) AS n FROM item" for a, b in VPAIRS)
TAILS = " UNION ALL ".join(f"""
SELECT '{a}' AS var_x, '{b}' AS var_y,
  (SELECT CASE WHEN COUNT(*) > 10 THEN {_corr(a, b)} END FROM item WHERE {a} >= (SELECT quantile_cont({a}, 0.9) FROM item)) AS upper_tail,
  (SELECT CASE WHEN COUNT(*) > 10 THEN {_corr(a, b)} END FROM item WHERE {a} <= (SELECT quantile_cont({a}, 0.1) FROM item)) AS lower_tail""" for a, b in VPAIRS)
KENDALL = """
SELECT var_x, var_y, (n * (n - 1) / 2 - tx - ty + txy - 2 * disc) / sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) AS kendall FROM (
  SELECT c.var_x, c.var_y, SUM(c.c) AS n, SUM(c.c * (c.c - 1) / 2) AS txy, ANY_VALUE(x.t) AS tx, ANY_VALUE(y.t) AS ty, ANY_VALUE(d.disc) AS disc
  FROM item_cells c
  JOIN (SELECT var_x, var_y, SUM(s * (s - 1) / 2) AS t FROM (SELECT var_x, var_y, x, SUM(c) AS s FROM item_cells GROUP BY 1, 2, 3) a GROUP BY 1, 2) x USING (var_x, var_y)
  JOIN (SELECT var_x, var_y, SUM(s * (s - 1) / 2) AS t FROM (SELECT var_x, var_y, y, SUM(c) AS s FROM item_cells GROUP BY 1, 2, 3) a GROUP BY 1, 2) y USING (var_x, var_y)
  JOIN (SELECT a.var_x, a.var_y, SUM(a.c * b.c) AS disc FROM item_cells a JOIN item_cells b ON a.var_x = b.var_x AND a.var_y = b.var_y AND a.x < b.x AND a.y > b.y GROUP BY 1, 2) d
    USING (var_x, var_y)
  GROUP BY c.var_x, c.var_y) k
"""
I3 = ("item", "item_ranks", "item_cells")


@query("pair_dependence", f"""
WITH p AS ({PEARSON}), s AS ({SPEARMAN}), k AS ({KENDALL}), t AS ({TAILS})
SELECT var_x, var_y, n, {R('pearson')} AS pearson, {R('spearman')} AS spearman, {R('kendall')} AS kendall, {R('upper_tail')} AS upper_tail,
       {R('lower_tail')} AS lower_tail, {R('upper_tail - lower_tail', 5)} AS tail_asymmetry,
       CASE WHEN ABS(spearman - pearson) < 0.1 THEN 'Linear' WHEN ABS(spearman) > ABS(pearson) + 0.1 THEN 'Monotonic (Non-linear)' ELSE 'Non-monotonic' END
         AS dependency_type, CASE WHEN ABS(spearman) > 0.5 THEN 'Strong' WHEN ABS(spearman) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS strength
FROM p JOIN s USING (var_x, var_y) JOIN k USING (var_x, var_y) JOIN t USING (var_x, var_y)""", I3)
def pair_dependence(spark, folder):
    table = ops.pair_dependence(item(spark, folder), VARS)
    return table.drop("spearman_p", "kendall_p").withColumn("tail_asymmetry", F.rint(F.col("tail_asymmetry") * 1e5) / 1e5)


# Student's t and the normal tail as the series of the incomplete beta and gamma functions.
TIE = "(SELECT var_x, var_y, SUM(s * (s - 1) / 2) AS t{0}, SUM(s * (s - 1) * (s - 2)) AS h{0}, SUM(s * (s - 1) * (2 * s + 5)) AS v{0} FROM (SELECT var_x, var_y, {0}, SUM(c) AS s FROM item_cells GROUP BY 1, 2, 3) a GROUP BY 1, 2)"


@query("pair_p_values", f"""
WITH p AS ({PEARSON}), s AS ({SPEARMAN}), k AS ({KENDALL}),
z AS (SELECT var_x, var_y, kendall * sqrt((n * (n - 1) / 2 - tx) * (n * (n - 1) / 2 - ty)) / sqrt((n * (n - 1) * (2 * n + 5) - vx - vy) / 18 + 2 * tx * ty / (n * (n - 1))
      + hx * hy / (9 * n * (n - 1) * (n - 2))) AS z, spearman * spearman AS r2, (n - 2) / 2.0 AS h
      FROM (SELECT var_x, var_y, CAST(n AS DOUBLE) AS n FROM p) p JOIN s USING (var_x, var_y) JOIN k USING (var_x, var_y)
      JOIN {TIE.format('x')} tx USING (var_x, var_y) JOIN {TIE.format('y')} ty USING (var_x, var_y))
SELECT var_x, var_y, {R('GREATEST(1 - SUM(CASE WHEN r2 > 0 AND r2 < 1 THEN exp(lgamma(0.5 + h + i) - lgamma(h) - lgamma(1.5 + i) + (0.5 + i) * ln(r2) + h * ln(1 - r2)) ELSE 0 END), 0)')} AS spearman_p,
       {R('GREATEST(1 - SUM(CASE WHEN z <> 0 THEN exp((0.5 + i) * ln(z * z / 2) - z * z / 2 - lgamma(1.5 + i)) ELSE 0 END), 0)')} AS kendall_p
FROM z, generate_series(0, 20000) AS g(i) GROUP BY var_x, var_y""", I3)
def pair_p_values(spark, folder):
    return ops.pair_dependence(item(spark, folder), VARS).select("var_x", "var_y", "spearman_p", "kendall_p")


@query("tail_dependence", f"WITH t AS ({TAILS}) SELECT var_x, var_y, {R('upper_tail')} AS upper_tail, {R('lower_tail')} AS lower_tail FROM t", ("item",))
def tail_dependence(spark, folder):
    return ops.tail_dependence(item(spark, folder), VPAIRS).drop("tail_asymmetry")


@query("dependence_mix", f"""
WITH p AS ({PEARSON}), s AS ({SPEARMAN}), j AS (SELECT
  CASE WHEN ABS(spearman - pearson) < 0.1 THEN 'Linear' WHEN ABS(spearman) > ABS(pearson) + 0.1 THEN 'Monotonic (Non-linear)' ELSE 'Non-monotonic' END AS ty,
  CASE WHEN ABS(spearman) > 0.5 THEN 'Strong' WHEN ABS(spearman) > 0.3 THEN 'Moderate' ELSE 'Weak' END AS st FROM p JOIN s USING (var_x, var_y))
SELECT 'type' AS kind, ty AS label, CAST(COUNT(*) AS BIGINT) AS pairs, {R(f'COUNT(*) * 100.0 / {len(VPAIRS)}')} AS share_pct FROM j GROUP BY ty
UNION ALL SELECT 'strength', st, CAST(COUNT(*) AS BIGINT), {R(f'COUNT(*) * 100.0 / {len(VPAIRS)}')} FROM j GROUP BY st""", I3)
def dependence_mix(spark, folder):
    return ops.dependence_mix(ops.pair_dependence(item(spark, folder), VARS))


@query("top_spearman_pairs", f"""WITH s AS ({SPEARMAN}) SELECT var_x, var_y, {R('spearman')} AS spearman FROM
(SELECT *, RANK() OVER (ORDER BY ABS(spearman) DESC) AS k FROM s) r WHERE k <= 3""", ("item", "item_ranks"))
def top_spearman_pairs(spark, folder):
    return ops.top_pairs(ops.pair_dependence(item(spark, folder), VARS), "spearman", 3, by_abs=True, keep_ties=True).select("var_x", "var_y", "spearman")


def _bins(v):
    return f"""SELECT '{v}' AS variable, COUNT(*) AS n, MIN({v}) AS lo, MAX({v}) AS hi, AVG({v}) AS mean, STDDEV_SAMP({v}) AS std,
      2 * (quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25)) / pow(COUNT(*), 1.0 / 3) AS width FROM item"""


fx.SQL["item_long"] = " UNION ALL ".join(f"SELECT '{v}' AS variable, {v} AS value FROM item" for v in VARS)
fx.SQL["item_bins"] = f"""SELECT *, CAST(LEAST(GREATEST(CASE WHEN width > 0 THEN ceil((hi - lo) / width) ELSE 10 END, 5), 50) AS INTEGER) AS n_bins
FROM ({' UNION ALL '.join(_bins(v) for v in VARS)}) b"""


@query("entropy_table", f"""
WITH c AS (SELECT variable, LEAST(floor((value - lo) / (hi - lo) * n_bins), n_bins - 1) AS bin, COUNT(*) AS w FROM item_long JOIN item_bins USING (variable) GROUP BY 1, 2),
e AS (SELECT variable, -SUM(w * 1.0 / n * log2(w * 1.0 / n)) AS h FROM c JOIN item_bins USING (variable) GROUP BY variable)
SELECT variable, {R('h')} AS entropy_bits, {R('h / log2(n_bins)')} AS normalized_entropy, {R('std / mean')} AS coefficient_of_variation, CAST(n_bins AS BIGINT) AS n_bins,
       CASE WHEN h / log2(n_bins) > 0.7 THEN 'High' WHEN h / log2(n_bins) > 0.4 THEN 'Moderate' ELSE 'Low' END AS variability
FROM e JOIN item_bins USING (variable)""", ("item", "item_long", "item_bins"))
def entropy_table(spark, folder):
    return ops.entropy_table(item(spark, folder), VARS)



fx.SQL["item_codes"] = "SELECT " + ", ".join(
    f"LEAST(floor((i.{v} - b{k}.lo) / (b{k}.hi - b{k}.lo) * b{k}.n_bins), b{k}.n_bins - 1) AS {v}" for k, v in enumerate(VARS)
) + " FROM item i " + " ".join(f"JOIN item_bins b{k} ON b{k}.variable = '{v}'" for k, v in enumerate(VARS))


@query("binned_mi", " UNION ALL ".join(f"""
SELECT '{a}' AS var_x, '{b}' AS var_y, {R('SUM(c / n * ln(c * n / (mx * my)))')} AS mi FROM (
  SELECT CAST(c AS DOUBLE) AS c, CAST(SUM(c) OVER () AS DOUBLE) AS n, CAST(SUM(c) OVER (PARTITION BY x) AS DOUBLE) AS mx, CAST(SUM(c) OVER (PARTITION BY y) AS DOUBLE) AS my
  FROM (SELECT {a} AS x, {b} AS y, COUNT(*) AS c FROM item_codes GROUP BY {a}, {b}) q) r""" for i, a in enumerate(VARS) for b in VARS[i:]), ("item", "item_bins", "item_codes"))
def binned_mi(spark, folder):
    return ops.mutual_information(item(spark, folder), VARS)


@query("trend_line", " UNION ALL ".join(f"""SELECT '{a}' AS var_x, '{b}' AS var_y, {R(f'regr_slope({b}, {a})')} AS slope, {R(f'regr_intercept({b}, {a})')} AS intercept,
{R(f'regr_r2({b}, {a})')} AS r2, CAST(regr_count({b}, {a}) AS BIGINT) AS n FROM item""" for a, b in VPAIRS), ("item",))
def trend_line(spark, folder):
    return ops.trend_lines(item(spark, folder), VPAIRS)


@query("pseudo_observations", f"""
SELECT l_quantity, l_discount, CAST(COUNT(*) AS BIGINT) AS weight, {R('ANY_VALUE(u)')} AS u, {R('ANY_VALUE(v)')} AS v FROM (
  SELECT i.*, (RANK() OVER (ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2.0) / (COUNT(*) OVER () + 1) AS u,
         (RANK() OVER (ORDER BY l_discount) + (COUNT(*) OVER (PARTITION BY l_discount) - 1) / 2.0) / (COUNT(*) OVER () + 1) AS v FROM item i) t
GROUP BY l_quantity, l_discount""", ("item",))
def pseudo_observations(spark, folder):
    return ops.pseudo_observations(item(spark, folder), "l_quantity", "l_discount")


@query("rank_density_2d", """
SELECT CAST(floor(u * 30) AS BIGINT) AS bin_x, CAST(floor(v * 30) AS BIGINT) AS bin_y, CAST(COUNT(*) AS BIGINT) AS "rows" FROM (
  SELECT (RANK() OVER (ORDER BY l_quantity) + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2.0) / (COUNT(*) OVER () + 1) AS u,
         (RANK() OVER (ORDER BY l_discount) + (COUNT(*) OVER (PARTITION BY l_discount) - 1) / 2.0) / (COUNT(*) OVER () + 1) AS v FROM item) t GROUP BY 1, 2""", ("item",))
def rank_density_2d(spark, folder):
    return ops.rank_density(item(spark, folder), "l_quantity", "l_discount")


# One row per customer; the SQL compares every two of them, in whole multiples of 2^-30 standard deviations.
KNN_VARS = ("balance", "spent", "orders")
fx.SQL["spenders"] = """SELECT o_custkey, ANY_VALUE(c_acctbal) AS balance, round_even(SUM(o_totalprice) * 100, 0) AS spent, CAST(COUNT(*) AS DOUBLE) AS orders
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY o_custkey"""
fx.SQL["spender_units"] = "SELECT o_custkey AS id, " + ", ".join(f"CAST(round_even({v} / (SELECT STDDEV_POP({v}) FROM spenders) * 1073741824, 0) AS BIGINT) AS {v}" for v in KNN_VARS) + " FROM spenders"


def spenders(spark, folder):
    orders, customer = fx.table(spark, folder, "orders"), fx.table(spark, folder, "customer")
    met = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return met.groupBy("o_custkey").agg(F.first("c_acctbal").alias("balance"), F.rint(F.sum("o_totalprice") * 100).alias("spent"), F.count(F.lit(1)).cast("double").alias("orders"))


def _digamma(n):
    z = f"({n} + 8.0)"
    return f"(ln({z}) - 0.5 / {z} - 1.0 / (12.0 * {z} * {z}) + 1.0 / (120.0 * pow({z}, 4)) - 1.0 / (252.0 * pow({z}, 6))" + "".join(f" - 1.0 / ({n} + {i}.0)" for i in range(8)) + ")"


def _knn_sql(a, b, k=3):
    return f"""
SELECT '{a}' AS var_x, '{b}' AS var_y, {R(f"GREATEST({_digamma('COUNT(*)')} + {_digamma(f'{k}')} - AVG({_digamma('nx')} + {_digamma('ny')}), 0)")} AS mi, CAST(COUNT(*) AS BIGINT) AS n FROM (
  SELECT d.id, COUNT(*) FILTER (WHERE ABS(o.{a} - d.{a}) <= GREATEST(r - 1, 0)) AS nx, COUNT(*) FILTER (WHERE ABS(o.{b} - d.{b}) <= GREATEST(r - 1, 0)) AS ny
  FROM (SELECT p.id, ANY_VALUE(p.{a}) AS {a}, ANY_VALUE(p.{b}) AS {b}, list_sort(list(GREATEST(ABS(p.{a} - q.{a}), ABS(p.{b} - q.{b}))))[{k}] AS r
        FROM spender_units p JOIN spender_units q ON p.id <> q.id GROUP BY p.id) d, spender_units o GROUP BY d.id) c"""


@query("knn_mi", " UNION ALL ".join(_knn_sql(a, b) for i, a in enumerate(KNN_VARS) for b in KNN_VARS[i + 1:]), ("spenders", "spender_units"))
def knn_mi(spark, folder):
    return knn_mutual_information(spenders(spark, folder), KNN_VARS)


@query("top_knn_mi", f"SELECT * FROM ({' UNION ALL '.join(_knn_sql(a, b) for i, a in enumerate(KNN_VARS) for b in KNN_VARS[i + 1:])}) m ORDER BY mi DESC, var_x, var_y LIMIT 10", ("spenders", "spender_units"))
def top_knn_mi(spark, folder):
    return ops.top_pairs(knn_mutual_information(spenders(spark, folder), KNN_VARS), "mi", 10)


# One row per nation: few enough rows without ties for Kendall's exact p-value, by the recurrence of inversion counts.
NATION_VARS = ("balance", "supply", "spent")
NATION_PAIRS = [(a, b) for i, a in enumerate(NATION_VARS) for b in NATION_VARS[i + 1:]]
fx.SQL["nations"] = """
SELECT c.n, c.balance, s.supply, o.spent FROM (SELECT c_nationkey AS n, SUM(c_acctbal) AS balance FROM customer GROUP BY 1) c
JOIN (SELECT s_nationkey AS n, SUM(s_acctbal) AS supply FROM supplier GROUP BY 1) s USING (n)
JOIN (SELECT c_nationkey AS n, SUM(o_totalprice) AS spent FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1) o USING (n)"""
fx.SQL["orders_of"] = """
WITH RECURSIVE f AS (SELECT 1 AS n, [CAST(1 AS DOUBLE)] AS c UNION ALL
  SELECT n + 1, list_transform(range(n * (n + 1) // 2 + 1), lambda d: list_sum(c[greatest(1, d - n + 1):d + 1]) / (n + 1)) FROM f WHERE n < 33)
SELECT n, c FROM f"""


def nations(spark, folder):
    customer, supplier, orders = (fx.table(spark, folder, t) for t in ("customer", "supplier", "orders"))
    balance = customer.groupBy(F.col("c_nationkey").alias("n")).agg(F.sum("c_acctbal").alias("balance"))
    supply = supplier.groupBy(F.col("s_nationkey").alias("n")).agg(F.sum("s_acctbal").alias("supply"))
    spent = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("n")).agg(F.sum("o_totalprice").alias("spent"))
    return balance.join(supply, "n").join(spent, "n")


@query("kendall_exact_p", " UNION ALL ".join(f"""
SELECT '{a}' AS var_x, '{b}' AS var_y, {R('1 - 2.0 * disc / (n * (n - 1) / 2)')} AS kendall,
       {R('LEAST(2 * list_sum(c[1:CAST(LEAST(disc, n * (n - 1) // 2 - disc) AS BIGINT) + 1]), 1)')} AS kendall_p FROM (
  SELECT (SELECT COUNT(*) FROM nations) AS n, (SELECT COUNT(*) FROM nations p JOIN nations q ON p.{a} < q.{a} AND p.{b} > q.{b}) AS disc) k JOIN orders_of USING (n)""" for a, b in NATION_PAIRS), ("nations", "orders_of"))
def kendall_exact_p(spark, folder):
    return ops.kendall_table(fx.stored(nations(spark, folder)).select(*NATION_VARS), NATION_PAIRS)
