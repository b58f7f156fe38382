"""Goodness of fit, histograms, densities and box summaries."""

from pyspark.sql import functions as F

from ..operators import cleaning, goodness as ops
from ..operators.likelihood import mle_fits
from . import fixtures as fx
from .dependence import VARS, item
from .registry import R, query

M2 = "AVG((value - mu) * (value - mu))"
MOMENTS = f"""
SELECT variable, COUNT(*) AS n, AVG((value - mu) * (value - mu) * (value - mu)) / pow({M2}, 1.5) AS skew,
       AVG((value - mu) * (value - mu) * (value - mu) * (value - mu)) / pow({M2}, 2) - 3 AS kurt
FROM (SELECT *, AVG(value) OVER (PARTITION BY variable) AS mu FROM item_long) m GROUP BY variable
"""


@query("normality_moments", f"""WITH m AS ({MOMENTS}) SELECT variable, n, {R('skew')} AS skewness, {R('kurt')} AS kurtosis,
{R('n / 6.0 * (skew * skew + kurt * kurt / 4)', 3)} AS jb, {R('exp(-(n / 6.0 * (skew * skew + kurt * kurt / 4)) / 2)')} AS jb_p FROM m""", ("item", "item_long"))
def normality_moments(spark, folder):
    return ops.normality_moments(item(spark, folder), VARS).withColumn("jb", F.rint(F.col("jb") * 1e3) / 1e3)


@query("ks_exponential", f"""
WITH c AS (SELECT variable, value, COUNT(*) AS w FROM item_long GROUP BY 1, 2),
r AS (SELECT variable, value, w, SUM(w) OVER (PARTITION BY variable ORDER BY value) AS up, SUM(w) OVER (PARTITION BY variable) AS n,
       SUM(w * value) OVER (PARTITION BY variable) / SUM(w) OVER (PARTITION BY variable) AS mu FROM c),
f AS (SELECT *, CASE WHEN value > 0 THEN 1 - exp(-value / mu) ELSE 0 END AS cdf FROM r)
SELECT variable, 'exponential' AS family, {R('ANY_VALUE(mu)')} AS a, CAST(ANY_VALUE(n) AS BIGINT) AS n,
       {R('MAX(GREATEST(cdf - (up - w) * 1.0 / n, up * 1.0 / n - cdf))')} AS ks FROM f GROUP BY variable""", ("item", "item_long"))
def ks_exponential(spark, folder):
    return ops.fit_families(item(spark, folder), VARS).filter("family = 'exponential'").select("variable", "family", "a", "n", "ks")


@query("ks_poisson", f"""
WITH c AS (SELECT variable, value, COUNT(*) AS w FROM item_long GROUP BY 1, 2),
r AS (SELECT variable, value, w, SUM(w) OVER (PARTITION BY variable ORDER BY value) AS up, SUM(w) OVER (PARTITION BY variable) AS n,
       SUM(w * value) OVER (PARTITION BY variable) / SUM(w) OVER (PARTITION BY variable) AS mu FROM c),
f AS (SELECT *, (SELECT SUM(exp(i * ln(mu) - mu - lgamma(i + 1))) FROM generate_series(0, CAST(value AS BIGINT)) AS t(i)) AS cdf FROM r)
SELECT variable, {R('ANY_VALUE(mu)')} AS a, {R('MAX(GREATEST(cdf - (up - w) * 1.0 / n, up * 1.0 / n - cdf))')} AS ks FROM f GROUP BY variable""", ("item", "item_long"))
def ks_poisson(spark, folder):
    return ops.fit_families(item(spark, folder), VARS).filter("family = 'poisson'").select("variable", "a", "ks")


@query("anderson_darling_exponential", f"""
WITH c AS (SELECT variable, value, COUNT(*) AS w FROM item_long GROUP BY 1, 2),
r AS (SELECT variable, value, CAST(w AS DOUBLE) AS w, CAST(SUM(w) OVER (PARTITION BY variable ORDER BY value) AS DOUBLE) AS up,
       CAST(SUM(w) OVER (PARTITION BY variable) AS DOUBLE) AS n, SUM(w * value) OVER (PARTITION BY variable) / SUM(w) OVER (PARTITION BY variable) AS mu FROM c),
f AS (SELECT *, up * up - (up - w) * (up - w) AS low, 1 - exp(-value / mu) AS cdf FROM r)
SELECT variable, CAST(ANY_VALUE(n) AS BIGINT) AS n, CASE WHEN MIN(value) = 0 THEN CAST('Infinity' AS DOUBLE) ELSE
       {R('-ANY_VALUE(n) - SUM(CASE WHEN cdf > 0 THEN low * ln(cdf) - (2 * n * w - low) * value / mu END) / ANY_VALUE(n)', 3)} END AS ad
FROM f GROUP BY variable""", ("item", "item_long"))
def anderson_darling_exponential(spark, folder):
    """Two of the variables hold zeros, which an exponential cannot take."""
    table = ops.anderson_darling(item(spark, folder), VARS).filter("family = 'exponential'")
    return table.select("variable", "n", (F.rint(F.col("ad") * 1e3) / 1e3).alias("ad"))


# Every candidate family fitted by moments and its distance; the incomplete gamma and beta functions as positive series,
# the Weibull shape by bisection.
fx.SQL["fits"] = """
WITH RECURSIVE m AS (
  SELECT variable, CAST(COUNT(*) AS DOUBLE) AS n, AVG(value) AS mean, STDDEV_SAMP(value) AS std, VAR_SAMP(value) AS var, STDDEV_POP(value) AS sigma, MIN(value) AS low, MAX(value) AS high,
         AVG(CASE WHEN value > 0 THEN ln(value) END) AS log_mean, STDDEV_POP(CASE WHEN value > 0 THEN ln(value) END) AS log_sigma, BOOL_AND(value = floor(value)) AS whole
  FROM item_long GROUP BY variable),
b AS (SELECT variable, ln(1 + var / (mean * mean)) AS target, ln(0.001) AS lo, ln(1e9) AS hi, 0 AS step FROM m WHERE mean > 0 AND var > 0
  UNION ALL
  SELECT variable, target, CASE WHEN wide THEN mid ELSE lo END, CASE WHEN wide THEN hi ELSE mid END, step + 1
  FROM (SELECT *, (lo + hi) / 2 AS mid, lgamma(1 + 2 / exp((lo + hi) / 2)) - 2 * lgamma(1 + 1 / exp((lo + hi) / 2)) > target AS wide FROM b WHERE step < 100) x),
shape AS (SELECT variable, exp((lo + hi) / 2) AS k FROM b WHERE step = 100),
f AS (
  SELECT variable, 'normal' AS family, mean AS a, sigma AS b FROM m WHERE sigma > 0
  UNION ALL SELECT variable, 'lognormal', log_mean, log_sigma FROM m WHERE low > 0 AND log_sigma > 0
  UNION ALL SELECT variable, 'exponential', mean, 0 FROM m WHERE low >= 0 AND mean > 0
  UNION ALL SELECT variable, 'gamma', mean * mean / var, var / mean FROM m WHERE low >= 0 AND var > 0 AND mean > 0
  UNION ALL SELECT variable, 'beta', mean * (mean * (1 - mean) / var - 1), (1 - mean) * (mean * (1 - mean) / var - 1) FROM m WHERE low >= 0 AND high <= 1 AND mean > 0 AND var > 0 AND mean * (1 - mean) / var > 1
  UNION ALL SELECT variable, 'weibull', k, mean / exp(lgamma(1 + 1 / k)) FROM m JOIN shape USING (variable) WHERE low >= 0
  UNION ALL SELECT variable, 'poisson', mean, 0 FROM m WHERE whole AND low >= 0 AND mean > 0
  UNION ALL SELECT variable, 'nbinom', mean * mean / (var - mean), mean / var FROM m WHERE whole AND low >= 0 AND var > mean AND mean > 0),
c AS (SELECT variable, value, CAST(COUNT(*) AS DOUBLE) AS w FROM item_long GROUP BY 1, 2),
r AS (SELECT *, SUM(w) OVER (PARTITION BY variable ORDER BY value) AS up, SUM(w) OVER (PARTITION BY variable) AS n FROM c),
t AS (SELECT r.*, f.family, f.a, f.b,
  CASE family WHEN 'normal' THEN pow((value - a) / b, 2) / 2 WHEN 'lognormal' THEN pow((ln(GREATEST(value, 1e-300)) - a) / b, 2) / 2 WHEN 'gamma' THEN value / b WHEN 'poisson' THEN a END AS gx,
  CASE family WHEN 'gamma' THEN a WHEN 'poisson' THEN value + 1 ELSE 0.5 END AS ga,
  CASE family WHEN 'beta' THEN value WHEN 'nbinom' THEN b END AS bx, CASE family WHEN 'beta' THEN b WHEN 'nbinom' THEN value + 1 END AS bb FROM r JOIN f USING (variable)),
u AS (SELECT *, bx > (a + 1) / (a + bb + 2) AS swapped FROM t),
v AS (SELECT *, CASE WHEN swapped THEN bb ELSE a END AS p, CASE WHEN swapped THEN a ELSE bb END AS q, CASE WHEN swapped THEN 1 - bx ELSE bx END AS x FROM u),
g AS (SELECT variable, family, value, ANY_VALUE(swapped) AS swapped, SUM(CASE WHEN gx > 0 THEN exp((ga + i) * ln(GREATEST(gx, 1e-300)) - gx - lgamma(ga + i + 1)) WHEN x > 0 AND x < 1 THEN
        exp(lgamma(p + q + i) - lgamma(q) - lgamma(p + i + 1) + (p + i) * ln(x) + q * ln(1 - x)) ELSE 0 END) AS part
      FROM v, generate_series(0, 1500) AS s(i) GROUP BY 1, 2, 3),
d AS (SELECT t.*, CASE family WHEN 'normal' THEN 0.5 + sign(value - a) * part / 2 WHEN 'lognormal' THEN 0.5 + sign(ln(GREATEST(value, 1e-300)) - a) * part / 2
        WHEN 'exponential' THEN 1 - exp(-value / a) WHEN 'weibull' THEN 1 - exp(-pow(value / b, a)) WHEN 'poisson' THEN 1 - part WHEN 'beta' THEN CASE WHEN value >= 1 THEN 1 WHEN swapped THEN 1 - part ELSE part END WHEN 'nbinom' THEN CASE WHEN swapped THEN 1 - part ELSE part END ELSE part END AS cdf
      FROM t JOIN g USING (variable, family, value))
SELECT variable, family, ANY_VALUE(n) AS n, MAX(GREATEST(cdf - (up - w) / n, up / n - cdf)) AS ks FROM d GROUP BY variable, family"""
fx.SQL["gof"] = f"""
WITH m AS ({MOMENTS}), s AS (SELECT variable, AVG(value) AS mean, STDDEV_SAMP(value) AS std FROM item_long GROUP BY variable),
best AS (SELECT variable, arg_min(family, ks) AS family, MIN(ks) AS ks, ANY_VALUE(n) AS kn FROM fits GROUP BY variable),
j AS (SELECT *, n / 6.0 * (skew * skew + kurt * kurt / 4) AS jb, sqrt(kn) * ks AS x FROM m JOIN s USING (variable) JOIN best USING (variable))
SELECT variable, n, mean, std, skew, kurt, family, ks, CASE WHEN x < 0.2 THEN 1.0 ELSE GREATEST(0, LEAST(1, 2 * (SELECT SUM(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * x * x)) FROM generate_series(1, 100) AS g(k)))) END AS ks_p,
       jb, exp(-jb / 2) AS jb_p, exp(-jb / 2) > 0.05 AS is_normal FROM j"""
GOF = ("item", "item_long", "fits", "gof")


@query("gof_table", f"""SELECT variable, n, {R('mean')} AS mean, {R('std')} AS std, {R('skew')} AS skewness, {R('kurt')} AS kurtosis, family AS best_family, {R('ks')} AS ks, {R('ks_p')} AS ks_p,
{R('jb', 3)} AS jb, {R('jb_p')} AS jb_p, is_normal FROM gof""", GOF)
def gof_table(spark, folder):
    return ops.goodness_table(item(spark, folder), VARS).withColumn("jb", F.rint(F.col("jb") * 1e3) / 1e3)


@query("family_distances", f"SELECT variable, family, {R('ks')} AS ks FROM fits", GOF[:3])
def family_distances(spark, folder):
    """Every candidate family, not the best alone."""
    return ops.fit_families(item(spark, folder), VARS).select("variable", "family", "ks")


@query("family_mix", f"""SELECT family AS best_family, CAST(COUNT(*) AS BIGINT) AS variables, {R('COUNT(*) * 100.0 / (SELECT COUNT(*) FROM gof)')} AS share_pct,
{R('(SELECT SUM(CAST(is_normal AS INTEGER)) FROM gof) * 100.0 / (SELECT COUNT(*) FROM gof)')} AS normal_pct FROM gof GROUP BY family""", GOF)
def family_mix(spark, folder):
    return ops.family_mix(ops.goodness_table(item(spark, folder), VARS))


AD = f"""
WITH c AS (SELECT variable, value, CAST(COUNT(*) AS DOUBLE) AS w FROM item_long GROUP BY 1, 2),
r AS (SELECT *, SUM(w) OVER (PARTITION BY variable ORDER BY value) AS up, SUM(w) OVER (PARTITION BY variable) AS n FROM c),
m AS (SELECT variable, AVG(value) AS mean, STDDEV_SAMP(value) AS std FROM item_long GROUP BY variable),
t AS (SELECT r.*, mean, up * up - (up - w) * (up - w) AS low, (value - mean) / std AS z FROM r JOIN m USING (variable)),
p AS (SELECT variable, value, 0.5 + sign(ANY_VALUE(z)) / 2 * SUM(CASE WHEN z <> 0 THEN exp((0.5 + i) * ln(z * z / 2) - z * z / 2 - lgamma(1.5 + i)) ELSE 0 END) AS cdf
      FROM t, generate_series(0, 400) AS g(i) GROUP BY 1, 2),
a AS (SELECT variable, 'normal' AS family, ANY_VALUE(n) AS n, -ANY_VALUE(n) - SUM(low * ln(cdf) + (2 * n * w - low) * ln(1 - cdf)) / ANY_VALUE(n) AS ad,
             rint(0.787 / (1 + 4 / ANY_VALUE(n) - 25 / (ANY_VALUE(n) * ANY_VALUE(n))) * 1000) / 1000 AS crit FROM t JOIN p USING (variable, value) GROUP BY variable
      UNION ALL SELECT variable, 'exponential', ANY_VALUE(n), CASE WHEN MIN(value) = 0 THEN CAST('Infinity' AS DOUBLE)
             ELSE -ANY_VALUE(n) - SUM(CASE WHEN value > 0 THEN low * ln(1 - exp(-value / mean)) - (2 * n * w - low) * value / mean END) / ANY_VALUE(n) END,
             rint(1.341 / (1 + 0.6 / ANY_VALUE(n)) * 1000) / 1000 FROM t GROUP BY variable)
SELECT variable, family, CAST(n AS BIGINT) AS n, CASE WHEN isinf(ad) THEN ad ELSE {R('CASE WHEN isinf(ad) THEN 0 ELSE ad END', 3)} END AS ad, crit AS ad_critical, ad > crit AS rejected FROM a"""


@query("anderson_darling", AD.replace("rint(", "round("), ("item", "item_long"))
def anderson_darling(spark, folder):
    return ops.anderson_darling(item(spark, folder), VARS).withColumn("ad", F.rint(F.col("ad") * 1e3) / 1e3)


# A rational approximation of the normal quantile, good to 1e-9, for the middle and for the tails.
_MIDDLE = ((-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02, 1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00),
           (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02, 6.680131188771972e+01, -1.328068155288572e+01, 1.0))
_TAIL = ((-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00, -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00),
         (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00, 3.754408661907416e+00, 1.0))


def _poly(values, x):
    out = str(values[0])
    for v in values[1:]:
        out = f"({out} * {x} + {v})"
    return out


# The sorted rows one by one, each with its own score, those of the lower half turned over; the tail of the normal by Simpson's rule.
@query("shapiro_francia", f"""
WITH r AS (SELECT variable, value, row_number() OVER (PARTITION BY variable ORDER BY value) AS i, COUNT(*) OVER (PARTITION BY variable) AS n, AVG(value) OVER (PARTITION BY variable) AS mu FROM item_long WHERE value IS NOT NULL),
q AS (SELECT *, (LEAST(i, n + 1 - i) - 0.375) / (n + 0.25) AS p, CASE WHEN 2 * i > n THEN -1.0 ELSE 1.0 END AS side FROM r),
t AS (SELECT *, sqrt(-2 * ln(p)) AS g, p - 0.5 AS y, (p - 0.5) * (p - 0.5) AS y2 FROM q),
m AS (SELECT *, side * CASE WHEN p < 0.02425 THEN {_poly(_TAIL[0], 'g')} / {_poly(_TAIL[1], 'g')} ELSE y * {_poly(_MIDDLE[0], 'y2')} / {_poly(_MIDDLE[1], 'y2')} END AS score FROM t),
w AS (SELECT variable, COUNT(*) AS n, LEAST(pow(SUM((value - mu) * score), 2) / (SUM(score * score) * SUM((value - mu) * (value - mu))), 1.0) AS w, ln(COUNT(*)) AS u FROM m GROUP BY variable),
z AS (SELECT *, (ln(1 - w) - (-1.2725 + 1.0521 * (ln(u) - u))) / (1.0308 - 0.26758 * (ln(u) + 2 / u)) AS z FROM w),
p AS (SELECT *, (SELECT SUM(CASE WHEN k = 0 OR k = 4000 THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END * exp(-pow(GREATEST(z, -10) + k * 0.005, 2) / 2)) FROM generate_series(0, 4000) AS s(k)) * 0.005 / 3 / sqrt(2 * pi()) AS p FROM z)
SELECT variable, n, {R('w')} AS w, {R('z', 3)} AS z, {R('p')} AS p, p > 0.05 AS is_normal FROM p""", ("item", "item_long"))
def shapiro_francia(spark, folder):
    return ops.shapiro_francia(item(spark, folder), VARS).withColumn("z", F.rint(F.col("z") * 1e3) / 1e3)


@query("histogram", f"""
SELECT CAST(l_quantity - (SELECT MIN(l_quantity) FROM item) AS BIGINT) AS bin, {R('l_quantity')} AS "left", {R('l_quantity + 1')} AS "right",
  CAST(COUNT(*) AS DOUBLE) AS weight, {R('COUNT(*) * 1.0 / (SELECT COUNT(*) FROM item)')} AS density,
  {R('(SELECT LEAST(MAX(l_quantity), 1.2 * quantile_cont(l_quantity, 0.95)) FROM item)')} AS x_max FROM item GROUP BY l_quantity""", ("item",))
def histogram(spark, folder):
    return ops.histogram(item(spark, folder), "l_quantity", discrete=True)


@query("histogram_equal_width", f"""
WITH l AS (SELECT MIN(l_extendedprice) AS lo, MAX(l_extendedprice) AS hi, COUNT(*) AS n, LEAST(MAX(l_extendedprice), 1.2 * quantile_cont(l_extendedprice, 0.95)) AS x FROM lineitem),
b AS (SELECT LEAST(floor((l_extendedprice - lo) / ((hi - lo) / 40)), 39) AS bin, COUNT(*) AS w, ANY_VALUE(lo) AS lo, ANY_VALUE((hi - lo) / 40) AS width, ANY_VALUE(n) AS n,
       ANY_VALUE(x) AS x FROM lineitem, l GROUP BY 1)
SELECT CAST(bin AS BIGINT) AS bin, {R('lo + bin * width', 3)} AS "left", {R('lo + (bin + 1) * width', 3)} AS "right", CAST(w AS DOUBLE) AS weight,
       {R('w * 1.0 / n / width')} AS density, {R('x', 3)} AS x_max FROM b""")
def histogram_equal_width(spark, folder):
    table = ops.histogram(fx.table(spark, folder, "lineitem"), "l_extendedprice")
    return table.withColumns({c: F.rint(F.col(c) * 1e3) / 1e3 for c in ("left", "right", "x_max")})


# A percentage with attempts: discount points out of ten, tried l_quantity times.
fx.SQL["pct"] = "SELECT round_even(l_discount * 100, 0) / 10 AS pct, l_quantity AS tries FROM lineitem"


def pct(spark, folder):
    return fx.table(spark, folder, "lineitem").select((F.rint(F.col("l_discount") * 100) / 10).alias("pct"), F.col("l_quantity").alias("tries"))


@query("weighted_histogram", f"""
WITH k AS (SELECT * FROM pct WHERE tries >= 3 AND pct > 0), l AS (SELECT MIN(pct) AS lo, MAX(pct) AS hi, SUM(tries) AS n FROM k),
b AS (SELECT LEAST(floor((pct - lo) / ((hi - lo) / 7.0)), 6) AS bin, SUM(tries) AS w, ANY_VALUE(n) AS n, ANY_VALUE((hi - lo) / 7.0) AS width FROM k, l GROUP BY 1)
SELECT CAST(bin AS BIGINT) AS bin, w AS weight, {R('w / n / width')} AS density FROM b""", ("pct",))
def weighted_histogram(spark, folder):
    return ops.histogram(pct(spark, folder), "pct", bins=7, attempts="tries", min_attempts=3, percentage=True).select("bin", "weight", "density")


@query("attempt_filter_summary", f"""
SELECT 'pct' AS stat, CAST(COUNT(*) AS BIGINT) AS original_n, CAST(SUM(CASE WHEN tries < 3 THEN 1 ELSE 0 END) AS BIGINT) AS low_attempts_removed,
       CAST(SUM(CASE WHEN tries >= 3 AND pct = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros_removed,
       CAST(SUM(CASE WHEN tries >= 3 AND pct <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS final_n,
       {R('SUM(CASE WHEN tries >= 3 AND pct <> 0 THEN 0 ELSE 1 END) * 100.0 / COUNT(*)')} AS pct_filtered FROM pct""", ("pct",))
def attempt_filter_summary(spark, folder):
    return cleaning.attempt_filter_summary(pct(spark, folder), {"pct": ("tries", 3)})


fx.SQL["kde_in"] = "SELECT CAST(p_size AS DOUBLE) AS v FROM part"


@query("kde_grid", f"""
WITH l AS (SELECT COUNT(*) AS n, STDDEV_SAMP(v) * pow(COUNT(*), -0.2) AS h, MIN(v) AS lo, LEAST(MAX(v), 1.2 * quantile_cont(v, 0.95)) AS hi FROM kde_in),
c AS (SELECT v, COUNT(*) AS w FROM kde_in GROUP BY v)
SELECT point, {R('ANY_VALUE(lo + point * (hi - lo) / 199.0)')} AS x,
       {R('SUM(w * exp(-pow((v - (lo + point * (hi - lo) / 199.0)) / h, 2) / 2)) / ANY_VALUE(n * h * sqrt(2 * pi()))')} AS density
FROM c, l, generate_series(0, 199) AS g(point) GROUP BY point""", ("kde_in",))
def kde_grid(spark, folder):
    return ops.kde_grid(fx.table(spark, folder, "part"), "p_size")


@query("kde_bounded", f"""
WITH k AS (SELECT pct AS v FROM pct WHERE pct > 0),
l AS (SELECT COUNT(*) AS n, STDDEV_SAMP(v) * pow(COUNT(*), -0.2) * 1.8 AS h, GREATEST(MIN(v) - 0.05, 0) AS lo, LEAST(LEAST(MAX(v), 1.2 * quantile_cont(v, 0.95)) + 0.05, 1) AS hi FROM k),
c AS (SELECT v, COUNT(*) AS w FROM k GROUP BY v)
SELECT point, {R('ANY_VALUE(lo + point * (hi - lo) / 299.0)')} AS x,
       {R('SUM(w * exp(-pow((v - (lo + point * (hi - lo) / 299.0)) / h, 2) / 2)) / ANY_VALUE(n * h * sqrt(2 * pi()))')} AS density
FROM c, l, generate_series(0, 299) AS g(point) GROUP BY point""", ("pct",))
def kde_bounded(spark, folder):
    return ops.kde_grid(pct(spark, folder), "pct", 300, bandwidth_scale=1.8, clip_unit=True)


# Prices take many values: divided between nodes, and again compared value by value.
fx.SQL["price_in"] = "SELECT l_extendedprice AS v FROM lineitem WHERE l_extendedprice IS NOT NULL"
fx.SQL["price_limits"] = "SELECT COUNT(*) AS n, STDDEV_SAMP(v) * pow(COUNT(*), -0.2) AS h, MIN(v) AS lo, LEAST(MAX(v), 1.2 * quantile_cont(v, 0.95)) AS hi FROM price_in"
KDE_TOLERANCE = 1e-4


# Densities of prices are small: given as a share of a kernel's peak.
@query("kde_binned", f"""
WITH g AS (SELECT *, sqrt(8 * {KDE_TOLERANCE}) * h AS gap FROM price_limits),
c AS (SELECT floor((v - lo) / gap) AS node, (v - lo) / gap - floor((v - lo) / gap) AS share, lo, gap FROM price_in, g),
b AS (SELECT lo + node * gap AS v, SUM(w) AS w FROM (SELECT node, 1 - share AS w, lo, gap FROM c UNION ALL SELECT node + 1, share, lo, gap FROM c) x GROUP BY node, lo, gap)
SELECT point, {R('ANY_VALUE(lo + point * (hi - lo) / 199.0)', 3)} AS x, {R('SUM(w * exp(-pow((v - (lo + point * (hi - lo) / 199.0)) / h, 2) / 2)) / ANY_VALUE(n)')} AS peak_share
FROM b, g, generate_series(0, 199) AS s(point) GROUP BY point""", ("price_in", "price_limits"))
def kde_binned(spark, folder):
    rows = fx.table(spark, folder, "lineitem").select("l_extendedprice")
    n, s = F.count("l_extendedprice").cast("double"), F.stddev_samp("l_extendedprice")
    peak = rows.agg(1 / (s * F.pow(n, F.lit(-0.2)) * F.sqrt(2 * F.pi()))).scalar()
    table = ops.kde_grid(rows, "l_extendedprice", tolerance=KDE_TOLERANCE)
    return table.select("point", (F.rint(F.col("x") * 1e3) / 1e3).alias("x"), (F.col("density") / peak).alias("peak_share"))


def _box(source, value, by=None):
    key = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
WITH q AS (SELECT *, quantile_cont({value}, 0.25) OVER ({part}) AS q1, quantile_cont({value}, 0.75) OVER ({part}) AS q3 FROM {source})
SELECT {key}'{value}' AS "column", CAST(COUNT(*) AS BIGINT) AS n, {R(f'AVG({value})')} AS mean, {R(f'STDDEV_SAMP({value})')} AS std, {R('ANY_VALUE(q1)')} AS q1,
  {R(f'quantile_cont({value}, 0.5)')} AS median, {R('ANY_VALUE(q3)')} AS q3, {R(f'MIN({value}) FILTER ({value} >= q1 - 1.5 * (q3 - q1))')} AS whisker_low,
  {R(f'MAX({value}) FILTER ({value} <= q3 + 1.5 * (q3 - q1))')} AS whisker_high, {R('ANY_VALUE(q3 - q1)')} AS iqr FROM q {f'GROUP BY {by}' if by else ''}"""


@query("box_summary", _box("box", "pts"), ("box",))
def box_summary(spark, folder):
    return ops.box_summary(fx.box(spark, folder), ["pts"])


@query("box_summary_by_side", _box("box", "pts", "home_away"), ("box",))
def box_summary_by_side(spark, folder):
    return ops.box_summary(fx.box(spark, folder), ["pts"], by="home_away")


@query("skew_notes", f"""WITH m AS ({MOMENTS}), s AS (SELECT variable, skew * sqrt(CAST(n AS DOUBLE) * (n - 1)) / (n - 2) AS g FROM m),
q AS (SELECT variable, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM item_long GROUP BY variable)
SELECT variable AS "column", {R('g')} AS skew, {R('iqr')} AS iqr, CASE WHEN ABS(g) < 0.5 THEN 'symmetric' WHEN ABS(g) < 1 THEN 'moderate' ELSE 'strong' END AS shape
FROM s JOIN q USING (variable)""", ("item", "item_long"))
def skew_notes(spark, folder):
    return ops.skew_notes(item(spark, folder), VARS)


# Maximum likelihood by Newton steps in recursive queries; digamma and trigamma by their series eight places on.
MLE_VARS = ("PTS", "REB", "STL", "FT_PCT")


def _psi(x, order=0):
    z = f"({x} + 8.0)"
    if order:
        return f"(1.0 / {z} + 0.5 / ({z} * {z}) + 1.0 / (6.0 * pow({z}, 3)) - 1.0 / (30.0 * pow({z}, 5)) + 1.0 / (42.0 * pow({z}, 7))" + "".join(f" + 1.0 / (({x} + {i}.0) * ({x} + {i}.0))" for i in range(8)) + ")"
    return f"(ln({z}) - 0.5 / {z} - 1.0 / (12.0 * {z} * {z}) + 1.0 / (120.0 * pow({z}, 4)) - 1.0 / (252.0 * pow({z}, 6))" + "".join(f" - 1.0 / ({x} + {i}.0)" for i in range(8)) + ")"


fx.SQL["mle_counts"] = " UNION ALL ".join(f"""SELECT '{v}' AS variable, CAST("{v}" AS DOUBLE) AS v, CAST(COUNT(*) AS DOUBLE) AS w FROM games WHERE "{v}" IS NOT NULL GROUP BY "{v}" """ for v in MLE_VARS)
fx.SQL["mle_stats"] = """SELECT variable, SUM(w) AS n, SUM(w * v) / SUM(w) AS mean, SUM(w * v * v) / SUM(w) - pow(SUM(w * v) / SUM(w), 2) AS var, MIN(v) AS low, MAX(v) AS high, bool_and(v = floor(v)) AS whole,
  SUM(w * CASE WHEN v > 0 THEN ln(v) END) / SUM(w) AS ml, SUM(w * CASE WHEN v < 1 THEN ln(1 - v) END) / SUM(w) AS mr FROM mle_counts GROUP BY variable"""
_GAMMA = f"""SELECT variable, 0 AS step, (3 - s + sqrt((s - 3) * (s - 3) + 24 * s)) / (12 * s) AS k, s FROM (SELECT variable, ln(mean) - ml AS s FROM mle_stats WHERE low > 0 AND low < high) q
  UNION ALL SELECT variable, step + 1, k - (ln(k) - {_psi('k')} - s) / (1 / k - {_psi('k', 1)}), s FROM gamma_steps WHERE step < 30"""
_BETA = f"""SELECT variable, 0 AS step, mean * (mean * (1 - mean) / var - 1) AS a, (1 - mean) * (mean * (1 - mean) / var - 1) AS b, ml, mr FROM mle_stats WHERE low > 0 AND high < 1 AND low < high
  UNION ALL SELECT variable, step + 1, a - (ga * (t - tb) - gb * t) / ((t - ta) * (t - tb) - t * t), b - (gb * (t - ta) - ga * t) / ((t - ta) * (t - tb) - t * t), ml, mr FROM (
    SELECT *, {_psi('(a + b)')} - {_psi('a')} + ml AS ga, {_psi('(a + b)')} - {_psi('b')} + mr AS gb, {_psi('(a + b)', 1)} AS t, {_psi('a', 1)} AS ta, {_psi('b', 1)} AS tb FROM beta_steps WHERE step < 30) q"""
_WEIBULL = """SELECT variable, 0 AS step, GREATEST(pow(sqrt(var) / mean, -1.086), 0.05) AS k FROM mle_stats WHERE low > 0 AND low < high
  UNION ALL SELECT variable, step + 1, k - (s1 / s0 - 1 / k - (ml - ln(high))) / (s2 / s0 - s1 * s1 / (s0 * s0) + 1 / (k * k)) FROM (
    SELECT variable, step, k, ANY_VALUE(ml) AS ml, ANY_VALUE(high) AS high, SUM(w * exp(k * ln(v / high))) AS s0, SUM(w * exp(k * ln(v / high)) * ln(v / high)) AS s1, SUM(w * exp(k * ln(v / high)) * ln(v / high) * ln(v / high)) AS s2
    FROM weibull_steps JOIN mle_stats USING (variable) JOIN mle_counts USING (variable) WHERE step < 30 GROUP BY variable, step, k) q"""
_NEGATIVE = f"""SELECT variable, 0 AS step, mean * mean / (var - mean) AS r FROM mle_stats WHERE whole AND low >= 0 AND low < high AND var > mean
  UNION ALL SELECT variable, step + 1, r - g / h FROM (
    SELECT variable, step, r, SUM(w * ({_psi('(v + r)')} - {_psi('r')})) / ANY_VALUE(n) + ln(r / (r + ANY_VALUE(mean))) AS g, SUM(w * ({_psi('(v + r)', 1)} - {_psi('r', 1)})) / ANY_VALUE(n) + 1 / r - 1 / (r + ANY_VALUE(mean)) AS h
    FROM negative_steps JOIN mle_stats USING (variable) JOIN mle_counts USING (variable) WHERE step < 30 GROUP BY variable, step, r) q"""


fx.SQL["mle_found"] = f"""WITH RECURSIVE gamma_steps AS ({_GAMMA}), beta_steps AS ({_BETA}), weibull_steps AS ({_WEIBULL}), negative_steps AS ({_NEGATIVE}),
f AS (SELECT variable, 'gamma' AS family, k AS a, mean / k AS b FROM gamma_steps JOIN mle_stats USING (variable) WHERE step = 30
  UNION ALL SELECT variable, 'beta', a, b FROM beta_steps WHERE step = 30
  UNION ALL SELECT variable, 'weibull', k, ANY_VALUE(high) * pow(SUM(w * exp(k * ln(v / high))) / ANY_VALUE(n), 1 / k) FROM weibull_steps JOIN mle_stats USING (variable) JOIN mle_counts USING (variable) WHERE step = 30 GROUP BY variable, k
  UNION ALL SELECT variable, 'negative_binomial', r, r / (r + mean) FROM negative_steps JOIN mle_stats USING (variable) WHERE step = 30)
SELECT variable, family, a, b, n FROM f JOIN mle_stats USING (variable)"""


@query("mle_fits", f"SELECT variable, family, {R('a', 4)} AS a, {R('b', 4)} AS b, true AS settled, CAST(n AS BIGINT) AS n FROM mle_found", ("games", "mle_counts", "mle_stats", "mle_found"))
def mle_fits_query(spark, folder):
    """Parameters to four places: the size of a nearly Poisson variable rests on differences of sums and is sure to some 1e-7 of itself."""
    found = mle_fits(fx.games(spark, folder), MLE_VARS)
    return found.select("variable", "family", *[(F.rint(F.col(c) * 1e4) / 1e4).alias(c) for c in "ab"], (F.col("gradient") < 1e-8).alias("settled"), "n")
