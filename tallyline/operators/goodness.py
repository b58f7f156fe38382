"""Goodness of fit, histograms, densities and box summaries, all from value counts."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dist import family_cdf, family_log_cdf, family_log_sf, ln_gamma, normal_score_sums, upper_normal_p, weibull_shape
from ..functions.exprs import unpivot
from ..functions.ordered import cumulative_counts, join_spread, quantiles_of_counts
from .cleaning import attempt_filter

# Anderson-Darling 5 % points for a normal and an exponential with fitted parameters.
AD_NORMAL_5PCT = 0.787
AD_EXPONENTIAL_5PCT = 1.341

# Mean and deviation of ln(1 - W') under normality, in u = ln n and v = ln u.
FRANCIA_MEAN = (-1.2725, 1.0521)
FRANCIA_DEVIATION = (1.0308, -0.26758)
FRANCIA_ROWS = 5


def _moments(long: DataFrame) -> DataFrame:
    v = F.col("value")
    log = F.when(v > 0, F.ln(v))
    return long.groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.var_samp(v).alias("var"),
        F.stddev_pop(v).alias("sigma"), F.skewness(v).alias("skewness"), F.kurtosis(v).alias("kurtosis"),
        F.min(v).alias("min"), F.max(v).alias("max"), F.avg(log).alias("log_mean"), F.stddev_pop(log).alias("log_sigma"),
        F.bool_and(v == F.floor(v)).alias("whole"))


def _candidates() -> Column:
    """Families whose support fits, with closed-form or moment parameters (a, b)."""
    m, v = F.col("mean"), F.col("var")
    low, high, whole = F.col("min"), F.col("max"), F.col("whole")
    shape = weibull_shape(F.try_divide(F.sqrt(v), m))
    scale = m / F.exp(ln_gamma(1.0 + F.try_divide(F.lit(1.0), shape)))
    spread = F.try_divide(m * (1 - m), v) - 1
    r = F.try_divide(m * m, v - m)

    def cand(name: str, ok: Column, a: Column, b: Column) -> Column:
        return F.when(ok, F.struct(F.lit(name).alias("family"), a.cast("double").alias("a"), b.cast("double").alias("b")))

    zero = F.lit(0.0)
    listed = F.array(
        cand("normal", F.col("sigma") > 0, m, F.col("sigma")),
        cand("lognormal", (low > 0) & (F.col("log_sigma") > 0), F.col("log_mean"), F.col("log_sigma")),
        cand("exponential", (low >= 0) & (m > 0), m, zero),
        cand("gamma", (low >= 0) & (v > 0) & (m > 0), F.try_divide(m * m, v), F.try_divide(v, m)),
        cand("beta", (low >= 0) & (high <= 1) & (spread > 0) & (m > 0), m * spread, (1 - m) * spread),
        cand("weibull", (low >= 0) & (v > 0) & (m > 0), shape, scale),
        cand("poisson", whole & (low >= 0) & (m > 0), m, zero),
        cand("nbinom", whole & (low >= 0) & (v > m) & (m > 0), r, F.try_divide(r, r + m)),
    )
    return F.filter(listed, lambda c: c.isNotNull())


def kolmogorov_p(d: Column, n: Column) -> Column:
    """Asymptotic P(D >= d)."""
    x = F.sqrt(n.cast("double")) * d
    tail = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(
        -2.0 * k * k * x * x))
    return F.when(x < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * tail)))


def fit_families(df: DataFrame, variables: Sequence[str], min_rows: int = 3) -> DataFrame:
    """(variable, family, a, b, n, ks, ks_p) for every candidate family.

    Each CDF is evaluated once per distinct value.  Parameters are closed-form or
    moment estimates, so gamma, beta, Weibull and negative binomial fits differ a
    little from iterative maximum likelihood.
    """
    long = unpivot(df, [], variables, "variable", "value").filter(F.col("value").isNotNull())
    fits = _moments(long).filter(F.col("n") >= min_rows).select("variable", F.explode(_candidates()).alias("f")).select(
        "variable", "f.family", "f.a", "f.b")
    counted = cumulative_counts(long, ["variable"], "value")
    cdf = counted.join(F.broadcast(fits), "variable").withColumn("cdf", family_cdf("family", "value", "a", "b"))
    n, up, w, c = F.col("n").cast("double"), F.col("upto").cast("double"), F.col("weight").cast("double"), F.col("cdf")
    before = up - w
    tested = cdf.groupBy("variable", "family", "a", "b").agg(
        F.max("n").alias("n"), F.max(F.greatest(c - before / n, up / n - c)).alias("ks"))
    return tested.select("variable", "family", "a", "b", "n", "ks", kolmogorov_p(F.col("ks"), F.col("n")).alias("ks_p"))


def anderson_darling(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """(variable, family, n, ad, ad_critical, rejected) for the normal and the exponential.

    The i-th smallest value enters with weight 2i-1; rows tied on a value share it,
    so a run of ranks a+1..b contributes b*b-a*a.  A value that the fitted family
    cannot take (0 for the exponential) makes the statistic infinite.
    """
    long = unpivot(df, [], variables, "variable", "value").filter(F.col("value").isNotNull())
    m = _moments(long)
    fits = m.select("variable", F.explode(F.filter(F.array(
        F.when(F.col("std") > 0, F.struct(F.lit("normal").alias("family"), F.col("mean").alias("a"), F.col("std").alias("b"))),
        F.when((F.col("min") >= 0) & (F.col("mean") > 0),
               F.struct(F.lit("exponential").alias("family"), F.col("mean").alias("a"), F.lit(0.0).alias("b"))),
    ), lambda c: c.isNotNull())).alias("f")).select("variable", "f.*")
    counted = cumulative_counts(long, ["variable"], "value")
    cdf = counted.join(F.broadcast(fits), "variable").withColumns({
        "below": family_log_cdf("family", "value", "a", "b"), "above": family_log_sf("family", "value", "a", "b")})
    n, up, w = F.col("n").cast("double"), F.col("upto").cast("double"), F.col("weight").cast("double")
    low = up * up - (up - w) * (up - w)
    terms = low * F.col("below") + (2 * n * w - low) * F.col("above")
    table = cdf.groupBy("variable", "family").agg(F.max("n").alias("n"), F.sum(terms).alias("_s"))
    k = F.col("n").cast("double")
    critical = F.when(F.col("family") == "normal", AD_NORMAL_5PCT / (1 + 4 / k - 25 / (k * k))).otherwise(
        AD_EXPONENTIAL_5PCT / (1 + 0.6 / k))
    return table.select("variable", "family", "n", (-k - F.col("_s") / k).alias("ad"), F.rint(critical * 1000).alias("_c")).select(
        "variable", "family", "n", "ad", (F.col("_c") / 1000).alias("ad_critical"), (F.col("ad") > F.col("_c") / 1000).alias("rejected"))


def goodness_table(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Moments, the family with the smallest KS distance, Jarque-Bera and a normal flag per variable."""
    long = unpivot(df, [], variables, "variable", "value").filter(F.col("value").isNotNull())
    fits = fit_families(df, variables)
    best = fits.groupBy("variable").agg(F.min_by(F.struct("family", "ks", "ks_p"), F.struct("ks", "family")).alias("b"))
    s, k, n = F.col("skewness"), F.col("kurtosis"), F.col("n")
    moments = _moments(long).filter(n >= 3).withColumn("jb", n / 6.0 * (s * s + k * k / 4.0)).withColumn("jb_p", F.exp(-F.col("jb") / 2.0))
    return moments.join(best, "variable", "left").select(
        "variable", "n", "mean", "std", "skewness", "kurtosis", F.coalesce("b.family", F.lit("Unknown")).alias("best_family"),
        F.col("b.ks").alias("ks"), F.col("b.ks_p").alias("ks_p"), "jb", "jb_p",
        F.coalesce(F.col("jb_p") > 0.05, F.lit(False)).alias("is_normal"))


def family_mix(table: DataFrame) -> DataFrame:
    """How many variables each family fits best, with shares and the share passing normality."""
    counts = table.groupBy("best_family").agg(F.count(F.lit(1)).alias("variables"), F.count_if("is_normal").alias("normal"))
    totals = counts.agg(F.struct(F.sum("variables").alias("v"), F.sum("normal").alias("k")).alias("t")).scalar()
    return counts.withColumn("_t", totals).select(
        "best_family", "variables", (F.col("variables") / F.col("_t.v") * 100.0).alias("share_pct"),
        (F.col("_t.k") / F.col("_t.v") * 100.0).alias("normal_pct"))


def normality_moments(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """n, skewness, kurtosis (population, excess) and Jarque-Bera per variable."""
    long = unpivot(df, [], variables, "variable", "value").filter(F.col("value").isNotNull())
    s, k, n = F.col("skewness"), F.col("kurtosis"), F.col("n")
    return _moments(long).select("variable", "n", "skewness", "kurtosis").withColumn(
        "jb", n / 6.0 * (s * s + k * k / 4.0)).withColumn("jb_p", F.exp(-F.col("jb") / 2.0))


def shapiro_francia(df: DataFrame, variables: Sequence[str], level: float = 0.05) -> DataFrame:
    """(variable, n, w, z, p, is_normal): the Shapiro-Francia test over all rows, not a first few thousand.

    W' is the squared correlation of the sorted values with normal scores at (i - 3/8) / (n + 1/4).  Rows tied on a value
    share a run of ranks, whose scores are summed in closed form, so the work follows the distinct values however many rows
    hold one.  `z` is ln(1 - W') standardised by fixed curves in n, which were fitted for 5 to 5,000 rows and are carried on
    beyond; `p` is its upper tail.  NULLs are left out; fewer than five rows or one distinct value give NULLs.
    """
    long = unpivot(df, [], variables, "variable", "value").filter(F.col("value").isNotNull())
    counted = cumulative_counts(long, ["variable"], "value")
    centre = long.groupBy("variable").agg(F.avg("value").alias("centre"))
    n = F.col("n").cast("double")
    placed = counted.join(F.broadcast(centre), "variable").select(
        "variable", "weight", "n", (F.col("value") - F.col("centre")).alias("off"), normal_score_sums(F.col("upto") - F.col("weight"), "upto", "n").alias("s"))
    off, weight = F.col("off"), F.col("weight")
    sums = placed.groupBy("variable").agg(
        F.max("n").alias("n"), F.count(F.lit(1)).alias("kinds"), F.sum(off * F.col("s.sum")).alias("xm"), F.sum(F.col("s.squares")).alias("mm"),
        F.sum(weight * off * off).alias("xx"), F.sum(weight * off).alias("x"))
    told = (n >= FRANCIA_ROWS) & (F.col("kinds") > 1)
    w = F.when(told, F.least(F.col("xm") * F.col("xm") / (F.col("mm") * (F.col("xx") - F.col("x") * F.col("x") / n)), F.lit(1.0)))
    u, v = F.ln(n), F.ln(F.ln(n))
    mean = FRANCIA_MEAN[0] + FRANCIA_MEAN[1] * (v - u)
    deviation = FRANCIA_DEVIATION[0] + FRANCIA_DEVIATION[1] * (v + 2 / u)
    z = F.when(F.col("w") < 1, (F.ln(1 - F.col("w")) - mean) / deviation).when(F.col("w") == 1, F.lit(float("-inf")))
    tested = sums.select("variable", "n", w.alias("w")).withColumn("z", z)
    p = F.when(F.col("z").isNotNull(), F.when(F.col("z") == float("-inf"), 1.0).otherwise(upper_normal_p("z")))
    return tested.withColumn("p", p).withColumn("is_normal", F.col("p") > level)


def histogram(df: DataFrame, column: str, *, discrete: bool = False, bins: int = 40, attempts: str | None = None,
              min_attempts: int = 0, percentage: bool = False) -> DataFrame:
    """bin, left, right, weight, density and the display limit min(max, 1.2*p95).

    Whole-number stats get one bin per number; percentages drop low-attempt and
    zero rows and weigh each row by its attempts.
    """
    rows = attempt_filter(df, column, attempts, min_attempts) if percentage else df
    weight = F.col(attempts) if percentage and attempts else F.lit(1)
    rows = rows.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"), weight.cast("double").alias("w"))
    spread = quantiles_of_counts(cumulative_counts(rows, [], "v"), [], "v", {"p95": 0.95})
    limits = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("w").alias("total"))
    lo, hi = F.col("lo"), F.col("hi")
    start = F.when(lo < 0, F.ceil(lo)).otherwise(F.floor(lo)).cast("double") if discrete else F.when(lo == hi, lo - 0.5).otherwise(lo)
    stop = F.when(hi < 0, F.ceil(hi)).otherwise(F.floor(hi)).cast("double") + 1 if discrete else F.when(lo == hi, hi + 0.5).otherwise(hi)
    n_bins = (stop - start) if discrete else F.lit(float(bins))
    width = F.lit(1.0) if discrete else (stop - start) / float(bins)
    frame = limits.filter("lo IS NOT NULL").select(start.alias("start"), width.alias("width"), n_bins.alias("n_bins"), "total", "hi")
    number = F.least(F.floor((F.col("v") - F.col("_f.start")) / F.col("_f.width")), F.col("_f.n_bins") - 1).cast("int")
    small = rows.groupBy("v").agg(F.sum("w").alias("w")).withColumn("_f", frame.select(F.struct("start", "width", "n_bins")).scalar())
    sums = small.filter(F.col("v") >= F.col("_f.start")).select(number.alias("bin"), "w").groupBy("bin").agg(F.sum("w").alias("weight"))
    # Every bin has a row, also one that nothing falls into.
    table = frame.select(F.explode(F.sequence(F.lit(0), F.col("n_bins").cast("int") - 1)).alias("bin"), "start", "width", "total", "hi").join(
        sums, "bin", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    return table.select("bin", (F.col("start") + F.col("bin") * F.col("width")).alias("left"),
                        (F.col("start") + (F.col("bin") + 1) * F.col("width")).alias("right"), "weight",
                        (F.col("weight") / F.col("total") / F.col("width")).alias("density"),
                        F.least(F.col("hi"), spread.scalar() * 1.2).alias("x_max"))


def _linear_nodes(counts: DataFrame, gap: Column, start: Column) -> DataFrame:
    """Weights `w` of values `v` divided between the two nodes around each, `gap` apart from `start`; other columns are constant."""
    place = (F.col("v") - start) / gap
    node = F.floor(place)
    share = place - node
    rest = [c for c in counts.columns if c not in ("v", "w")]
    halves = F.array(F.struct(node.alias("node"), (F.col("w") * (1 - share)).alias("w")), F.struct((node + 1).alias("node"), (F.col("w") * share).alias("w")))
    split = counts.select(*rest, F.explode(halves).alias("_h")).filter("_h.w > 0")
    return split.groupBy(F.col("_h.node").alias("_node")).agg(F.sum("_h.w").alias("w"), *[F.first(c).alias(c) for c in rest]).withColumn("v", start + F.col("_node") * gap)


def kde_grid(df: DataFrame, column: str, points: int = 200, *, bandwidth_scale: float = 1.0, clip_unit: bool = False,
             tolerance: float | None = None) -> DataFrame:
    """Gaussian kernel density with Scott's bandwidth at evenly spaced points up to min(max, 1.2*p95).

    Every distinct value adds its weighted kernel to all grid points; the sums per
    point combine inside each task, so only `points` rows per task are shuffled.

    With a `tolerance` the values are binned linearly first: a value between two nodes is divided between them by
    nearness.  Nodes lie sqrt(8 * tolerance) bandwidths apart, which keeps every density within
    tolerance / (sqrt(2 pi) * bandwidth), that share of a kernel's peak, of the exact one.  Only nodes that hold something
    add to the points, so the cost beyond one pass over the rows no longer follows the distinct values.
    """
    rows = df.filter(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    if clip_unit:
        rows = rows.filter(F.col("v") > 0)
    p95 = quantiles_of_counts(cumulative_counts(rows, [], "v"), [], "v", {"p95": 0.95}).scalar()
    limits = rows.agg(F.struct(F.count(F.lit(1)).cast("double").alias("n"), F.stddev_samp("v").alias("s"), F.min("v").alias("lo"),
                               F.max("v").alias("hi")).alias("l")).scalar()
    counts = rows.groupBy("v").agg(F.count(F.lit(1)).alias("w")).withColumns({"_l": limits, "_p": p95})
    n, s = F.col("_l.n"), F.col("_l.s")
    h = s * F.pow(n, F.lit(-0.2)) * bandwidth_scale
    top = F.least(F.col("_l.hi"), F.col("_p") * 1.2)
    left, right = F.col("_l.lo"), top
    if clip_unit:
        left, right = F.greatest(left - 0.05, F.lit(0.0)), F.least(top + 0.05, F.lit(1.0))
    grid = F.sequence(F.lit(0), F.lit(points - 1))
    if tolerance is not None:
        counts = _linear_nodes(counts.filter(h > 0), h * math.sqrt(8 * tolerance), F.col("_l.lo"))
    spread = counts.select("v", "w", n.alias("n"), h.alias("h"), left.alias("l"), right.alias("r"), F.explode(grid).alias("point"))
    x = F.col("l") + F.col("point") * (F.col("r") - F.col("l")) / float(points - 1)
    z = (F.col("v") - x) / F.col("h")
    norm = F.col("n") * F.col("h") * F.sqrt(2 * F.pi())
    return spread.filter(F.col("h") > 0).groupBy("point").agg(
        F.first(x).alias("x"), F.sum(F.col("w") * F.exp(-z * z / 2) / norm).alias("density"))


def box_summary(df: DataFrame, columns: Sequence[str], by: str | None = None) -> DataFrame:
    """n, mean, std, quartiles, iqr and whiskers (furthest values within 1.5 iqr) per column and group."""
    ids = [by] if by else []
    keys = [*ids, "column"]
    long = unpivot(df, ids, columns, "column", "value").filter(F.col("value").isNotNull())
    if by:
        long = long.filter(F.col(by).isNotNull())
    sums = long.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    counted = cumulative_counts(long, keys, "value")
    spread = quantiles_of_counts(counted, keys, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75})
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    whiskers = join_spread(counted.select(*keys, "value"), spread, keys).groupBy(*keys).agg(
        F.min(F.when(F.col("value") >= F.col("q1") - reach, F.col("value"))).alias("whisker_low"),
        F.max(F.when(F.col("value") <= F.col("q3") + reach, F.col("value"))).alias("whisker_high"))
    return sums.join(spread, keys).join(whiskers, keys).withColumn("iqr", F.col("q3") - F.col("q1"))


def skew_notes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Bias-corrected skewness, iqr and a class: symmetric under .5, moderate under 1, else strong."""
    long = unpivot(df, [], columns, "column", "value").filter(F.col("value").isNotNull())
    n = F.count(F.lit(1)).cast("double")
    skew = long.groupBy("column").agg(
        (F.skewness("value") * F.try_divide(F.sqrt(n * (n - 1)), n - 2)).alias("skew"))
    spread = quantiles_of_counts(cumulative_counts(long, ["column"], "value"), ["column"], "value", {"q1": 0.25, "q3": 0.75})
    size = F.abs("skew")
    return skew.join(spread, "column").select(
        "column", "skew", (F.col("q3") - F.col("q1")).alias("iqr"),
        F.when(size < 0.5, "symmetric").when(size < 1, "moderate").otherwise("strong").alias("shape"))
