"""Maximum-likelihood fits of gamma, beta, Weibull and negative binomial distributions.

Gamma and beta depend on the data through a few means alone, which one aggregate gives; their equations are solved on those.
The Weibull shape and the negative binomial size take one grouped sum over value counts a Newton step, for all variables
together.  Only one row per variable and family reaches the driver.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import unpivot
from ..functions.ordered import value_counts
from ..session import stored
from .neighbours import digamma


def trigamma(n: Column) -> Column:
    """The derivative of `digamma`, for numbers above 0."""
    z = n + 8.0
    series = 1.0 / z + 0.5 / (z * z) + 1.0 / (6.0 * F.pow(z, F.lit(3.0))) - 1.0 / (30.0 * F.pow(z, F.lit(5.0))) + 1.0 / (42.0 * F.pow(z, F.lit(7.0)))
    for i in range(8):
        series = series + 1.0 / ((n + float(i)) * (n + float(i)))
    return series


def _psi(x: float) -> float:
    z = x + 10.0
    return math.log(z) - 0.5 / z - 1 / (12 * z**2) + 1 / (120 * z**4) - 1 / (252 * z**6) - math.fsum(1 / (x + i) for i in range(10))


def _psi1(x: float) -> float:
    z = x + 10.0
    return 1 / z + 0.5 / z**2 + 1 / (6 * z**3) - 1 / (30 * z**5) + 1 / (42 * z**7) + math.fsum(1 / (x + i)**2 for i in range(10))


def gamma_fit(mean: float, log_mean: float, steps: int = 200) -> tuple[float, float, float]:
    """(shape, scale, gradient) from the mean and the mean logarithm."""
    s = math.log(mean) - log_mean
    k = (3 - s + math.sqrt((s - 3) ** 2 + 24 * s)) / (12 * s)
    for _ in range(steps):
        g = math.log(k) - _psi(k) - s
        if abs(g) < 1e-12:
            break
        step = g / (1 / k - _psi1(k))
        k = k - step if step < k else k / 2
    return k, mean / k, abs(math.log(k) - _psi(k) - s)


def beta_fit(mean: float, var: float, log_mean: float, log_rest: float, steps: int = 200) -> tuple[float, float, float]:
    """(a, b, gradient) from the mean and variance to start with, and the mean logarithms of x and 1 - x."""
    spread = max(mean * (1 - mean) / var - 1, 0.1)
    a, b = mean * spread, (1 - mean) * spread

    def gradient(a: float, b: float) -> tuple[float, float]:
        return _psi(a + b) - _psi(a) + log_mean, _psi(a + b) - _psi(b) + log_rest

    for _ in range(steps):
        ga, gb = gradient(a, b)
        if max(abs(ga), abs(gb)) < 1e-12:
            break
        both = _psi1(a + b)
        haa, hbb = both - _psi1(a), both - _psi1(b)
        det = haa * hbb - both * both
        da, db = (ga * hbb - gb * both) / det, (gb * haa - ga * both) / det
        a, b = a - da if da < a else a / 2, b - db if db < b else b / 2
    return a, b, max(map(abs, gradient(a, b)))


def mle_fits(df: DataFrame, variables: Sequence[str], *, tolerance: float = 1e-9, steps: int = 200) -> DataFrame:
    """(variable, family, a, b, gradient, n): the likeliest parameters of every family whose support holds the known values.

    gamma (shape, scale) and weibull (shape, scale) take positive values, beta (a, b) values between 0 and 1, negative_binomial
    (size, probability) whole numbers from 0 on whose variance exceeds their mean.  A constant variable has no fit.
    `gradient` is that of the mean log-likelihood at the result; a fit that does not come below `tolerance` raises.
    """
    spark = df.sparkSession
    counts = stored(value_counts(unpivot(df, [], variables, "variable", "value"), ["variable"], "value"))
    v, w = F.col("value"), F.col("weight")
    n = F.sum(w)
    log, rest = F.when(v > 0, F.ln(v)), F.when(v < 1, F.ln(1 - v))
    stats = counts.groupBy("variable").agg(
        n.alias("n"), (F.sum(w * v) / n).alias("mean"), (F.sum(w * v * v) / n).alias("square"), F.min(v).alias("low"), F.max(v).alias("high"),
        F.bool_and(v == F.floor(v)).alias("whole"), (F.sum(w * log) / n).alias("log_mean"), (F.sum(w * rest) / n).alias("log_rest")).collect()
    out, open_fits = [], {}
    for r in stats:
        if r["low"] == r["high"]:
            continue
        var = r["square"] - r["mean"] ** 2
        if r["low"] > 0:
            out.append((r["variable"], "gamma", *gamma_fit(r["mean"], r["log_mean"]), r["n"]))
            open_fits[r["variable"], "weibull"] = [max((math.sqrt(var) / r["mean"]) ** -1.086, 0.05), r, None, False]
        if 0 < r["low"] and r["high"] < 1:
            out.append((r["variable"], "beta", *beta_fit(r["mean"], var, r["log_mean"], r["log_rest"]), r["n"]))
        if r["whole"] and r["low"] >= 0 and var > r["mean"]:
            open_fits[r["variable"], "negative_binomial"] = [r["mean"] ** 2 / (var - r["mean"]), r, None, False]
    # Powers are of value / highest value, so that no sum overflows.
    u, k = F.ln(v) - F.ln("high"), F.col("at")
    power = w * F.exp(k * u)
    weibull = F.col("family") == "weibull"
    for _ in range(steps):
        now = [(var, family, f[0], float(f[1]["high"])) for (var, family), f in open_fits.items() if f[2] is None]
        if not now:
            break
        at = spark.createDataFrame(now, "variable string, family string, at double, high double")
        sums = counts.join(F.broadcast(at), "variable").groupBy("variable", "family").agg(  # two rows per variable
            F.sum(F.when(weibull, power)).alias("s0"), F.sum(F.when(weibull, power * u)).alias("s1"), F.sum(F.when(weibull, power * u * u)).alias("s2"),
            F.sum(F.when(~weibull, w * (digamma(v + k) - digamma(k)))).alias("d1"), F.sum(F.when(~weibull, w * (trigamma(v + k) - trigamma(k)))).alias("d2"))
        for r in sums.collect():
            f = open_fits[r["variable"], r["family"]]
            x, of = f[0], f[1]
            if r["family"] == "weibull":
                ratio = r["s1"] / r["s0"]
                g, h = ratio - 1 / x - (of["log_mean"] - math.log(of["high"])), r["s2"] / r["s0"] - ratio**2 + 1 / x**2
                scale = of["high"] * (r["s0"] / of["n"]) ** (1 / x)
                b = scale
            else:
                g, h = r["d1"] / of["n"] + math.log(x / (x + of["mean"])), r["d2"] / of["n"] + 1 / x - 1 / (x + of["mean"])
                b = x / (x + of["mean"])
            if abs(g) < tolerance and (abs(g / h) < 1e-10 * x or f[3]):
                f[2] = (x, b, abs(g))
            else:
                f[3] = abs(g) < tolerance  # one more step: a small gradient may still be some way off
                step = g / h
                f[0] = x - step if x / 4 < x - step < 4 * x else (x / 2 if step > 0 else x * 2)
    unfinished = [name for name, f in open_fits.items() if f[2] is None]
    if unfinished or any(row[4] > 1e-8 for row in out):
        raise ArithmeticError(f"fits did not converge: {unfinished or [r[:2] for r in out if r[4] > 1e-8]}")
    out += [(var, family, *f[2], f[1]["n"]) for (var, family), f in open_fits.items()]
    return spark.createDataFrame([(*r[:2], *map(float, r[2:5]), int(r[5])) for r in out], "variable string, family string, a double, b double, gradient double, n bigint")
