"""Distribution functions on Arrow batches, in logarithms, at any size of parameters.

Both tails are computed apart: the smaller one directly, the other from it, so that neither loses its digits.  Sums and
continued fractions run until they have converged; one that does not raises an error.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F, types as T

# The Arrow functions below travel with the task, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_EPS = 1e-16
_STEPS = 100_000_000  # beyond any sum that converges; reaching it is an error
_HALF_LOG_2PI = 0.5 * math.log(2 * math.pi)


def stirling_rest(x: np.ndarray) -> np.ndarray:
    """ln gamma(x) minus Stirling's formula (x - 1/2) ln x - x + ln(2 pi) / 2, for x > 0."""
    x = np.asarray(x, float)
    shift, z = np.zeros_like(x), x.copy()
    with np.errstate(all="ignore"):
        while (small := z < 12).any():
            shift[small] += np.log(z[small])
            z[small] += 1
        w = 1 / (z * z)
        rest = (1 / 12 - w * (1 / 360 - w * (1 / 1260 - w * (1 / 1680 - w * (1 / 1188 - w * 691 / 360360))))) / z
        moved = z != x
        if moved.any():
            # ln gamma(x) = ln gamma(z) - shift
            zm, xm = z[moved], x[moved]
            rest[moved] += (zm - 0.5) * np.log(zm) - zm - shift[moved] - ((xm - 0.5) * np.log(xm) - xm)
    return rest


def deviance(k: np.ndarray, mean: np.ndarray) -> np.ndarray:
    """k ln(k / mean) + mean - k, without the loss of digits when k is close to the mean; k and mean >= 0."""
    k, mean = np.broadcast_arrays(np.asarray(k, float), np.asarray(mean, float))
    with np.errstate(all="ignore"):
        out = np.where(k > 0, k * np.log(k / mean) + mean - k, mean)
        d = k - mean
        v = d / (k + mean)
        near = np.abs(v) < 0.1
        if near.any():
            v, s = v[near], d[near] * v[near]
            term, j = 2 * k[near] * v, 1
            while True:
                term = term * v * v
                more = s + term / (2 * j + 1)
                if np.array_equal(more, s):
                    break
                s, j = more, j + 1
            out[near] = s
    return out


def _run(step, state: dict[str, np.ndarray], n: int) -> np.ndarray:
    """Iterate on the elements that have not converged; `step(i, state)` says which have.  Returns state["out"]."""
    out, open_ = np.empty(n), np.arange(n)
    for i in range(1, _STEPS):
        done = step(i, state)
        if done.any():
            out[open_[done]] = state["out"][done]
            open_ = open_[~done]
            if not len(open_):
                return out
            for key in state:
                state[key] = state[key][~done]
    raise ArithmeticError("a distribution function did not converge")


def _series(i: int, s: dict[str, np.ndarray]) -> np.ndarray:
    s["term"] = s["term"] * s["x"] / (s["a"] + i)
    s["out"] = s["out"] + s["term"]
    return s["term"] <= _EPS * s["out"]


def _fraction(i: int, s: dict[str, np.ndarray]) -> np.ndarray:
    coef = -i * (i - s["a"])
    s["b"] = s["b"] + 2
    s["d"] = 1 / (coef * s["d"] + s["b"])
    s["c"] = s["b"] + coef / s["c"]
    ratio = s["c"] * s["d"]
    s["out"] = s["out"] * ratio
    return np.abs(ratio - 1) <= 4 * _EPS


def log_gamma_tails(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the regularised lower and upper incomplete gamma functions, a > 0."""
    lower, upper = np.full(len(x), -np.inf), np.zeros(len(x))
    kinds, at = np.unique(a, return_inverse=True)
    rest = stirling_rest(kinds)[at]
    with np.errstate(all="ignore"):
        scale = 0.5 * np.log(a) - _HALF_LOG_2PI - rest - deviance(a, x)
        low = (x > 0) & (x < a + 1)
        if low.any():
            first = 1 / a[low]
            total = _run(_series, {"term": first, "out": first.copy(), "x": x[low], "a": a[low]}, int(low.sum()))
            lower[low] = np.minimum(np.log(total) + scale[low], 0.0)
            upper[low] = np.log1p(-np.exp(lower[low]))
        far = (x >= a + 1) & np.isfinite(x)
        if far.any():
            b = x[far] + 1 - a[far]
            state = {"a": a[far], "b": b, "c": np.full(len(b), 1e300), "d": 1 / b, "out": 1 / b}
            upper[far] = np.minimum(np.log(_run(_fraction, state, int(far.sum()))) + scale[far], 0.0)
            lower[far] = np.log1p(-np.exp(upper[far]))
        lower[np.isposinf(x)], upper[np.isposinf(x)] = 0.0, -np.inf
    lower[np.isnan(x) | np.isnan(a)] = upper[np.isnan(x) | np.isnan(a)] = np.nan
    return lower, upper


def _beta_series(i: int, s: dict[str, np.ndarray]) -> np.ndarray:
    s["term"] = s["term"] * s["x"] * (s["n"] + i - 1) / (s["a"] + i)
    s["out"] = s["out"] + s["term"]
    return (s["term"] <= _EPS * s["out"]) & (s["x"] * (s["n"] + i) < s["a"] + i + 1)


def _beta_fraction(m: int, s: dict[str, np.ndarray]) -> np.ndarray:
    a, b, x = s["a"], s["b"], s["x"]
    even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
    d = 1 / (1 + even * s["d"])
    c = 1 + even / s["c"]
    first = c * d
    odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
    s["d"] = 1 / (1 + odd * d)
    s["c"] = 1 + odd / c
    s["out"] = s["out"] * first * s["c"] * s["d"]
    return np.abs(first * s["c"] * s["d"] - 1) <= 8 * _EPS


def _log_beta_lower(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """ln of the regularised incomplete beta function on the side where it is the smaller tail; y = 1 - x."""
    n = a + b
    front = 0.5 * (np.log(a) + np.log(b) - np.log(n)) - _HALF_LOG_2PI - stirling_rest(a) - stirling_rest(b) + stirling_rest(n) - deviance(a, n * x) - deviance(b, n * y)
    value = np.empty(len(x))
    short = n * x < 2_000  # the positive series has about n x terms, the fraction about the root of the larger parameter
    if short.any():
        first = np.ones(int(short.sum()))
        value[short] = _run(_beta_series, {"term": first, "out": first.copy(), "x": x[short], "a": a[short], "n": n[short]}, len(first))
    if (~short).any():
        af, bf, xf = a[~short], b[~short], x[~short]
        d = 1 / (1 - (af + bf) * xf / (af + 1))
        value[~short] = _run(_beta_fraction, {"a": af, "b": bf, "x": xf, "c": np.ones(len(af)), "d": d, "out": d.copy()}, len(af))
    return np.minimum(np.log(value) + front - np.log(a), 0.0)


def log_beta_tails(a: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ln of the regularised incomplete beta function and of its complement; y = 1 - x where it is known better."""
    y = 1 - x if y is None else y
    lower, upper = np.where(x >= 1, 0.0, -np.inf), np.where(x >= 1, -np.inf, 0.0)
    inside = (x > 0) & (y > 0) & (x < 1)
    with np.errstate(all="ignore"):
        direct = inside & (x < (a + 1) / (a + b + 2))
        swapped = inside & ~direct
        if direct.any():
            lower[direct] = _log_beta_lower(a[direct], b[direct], x[direct], y[direct])
            upper[direct] = np.log1p(-np.exp(lower[direct]))
        if swapped.any():
            upper[swapped] = _log_beta_lower(b[swapped], a[swapped], y[swapped], x[swapped])
            lower[swapped] = np.log1p(-np.exp(upper[swapped]))
    missing = np.isnan(x) | np.isnan(a) | np.isnan(b)
    lower[missing] = upper[missing] = np.nan
    return lower, upper


def log_normal_tails(z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln P(Z <= z) and ln P(Z > z)."""
    inner, outer = log_gamma_tails(np.full(len(z), 0.5), z * z / 2)
    small = outer - math.log(2)
    with np.errstate(all="ignore"):
        large = np.log1p(np.exp(inner)) - math.log(2)
    return np.where(z < 0, small, large), np.where(z < 0, large, small)


def log_tails(family: str, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ln P(X <= x), ln P(X > x)) of a named family with parameters a, b; outside the support minus infinity and zero."""
    with np.errstate(all="ignore"):
        if family == "normal":
            return log_normal_tails((x - a) / b)
        if family == "lognormal":
            low, high = log_normal_tails((np.log(np.maximum(x, 0)) - a) / b)
            return np.where(x > 0, low, -np.inf), np.where(x > 0, high, 0.0)
        if family in ("exponential", "weibull"):
            hazard = np.maximum(x, 0) / a if family == "exponential" else np.power(np.maximum(x, 0) / b, a)
            return np.log(-np.expm1(-hazard)), -hazard
        if family == "gamma":
            return log_gamma_tails(a, np.maximum(x, 0) / b)
        if family == "beta":
            return log_beta_tails(a, b, x)
        k = np.floor(x)
        if family == "poisson":
            high, low = log_gamma_tails(np.maximum(k, 0) + 1, a)
        elif family == "nbinom":
            low, high = log_beta_tails(a, np.maximum(k, 0) + 1, b)
        else:
            raise ValueError(f"unknown family {family!r}")
        return np.where(k < 0, -np.inf, low), np.where(k < 0, 0.0, high)


def _by_family(side: int, exponent: bool):
    def value(family: pd.Series, x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        out = pd.Series(np.nan, index=x.index)
        for name, rows in family.groupby(family).groups.items():
            if name == "degenerate":  # no distribution to ask
                continue
            got = log_tails(name, *(s[rows].to_numpy(dtype=float) for s in (x, a, b)))[side]
            out[rows] = np.exp(got) if exponent else got
        return out
    return value


def _udf(side: int, exponent: bool, name: str, doc: str):
    made = _by_family(side, exponent)

    def function(family: pd.Series, x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return made(family, x, a, b)

    function.__name__, function.__doc__ = name, doc
    return F.pandas_udf(function, T.DoubleType())


# Used on distinct values only.
family_cdf = _udf(0, True, "family_cdf", "P(X <= x) of a named family.")
family_sf = _udf(1, True, "family_sf", "P(X > x) of a named family.")
family_log_cdf = _udf(0, False, "family_log_cdf", "ln P(X <= x) of a named family.")
family_log_sf = _udf(1, False, "family_log_sf", "ln P(X > x) of a named family.")


def _ln_gamma(x: np.ndarray) -> np.ndarray:
    return (x - 0.5) * np.log(x) - x + _HALF_LOG_2PI + stirling_rest(x)


@F.pandas_udf(T.DoubleType())
def ln_gamma(x: pd.Series) -> pd.Series:
    """ln gamma(x) for x > 0; used on summary rows only."""
    values = x.to_numpy(dtype=float)
    out = np.full(len(values), np.nan)
    out[values > 0] = _ln_gamma(values[values > 0])
    return pd.Series(out, index=x.index)


@F.pandas_udf(T.DoubleType())
def weibull_shape(cv: pd.Series) -> pd.Series:
    """The shape whose Weibull distribution has a coefficient of variation, by bisection on its logarithm; summary rows only."""
    values = cv.to_numpy(dtype=float)
    ok = values > 0
    target = np.log1p(values[ok] ** 2)
    low, high = np.full(len(target), math.log(1e-3)), np.full(len(target), math.log(1e9))
    for _ in range(200):
        middle = (low + high) / 2
        shape = np.exp(middle)
        wide = _ln_gamma(1 + 2 / shape) - 2 * _ln_gamma(1 + 1 / shape) > target
        low, high = np.where(wide, middle, low), np.where(wide, high, middle)
    out = np.full(len(values), np.nan)
    out[ok] = np.exp((low + high) / 2)
    return pd.Series(out, index=cv.index)


@F.pandas_udf(T.DoubleType())
def correlation_p(r: pd.Series, n: pd.Series) -> pd.Series:
    """Two-sided p-value of a correlation r over n pairs by Student's t; used on summary rows only."""
    r2 = r.to_numpy(dtype=float) ** 2
    half = (n.to_numpy(dtype=float) - 2) / 2
    ok = (half > 0) & ~np.isnan(r2)
    out = np.full(len(r2), np.nan)
    if ok.any():
        with np.errstate(all="ignore"):
            out[ok] = np.exp(log_beta_tails(half[ok], np.full(int(ok.sum()), 0.5), 1 - np.minimum(r2[ok], 1.0), np.minimum(r2[ok], 1.0))[0])
    return pd.Series(out, index=r.index)


@F.pandas_udf(T.DoubleType())
def two_sided_normal_p(z: pd.Series) -> pd.Series:
    """P(|Z| >= |z|) for a standard normal; used on summary rows only."""
    size = np.abs(z.to_numpy(dtype=float))
    return pd.Series(2 * np.exp(log_normal_tails(size)[1]), index=z.index)


def normal_quantile(p: np.ndarray) -> np.ndarray:
    """z with P(Z <= z) = p, for 0 < p < 1, by Newton steps on ln P(Z <= z) of the smaller tail.

    The logarithm is concave and the start lies below the root, so the steps climb to it and never pass it.
    """
    tail = np.minimum(p, 1 - p)
    goal = np.log(tail)
    z = -np.sqrt(np.maximum(-2 * (goal + math.log(2)), 0.0))
    while True:
        low = log_normal_tails(z)[0]
        step = (goal - low) * np.exp(low + z * z / 2 + _HALF_LOG_2PI)
        z = np.minimum(z + step, 0.0)
        if not (np.abs(step) > 1e-9).any():  # the steps square the error
            return np.where(p > 0.5, -z, z)


# Ranks from either end whose scores are summed one by one; between them the Euler-Maclaurin formula is good to the last digits.
_END_RANKS = 64


def _score_prefixes(j: np.ndarray, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Sums of the first j of n normal scores and of their squares, for whole 0 <= j <= n / 2; scores are at (i - 3/8) / (n + 1/4)."""
    size = n + 0.25
    first = int(min(_END_RANKS, n // 2))
    ends = normal_quantile((np.arange(1, first + 1) - 0.375) / size) if first else np.zeros(0)
    sums, squares = (np.concatenate(([0.0], np.cumsum(e))) for e in (ends, ends * ends))

    def between(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Antiderivatives at i + 1/2 less a 24th of the slopes there, and the next term of the formula."""
        p = (i + 0.125) / size
        z = normal_quantile(p)
        d = np.exp(-z * z / 2 - _HALF_LOG_2PI)
        up = 1 / (size * d)
        third, third2 = (1 + 2 * z * z) * up ** 3, (8 * z + 4 * z ** 3) * up ** 3
        return -size * d - up / 24 + 7 * third / 5760, size * (p - z * d) - 2 * z * up / 24 + 7 * third2 / 5760

    low, far = np.minimum(j, first).astype(int), j > first
    a, b = sums[low], squares[low]
    if far.any():
        base, at = between(np.array([float(first)])), between(j[far])
        a[far] += at[0] - base[0]
        b[far] += at[1] - base[1]
    return a, b


@F.pandas_udf(T.StructType([T.StructField("sum", T.DoubleType()), T.StructField("squares", T.DoubleType())]))
def normal_score_sums(above: pd.Series, upto: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Sums of the normal scores of the ranks above + 1 .. upto among n, and of their squares, at the same cost for any number of ranks."""
    out = np.zeros((2, len(n)))
    for size, at in n.groupby(n).indices.items():
        size = float(size)
        half = size // 2
        whole = 2 * _score_prefixes(np.array([half]), size)[1]
        sums = []
        for rank in (above.to_numpy(dtype=float)[at], upto.to_numpy(dtype=float)[at]):
            # Scores are odd about the middle, so what lies beyond it follows from the other end.
            a, b = _score_prefixes(np.minimum(rank, size - rank), size)
            sums.append((a, np.where(rank > half, whole - b, b)))
        out[:, at] = sums[1][0] - sums[0][0], sums[1][1] - sums[0][1]
    return pd.DataFrame({"sum": out[0], "squares": out[1]})


@F.pandas_udf(T.DoubleType())
def upper_normal_p(z: pd.Series) -> pd.Series:
    """P(Z >= z) for a standard normal; used on summary rows only."""
    known = z.to_numpy(dtype=float)
    out = np.full(len(known), np.nan)
    ok = ~np.isnan(known)
    out[ok] = np.exp(log_normal_tails(known[ok])[1])
    return pd.Series(out, index=z.index)
