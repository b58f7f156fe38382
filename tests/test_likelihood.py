"""Maximum-likelihood fits against a search over the log-likelihood itself."""

import math

import numpy as np
import pytest

from tallyline.operators.likelihood import mle_fits

LG = math.lgamma


def loglik(family, x, a, b):
    if a <= 0 or b <= 0 or (family == "negative_binomial" and b >= 1):
        return -math.inf
    if family == "gamma":
        return float(np.mean((a - 1) * np.log(x) - x / b)) - LG(a) - a * math.log(b)
    if family == "weibull":
        return float(np.mean((a - 1) * np.log(x) - (x / b) ** a)) + math.log(a) - a * math.log(b)
    if family == "beta":
        return float(np.mean((a - 1) * np.log(x) + (b - 1) * np.log1p(-x))) + LG(a + b) - LG(a) - LG(b)
    return float(np.mean([LG(v + a) - LG(v + 1) for v in x])) - LG(a) + a * math.log(b) + float(x.mean()) * math.log(1 - b)


def test_no_better_parameters_nearby(spark):
    rng = np.random.default_rng(5)
    n = 400
    columns = {"g": rng.gamma(2.5, 3.0, n), "w": rng.weibull(0.7, n) * 4 + 1e-9, "b": rng.beta(0.6, 2.0, n).clip(1e-6, 1 - 1e-6),
               "nb": rng.negative_binomial(2, 0.2, n).astype(float), "one": np.full(n, 4.0), "signed": rng.normal(size=n)}
    frame = spark.createDataFrame([tuple(float(c[i]) for c in columns.values()) for i in range(n)], ", ".join(f"{c} double" for c in columns))
    got = {(r["variable"], r["family"]): r for r in mle_fits(frame, list(columns)).collect()}
    assert {k[0] for k in got} == {"g", "w", "b", "nb"} and {f for v, f in got if v == "b"} == {"gamma", "weibull", "beta"}
    assert ("nb", "negative_binomial") in got and ("g", "beta") not in got
    for (variable, family), r in got.items():
        x, best = columns[variable], loglik(family, columns[variable], r["a"], r["b"])
        assert r["gradient"] < 1e-8 and r["n"] == n
        for fa in (0.98, 1.0, 1.02):
            for fb in (0.98, 1.0, 1.02):
                assert loglik(family, x, r["a"] * fa, r["b"] * fb) <= best + 1e-9, (variable, family)


def test_nothing_to_fit(spark):
    assert mle_fits(spark.createDataFrame([(1.0,), (None,)], "x double"), ["x"]).count() == 0


def test_missing_values_are_left_out(spark):
    rows = [(v,) for v in (1.0, 2.0, None, 4.0, 7.0)]
    with_null, without = (mle_fits(spark.createDataFrame(r, "x double"), ["x"]).collect() for r in (rows, [r for r in rows if r[0]]))
    assert [tuple(r) for r in with_null] == [tuple(r) for r in without]
