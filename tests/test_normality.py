"""Normal scores and Shapiro-Francia against sums over single rows; binned densities against exact ones."""

import math
import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyline.functions.dist import normal_quantile, normal_score_sums
from tallyline.operators.goodness import kde_grid, shapiro_francia

INVERSE = NormalDist().inv_cdf


def scores(n):
    return [INVERSE((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)]


def test_quantiles():
    p = np.array([1e-300, 1e-12, 1e-3, 0.02, 0.3, 0.5, 0.7, 0.999, 1 - 1e-12])
    assert np.allclose(normal_quantile(p)[1:], [INVERSE(x) for x in p[1:]], rtol=1e-9, atol=1e-12)


@pytest.mark.parametrize("n", [1, 2, 5, 63, 128, 129, 1000, 5001])
def test_sums_of_any_run_of_ranks(spark, n):
    rng, m = random.Random(n), scores(n)
    runs = [tuple(sorted((rng.randint(0, n), rng.randint(0, n)))) for _ in range(40)] + [(0, n), (0, 0), (n - 1, n)]
    frame = spark.createDataFrame([(a, b, n) for a, b in runs], "a long, b long, n long")
    for r in frame.select("a", "b", normal_score_sums("a", "b", "n").alias("s")).collect():
        part = m[r["a"]:r["b"]]
        assert math.isclose(r["s"]["sum"], sum(part), rel_tol=1e-9, abs_tol=1e-8)
        assert math.isclose(r["s"]["squares"], sum(x * x for x in part), rel_tol=1e-9, abs_tol=1e-8)


def plain(values):
    n, m = len(values), scores(len(values))
    mean = sum(values) / n
    w = sum(x * y for x, y in zip(sorted(values), m)) ** 2 / (sum(y * y for y in m) * sum((x - mean) ** 2 for x in values))
    u = math.log(n)
    v = math.log(u)
    z = (math.log(1 - w) - (-1.2725 + 1.0521 * (v - u))) / (1.0308 - 0.26758 * (v + 2 / u))
    return w, z, 1 - NormalDist().cdf(z)


def test_test_by_single_rows(spark):
    rng = random.Random(1)
    cases = {"normal": [rng.gauss(3, 2) for _ in range(700)], "skewed": [rng.expovariate(1) for _ in range(700)],
             "tied": [float(max(0, rng.randint(-9, 4))) for _ in range(700)], "few": [1.0, 2.5, 2.0, 4.0, 7.0] + [None] * 695,
             "four": [1.0, 2.0, 3.0, 5.0] + [None] * 696, "constant": [7.0] * 700, "empty": [None] * 700}
    frame = spark.createDataFrame(list(zip(*cases.values())), ", ".join(f"{c} double" for c in cases))
    got = {r["variable"]: r for r in shapiro_francia(frame, list(cases)).collect()}
    for name in ("normal", "skewed", "tied", "few"):
        want = plain([x for x in cases[name] if x is not None])
        assert all(math.isclose(got[name][c], x, rel_tol=1e-8, abs_tol=1e-12) for c, x in zip(("w", "z", "p"), want))
    assert got["normal"]["is_normal"] and got["few"]["is_normal"] and not got["skewed"]["is_normal"] and not got["tied"]["is_normal"]
    assert all(got[c]["w"] is None and got[c]["p"] is None and got[c]["is_normal"] is None for c in ("four", "constant"))
    assert "empty" not in got


def test_range_split_way_agrees(spark, split):
    rng = random.Random(2)
    values = [round(rng.gauss(0, 1), 2) for _ in range(900)]
    r = shapiro_francia(spark.createDataFrame([(x,) for x in values], "v double"), ["v"]).first()
    assert math.isclose(r["w"], plain(values)[0], rel_tol=1e-9)


@pytest.mark.parametrize("tolerance", [1e-2, 1e-4])
def test_binned_density_keeps_its_bound(spark, tolerance):
    rng = random.Random(5)
    values = [rng.gauss(0, 1) if rng.random() < 0.7 else rng.uniform(3, 3.2) for _ in range(1500)] + [0.5] * 700
    frame = spark.createDataFrame([(x,) for x in values], "v double")
    exact, binned = ({r["point"]: r for r in kde_grid(frame, "v", 80, tolerance=t).collect()} for t in (None, tolerance))
    h = float(np.std(values, ddof=1)) * len(values) ** -0.2
    bound = tolerance / (math.sqrt(2 * math.pi) * h)
    gaps = [abs(exact[p]["density"] - binned[p]["density"]) for p in exact]
    assert exact.keys() == binned.keys() and 0 < max(gaps) <= bound * (1 + 1e-9)
    assert all(math.isclose(exact[p]["x"], binned[p]["x"], rel_tol=1e-12, abs_tol=1e-12) for p in exact)


def test_binned_density_of_odd_tables(spark):
    for values in ([], [None], [1.0], [2.0, 2.0]):
        assert kde_grid(spark.createDataFrame([(v,) for v in values], "v double"), "v", tolerance=1e-3).filter(F.col("density").isNotNull()).count() == 0
