"""Nearest-neighbour mutual information against all pairs."""

import math

import numpy as np
import pandas as pd
import pytest

from tallyline.operators import neighbours
from tallyline.operators.neighbours import Boxes, Cells, knn_mutual_information, kth_distances


def psi(n):
    return -0.5772156649015329 + sum(1 / i for i in range(1, n))


def brute(x, y, k=3):
    x, y = (np.rint(v / v.std() * 2**30).astype(np.int64) for v in (x, y))
    gap = np.maximum(abs(x[:, None] - x), abs(y[:, None] - y))
    np.fill_diagonal(gap, 1 << 62)
    r = np.maximum(np.sort(gap, axis=1)[:, k - 1] - 1, 0)
    nx, ny = ((abs(v[:, None] - v) <= r[:, None]).sum(1) for v in (x, y))
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(a) + psi(b) for a, b in zip(nx.tolist(), ny.tolist())]))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(10)
    n = 500
    d = pd.DataFrame({"a": rng.normal(size=n), "few": rng.integers(0, 4, n).astype(float), "same": 3.0})
    d["near_a"] = d.a + rng.normal(size=n) * 0.2
    d.loc[:160, ["a", "near_a"]] = 1.5, -2.0  # a third of the rows in one place
    d.loc[300:420, "near_a"] = d.near_a[300:421] * 1e-3  # and a very dense stretch
    return d


@pytest.mark.parametrize("leaf_points", [7, 60, 4000])
def test_against_all_pairs(spark, data, leaf_points):
    d = data.copy()
    d.loc[5, "few"] = None
    frame = spark.createDataFrame(d.astype(object).where(d.notna(), None), "a double, few double, same double, near_a double").repartition(3)
    got = {(r["var_x"], r["var_y"]): r for r in knn_mutual_information(frame, ["a", "few", "same", "near_a"], leaf_points=leaf_points).collect()}
    full = d.dropna()
    assert set(got) == {("a", "few"), ("a", "near_a"), ("few", "near_a")}
    for (x, y), r in got.items():
        assert r["n"] == len(full) and math.isclose(r["mi"], brute(full[x].to_numpy(), full[y].to_numpy()), abs_tol=1e-8)



def test_kth_distances_cross_boxes(spark):
    rng = np.random.default_rng(2)
    points = {(int(a), int(b)): int(w) for a, b, w in zip(rng.integers(-50, 50, 400), rng.integers(-10**6, 10**6, 400), rng.integers(1, 4, 400))}
    points |= {(10**9, 10**9): 1, (-(10**9), 5): 9}
    frame = spark.createDataFrame([(0, x, y, w) for (x, y), w in points.items()], "pair int, x bigint, y bigint, w bigint")
    got = {(r["x"], r["y"]): r["r"] for r in kth_distances(frame, 3, leaf_points=10).collect()}
    for (x, y), w in points.items():
        gaps = sorted([0] * (w - 1) + [max(abs(x - a), abs(y - b)) for (a, b), v in points.items() for _ in range(v) if (a, b) != (x, y)])
        assert got[x, y] == gaps[2]


def test_boxes_cover_the_plane():
    rng = np.random.default_rng(1)
    sample = rng.integers(-100, 100, (300, 2))
    tree = Boxes(sample, 12)
    x, y = (rng.integers(-1000, 1000, 200) for _ in "xy")
    rows, _ = tree.meets(x, y, np.zeros(200, np.int64))
    assert sorted(rows.tolist()) == list(range(200)) and len(tree.bounds) == 12


def test_boxes_part_values_that_half_the_points_share():
    """Before, a box whose least value held half of its sample was not split again, and its points were all compared."""
    rng = np.random.default_rng(3)
    sample = np.column_stack((rng.choice([0, 5], 640, p=[0.7, 0.3]) * 10**6, rng.integers(0, 10**6, 640)))
    tree = Boxes(sample, 16)
    _, leaf = tree.meets(sample[:, 0], sample[:, 1], np.zeros(640, np.int64))
    assert len(tree.bounds) == 16 and np.bincount(leaf).max() < 80


def test_cells_compare_few_points(monkeypatch):
    """Before, every two points of a leaf were compared."""
    rng = np.random.default_rng(4)
    x, y = (rng.integers(-10**6, 10**6, 3_000) for _ in "xy")
    compared, compare = [], neighbours._compare
    monkeypatch.setattr(neighbours, "_compare", lambda x, y, of_x, of_y, k: compared.append(len(x) * len(of_x)) or compare(x, y, of_x, of_y, k))
    cells, ones = Cells(x, y), np.ones(3_000, np.int64)
    r = cells.first_reach(ones, 3)
    d, near = cells.nearest(x, y, r, 3)
    gaps = np.maximum(abs(x[:, None] - x), abs(y[:, None] - y))
    assert (d == np.sort(gaps, axis=1)[:, :4]).all() and (np.take_along_axis(gaps, near, 1) == d).all()
    assert (d[~cells.leave(r), 3] == r[~cells.leave(r)]).all() and sum(compared) < 3_000**2 / 10


def test_few_rows(spark, data):
    assert knn_mutual_information(spark.createDataFrame(data.head(20)), ["a", "few"]).count() == 0
