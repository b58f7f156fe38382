"""Composed scans over many pieces, and ranks joined back by shuffles."""

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tallyline.operators import dependence, windows
from tallyline.session import BROADCAST_ROWS


def runs(won):
    out, n = [], 0
    for i, w in enumerate(won):
        n = n + 1 if i and w is not None and won[i - 1] is not None and w == won[i - 1] else 1
        out.append(n)
    return out


@pytest.mark.parametrize("pattern", ["all won", "long runs", "mixed", "unknown"])
def test_streaks_over_many_pieces(spark, split, pattern):
    rng = np.random.default_rng(3)
    n = 400
    won = {"all won": [True] * n, "long runs": [bool(i // 130 % 2) for i in range(n)], "mixed": [bool(x) for x in rng.random(n) < .7],
           "unknown": [None if i % 90 == 40 else i < 300 for i in range(n)]}[pattern]
    df = spark.createDataFrame([(i, i % 7 == 0, w) for i, w in enumerate(won)], "i int, k boolean, w boolean").repartition(5)
    got = rows(windows.streaks(df, "w", order=["i"]), "i")
    assert [(r["win_streak"], r["loss_streak"]) for r in got] == [(k if w else 0, k if w is False else 0) for w, k in zip(won, runs(won))]


@pytest.mark.parametrize("pattern", ["rising", "falling", "late peak", "random"])
def test_drawdown_over_many_pieces(spark, split, pattern):
    rng = np.random.default_rng(4)
    n = 500
    hits = {"rising": [1] * n, "falling": [0] * n, "late peak": [1] * 3 + [0] * 240 + [1] * 257, "random": rng.integers(0, 2, n).tolist()}[pattern]
    df = spark.createDataFrame([(i, h, 2.0, 1.0) for i, h in enumerate(hits)], "i int, builder_hit int, decimal_odds double, stake double").repartition(5)
    profit = np.where(np.array(hits) == 1, 1.0, -1.0)
    cum = np.cumsum(profit)
    peak = np.maximum.accumulate(cum)
    longest = n_open = 0
    for d in peak - cum:
        n_open = n_open + 1 if d > 0 else 0
        longest = max(longest, n_open)
    got = windows.drawdown_summary(df, order=["i"]).first()
    assert (got["max_drawdown"], got["max_drawdown_period"], got["final_profit"], got["max_profit"], got["n_bets"]) == ((peak - cum).max(), longest, cum[-1], cum.max(), n)
    curve = rows(windows.equity_curve(df, order=["i"]), "i")
    assert [(r["cum_profit"], r["running_max"]) for r in curve] == list(zip(cum.tolist(), peak.tolist()))


def test_split_rows_are_read_twice(spark, split):
    df = spark.range(300).select(F.col("id"), (F.col("id") % 3 == 0).cast("int").alias("builder_hit"), F.lit(2.5).alias("decimal_odds"), F.lit(1.0).alias("stake"))
    table = windows.drawdown_summary(df, order=["id"])
    assert table._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 2


@pytest.mark.parametrize("limit", ["1", "500000"])
def test_ranks_joined_either_way(spark, limit):
    rng = np.random.default_rng(6)
    d = pd.DataFrame({"a": rng.normal(size=600), "b": rng.integers(0, 9, 600).astype(float), "c": 1.0, "e": rng.normal(size=600).round(1)})
    d["b"] += (d.a > 0) * 3
    d.loc[::50, "e"] = None
    spark.conf.set(BROADCAST_ROWS, limit)
    try:
        got = {(r["stat_x"], r["stat_y"]): r for r in dependence.global_correlation(spark.createDataFrame(d.astype(object).where(d.notna(), None), "a double, b double, c double, e double"), ["a", "b", "c", "e"]).collect()}
    finally:
        spark.conf.unset(BROADCAST_ROWS)
    ranks = d.dropna().rank()
    assert len(got) == 10
    for (x, y), r in got.items():
        assert r["n_obs"] == len(ranks)
        assert r["corr"] is None if "c" in (x, y) else np.isclose(r["corr"], ranks[x].corr(ranks[y]))
