"""Ordered operators: the range-split way against brute force, one key holding a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyline.functions import ordered
from tallyline.operators import betting, counts, dependence, goodness, replay, windows


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(7)
    n = 400
    key = np.where(rng.random(n) < 0.35, "hot", rng.choice(["a", "b", "c", "d", "e", "f", "g", "h"], n))
    return pd.DataFrame({
        "id": np.arange(n), "k": key, "day": pd.to_datetime("2024-01-01") + pd.to_timedelta(rng.integers(0, 60, n), "D"),
        "x": rng.integers(0, 12, n).astype(float), "y": rng.normal(size=n).round(3), "win": rng.integers(0, 2, n),
        "odds": 1 + rng.integers(1, 9, n) / 4, "stake": 1 + rng.integers(0, 3, n) / 2})


@pytest.fixture(scope="module")
def df(spark, data):
    out = spark.createDataFrame(data).withColumn("day", F.to_date("day"))
    return out.repartition(3)


def pdf(frame, by):
    return frame.toPandas().sort_values(by).reset_index(drop=True)


def test_split_is_taken_and_plain_otherwise(spark, df, split):
    assert ordered.arrange(df, ["k"], [F.col("id").asc()]).split
    assert not ordered.arrange(df, ["k"], [F.col("id").asc()], group_rows=5).split


def test_plain_layout(df):
    assert not ordered.arrange(df, ["k"], [F.col("id").asc()]).split


@pytest.mark.parametrize("keys", [["k"], []])
def test_running_sum_and_max(df, data, split, keys):
    got = pdf(ordered.finish(ordered.running(ordered.arrange(df, keys, [F.col("id").asc()]), {
        "s": ("sum", F.col("y")), "m": ("max", F.col("y")), "n": ("sum", F.lit(1).cast("long"))})), "id")
    group = data.groupby("k") if keys else data.groupby(lambda _: 0)
    assert np.allclose(got["s"], group["y"].cumsum())
    assert np.allclose(got["m"], group["y"].cummax())
    assert (got["n"] == group.cumcount() + 1).all()


def test_running_with_null_keys(spark, split):
    rows = [(None if i % 3 else "z", i) for i in range(120)]
    got = ordered.row_numbers(spark.createDataFrame(rows, "k string, i int"), ["k"], [F.col("i").asc()], "rn").toPandas().sort_values("i")
    expect = pd.DataFrame(rows, columns=["k", "i"]).groupby("k", dropna=False).cumcount() + 1
    assert (got["rn"].to_numpy() == expect.to_numpy()).all()


@pytest.mark.parametrize("keys", [["k"], []])
@pytest.mark.parametrize("column", ["x", "y"])
def test_quantiles(df, data, split, keys, column):
    probs = {"p0": 0.0, "p10": 0.1, "p50": 0.5, "p77": 0.77, "p100": 1.0}
    got = ordered.quantiles(df, keys, column, probs).toPandas()
    for _, r in got.iterrows():
        values = data[data.k == r["k"]][column] if keys else data[column]
        for name, p in probs.items():
            assert np.isclose(r[name], np.percentile(values, p * 100)), name


def test_average_ranks(df, data, split):
    got = ordered.average_ranks(df, ["k"], "x").toPandas()
    expect = data.assign(r=data.groupby("k")["x"].rank()).groupby(["k", "x"])["r"].first()
    for _, r in got.iterrows():
        assert r["avg_rank"] == expect[(r["k"], r["x"])]


def test_rolling_means(df, data, split):
    got = pdf(windows.rolling_means(df, ["y"], [3, 50], entity="k", date="day", tiebreak="id"), "id")
    s = data.sort_values(["day", "id"])
    for w in (3, 50):
        expect = s.groupby("k")["y"].transform(lambda v: v.shift(1).rolling(w, min_periods=1).mean()).sort_index()
        assert np.allclose(got[f"y_rolling_{w}"].astype(float), expect, equal_nan=True)


def test_trailing_mean_without_key(df, data, split):
    got = pdf(windows.trailing_mean(df, "y", 7, order=["id"], out="t"), "id")
    assert np.allclose(got["t"], data["y"].rolling(7, min_periods=1).mean())


def test_rest_days(df, data, split):
    got = pdf(windows.rest_days(df, entity="k", date="day", tiebreak="id"), "id")
    s = data.sort_values(["k", "day", "id"])
    gap = s.groupby("k")["day"].diff().dt.days
    expect = gap.fillna(gap.median()).sort_index()
    assert (got["days_rest"] == expect).all()


def brute_drawdown(d):
    profit = np.where(d.win == 1, d.stake * (d.odds - 1), -d.stake)
    cum = np.cumsum(profit)
    peak = np.maximum.accumulate(cum)
    longest = run = 0
    for down in peak - cum > 0:
        run = run + 1 if down else 0
        longest = max(longest, run)
    return (peak - cum).max(), longest, cum[-1]


def test_drawdown(df, data, split):
    r = windows.drawdown_summary(df, order=["id"], hit="win", odds="odds").first()
    worst, longest, final = brute_drawdown(data)
    assert np.isclose(r["max_drawdown"], worst) and r["max_drawdown_period"] == longest and np.isclose(r["final_profit"], final)
    per = windows.drawdown_summary(df, order=["id"], hit="win", odds="odds", keys=["k"]).toPandas().set_index("k")
    for k, d in data.groupby("k"):
        worst, longest, final = brute_drawdown(d)
        assert np.isclose(per.loc[k, "max_drawdown"], worst) and per.loc[k, "max_drawdown_period"] == longest


def test_streaks(df, data, split):
    got = pdf(windows.streaks(df.withColumn("w", F.col("win") == 1), "w", order=["id"], keys=["k"]), "id")
    for k, d in data.groupby("k"):
        run, last = 0, None
        for i, w in zip(d.id, d.win):
            run = run + 1 if w == last else 1
            last = w
            assert got.loc[i, "win_streak"] == (run if w else 0) and got.loc[i, "loss_streak"] == (0 if w else run)


def brute_tau(x, y):
    n, c, d, tx, ty = len(x), 0, 0, 0, 0
    for i in range(n):
        for j in range(i):
            a, b = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            c += a * b > 0
            d += a * b < 0
            tx += a == 0
            ty += b == 0
    total = n * (n - 1) / 2
    return (c - d) / np.sqrt((total - tx) * (total - ty))


@pytest.mark.parametrize("cut", [True, False])
def test_rank_dependence(request, spark, df, data, cut):
    if cut:
        request.getfixturevalue("split")
    d = data.assign(z=(data.x + data.y * 3).round(1))
    frame = spark.createDataFrame(d[["x", "y", "z"]])
    got = dependence.pair_dependence(frame, ["x", "y", "z"]).toPandas().set_index(["var_x", "var_y"])
    for a, b in [("x", "y"), ("x", "z"), ("y", "z")]:
        r = got.loc[(a, b)]
        assert np.isclose(r["kendall"], brute_tau(d[a].to_numpy(), d[b].to_numpy()))
        assert np.isclose(r["spearman"], d[a].rank().corr(d[b].rank()))
        assert np.isclose(r["pearson"], d[a].corr(d[b]))
        top = d[d[a] >= np.percentile(d[a], 90)]
        assert np.isclose(float(r["upper_tail"]) if r["upper_tail"] is not None else np.nan, top[a].corr(top[b]), equal_nan=True)


def test_entity_spearman_split_equals_plain(spark, df, data):
    from tallyline.session import MAX_GROUP_ROWS
    plain = dependence.entity_correlations(df, ["x", "y"], entity="k", min_games=5).toPandas()
    spark.conf.set(MAX_GROUP_ROWS, "20")
    try:
        cut = dependence.entity_correlations(df, ["x", "y"], entity="k", min_games=5).toPandas()
    finally:
        spark.conf.unset(MAX_GROUP_ROWS)
    keys = ["k", "stat_x", "stat_y"]
    both = plain.merge(cut, on=keys)
    assert len(both) == len(plain) == 27 and np.allclose(both["corr_x"], both["corr_y"])
    hot = data[data.k == "hot"]
    assert np.isclose(both[(both.k == "hot") & (both.stat_x != both.stat_y)]["corr_x"].iloc[0], hot.x.rank().corr(hot.y.rank()))


def test_distribution_summary(df, data, split):
    got = counts.distribution_summary(df, ["x", "y"], entity="k", min_games=20).toPandas().set_index(["k", "stat"])
    for (k, stat), r in got.iterrows():
        v = data[data.k == k][stat]
        assert r["n_games"] == len(v) and np.isclose(r["std"], v.std()) and np.isclose(r["p75"], np.percentile(v, 75))


def test_roc_and_auc(df, data, split):
    points = betting.roc_points(df, "x", "win", drop_collinear=False).toPandas().sort_values("threshold", ascending=False)
    p, q = (data.win == 1).sum(), (data.win == 0).sum()
    for _, r in points.iterrows():
        above = data[data.x >= r["threshold"]]
        assert np.isclose(r["tpr"], (above.win == 1).sum() / p) and np.isclose(r["fpr"], (above.win == 0).sum() / q)
    pos, neg = data[data.win == 1].x.to_numpy(), data[data.win == 0].x.to_numpy()
    wins = (pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()
    assert np.isclose(betting.auc_table(df, "x", "win").first()["roc_auc"], wins / (p * q))


def test_offered_lines(spark, df, data, split):
    facts = df.select(F.col("k").alias("player_id"), F.lit("s").alias("stat"), F.col("x").alias("value"))
    lines = spark.createDataFrame([(k, "s", float(v)) for k in ("hot", "a", "zz") for v in (-1, 0, 3.5, 4, 11, 99)], "player_id string, stat string, line double")
    got = replay.offered_line_rates(facts, lines).toPandas()
    assert set(got.player_id) == {"hot", "a"} and len(got) == 12
    for _, r in got.iterrows():
        v = data[data.k == r["player_id"]].x
        assert np.isclose(r["hit_rate"], (v > r["line"]).mean() * 100)


def test_goodness_and_box_in_both_layouts(spark, df, data):
    from tallyline.session import CHUNK_ROWS, MAX_GROUP_ROWS
    shown = []
    for limit in ("4000000", "20"):
        spark.conf.set(MAX_GROUP_ROWS, limit)
        spark.conf.set(CHUNK_ROWS, "37")
        shown.append((goodness.fit_families(df, ["x", "y"]).toPandas().sort_values(["variable", "family"]).reset_index(drop=True),
                      goodness.box_summary(df, ["y"], by="k").toPandas().sort_values("k").reset_index(drop=True),
                      goodness.histogram(df, "y", bins=9).toPandas().sort_values("bin").reset_index(drop=True)))
        spark.conf.unset(MAX_GROUP_ROWS)
        spark.conf.unset(CHUNK_ROWS)
    for a, b in zip(*shown):
        pd.testing.assert_frame_equal(a, b)
    expect, edges = np.histogram(data.y, bins=9)
    table = shown[0][2].set_index("bin")["weight"]
    assert [table.get(i, 0) for i in range(9)] == list(expect)
