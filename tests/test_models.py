"""Folds, the logistic model and walk-forward backtests against direct computation."""

import math
import os
from datetime import date, timedelta

import numpy as np
import pandas as pd
import pytest
from conftest import rows
from pyspark.ml import PipelineModel

from tallyline.operators import folds, outcome
from tallyline.operators.folds import FoldConfig
from tallyline.session import FOLD_ROWS
from tallyline.sources.writers import write_model

FEATURES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(11)
    n = 400
    d = pd.DataFrame({
        "builder_id": [f"t{i}" for i in range(n)], "game_date": [date(2024, 1, 1) + timedelta(days=int(x)) for x in rng.integers(0, 120, n)],
        "a": rng.normal(size=n), "b": rng.integers(0, 5, n).astype(float), "c": 2.0, "decimal_odds": 1.0 + rng.integers(0, 8, n) / 4, "stake": 1.0 + rng.integers(0, 3, n)})
    d["builder_hit"] = (rng.random(n) < 1 / (1 + np.exp(-(d.a - 0.3 * d.b)))).astype(int)
    d.loc[::17, "a"] = None
    # the first three weeks hold one class
    d.loc[[x < date(2024, 1, 22) for x in d.game_date], "builder_hit"] = 0
    return d


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(data.astype(object).where(data.notna(), None), (
        "builder_id string, game_date date, a double, b double, c double, decimal_odds double, stake double, builder_hit int")).repartition(3)


def newton(d):
    """The balanced L2 objective solved directly; returns a scorer and the coefficients."""
    x = d[FEATURES].astype(float)
    med = x.median()
    x = x.fillna(med)
    mu, sd = x.mean(), x.std(ddof=0).replace(0, 1.0)
    z = np.c_[np.ones(len(d)), ((x - mu) / sd).to_numpy()]
    y = d.builder_hit.to_numpy()
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    ridge = np.diag([0.0, 1, 1, 1])
    beta = np.zeros(4)
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ beta))
        beta -= np.linalg.solve(z.T @ (z * (w * p * (1 - p))[:, None]) + ridge, z.T @ (w * (p - y)) + ridge @ beta)

    def score(e):
        v = ((e[FEATURES].astype(float).fillna(med) - mu) / sd).to_numpy()
        return 1 / (1 + np.exp(-(beta[0] + v @ beta[1:])))
    return score, beta


def brute_folds(d, cfg, kind):
    first, last = d.game_date.min(), d.game_date.max()
    out, start = [], first
    while True:
        train_end = start + timedelta(days=cfg.train_days)
        test_end = train_end + timedelta(days=cfg.test_days)
        if test_end > last:
            return out
        lo = first if kind == "expanding" else start
        train, test = d[(d.game_date >= lo) & (d.game_date < train_end)], d[(d.game_date >= train_end) & (d.game_date < test_end)]
        if len(train) >= cfg.min_train and len(test):
            out.append((train, test))
        start += timedelta(days=cfg.step)


@pytest.mark.parametrize("kind", ["rolling", "expanding"])
@pytest.mark.parametrize("cfg", [FoldConfig(30, 7, 20), FoldConfig(21, 10, 75, 4), FoldConfig(20, 3, 0, 11), FoldConfig(200, 7, 0)])
def test_folds(df, data, cfg, kind):
    expect = brute_folds(data, cfg, kind)
    got = rows(folds.split_summary(df, cfg, kind), "fold")
    assert [r["fold"] for r in got] == list(range(len(expect)))
    for r, (train, test) in zip(got, expect):
        assert (r["train_start"], r["train_end"], r["train_size"]) == (train.game_date.min(), train.game_date.max(), len(train))
        assert (r["test_start"], r["test_end"], r["test_size"]) == (test.game_date.min(), test.game_date.max(), len(test))


def test_train_and_test_rows_are_disjoint(df, data):
    cfg = FoldConfig(30, 7, 20)
    table = folds.split_summary(df, cfg)
    train = folds.fold_rows(df, cfg, "rolling", "train", table).select("fold", "builder_id")
    test = folds.fold_rows(df, cfg, "rolling", "test", table).select("fold", "builder_id")
    assert train.intersect(test).count() == 0
    assert test.count() == sum(len(t) for _, t in brute_folds(data, cfg, "rolling"))


def test_window_lengths_are_checked():
    for bad in ((0, 7, 0), (60, 0, 0), (60, 7, -1)):
        with pytest.raises(ValueError):
            FoldConfig(*bad)
    with pytest.raises(ValueError):
        FoldConfig(60, 7, 0, -2)


def test_unknown_split_kind(df):
    with pytest.raises(ValueError):
        folds.split_summary(df, FoldConfig(30, 7, 0), "sideways")


def test_model_matches_direct_solution(df, data, tmp_path):
    model = outcome.train(df, FEATURES)
    score, beta = newton(data)
    got = {r["feature"]: r["coefficient"] for r in outcome.coefficients(model, FEATURES).collect()}
    assert np.allclose([got[f] for f in FEATURES], beta[1:], atol=1e-5)
    write_model(model, str(tmp_path / "model"))
    back = outcome.predict(PipelineModel.load(str(tmp_path / "model")), df).toPandas().set_index("builder_id")
    assert np.allclose(back.loc[data.builder_id, "pred_prob"], score(data), atol=1e-5)
    assert ((back["pred_prob"] >= 0.5).astype(int) == back["pred_hit"]).all()
    impact = outcome.feature_impact(model, df, FEATURES).collect()
    assert impact[0]["feature"] in ("a", "b") and math.isclose([r for r in impact if r["feature"] == "b"][0]["mean"], data.b.mean())
    metrics = outcome.evaluate_model(model, df).first()
    assert metrics["n_obs"] == len(data) and math.isclose(metrics["brier"], ((score(data) - data.builder_hit) ** 2).mean(), rel_tol=1e-4)


def test_missing_feature_and_single_class(df):
    with pytest.raises(ValueError, match="missing"):
        outcome.train(df, ["a", "nope"])
    with pytest.raises(ValueError, match="one class"):
        outcome.train(df.filter("builder_hit = 0"), FEATURES)


@pytest.mark.parametrize("kind", ["rolling", "expanding"])
def test_backtest(df, data, kind):
    cfg = FoldConfig(21, 14, 30)
    results, predictions = folds.run_backtest(df, cfg, FEATURES, kind=kind)
    got = {r["fold"]: r for r in rows(results, "fold")}
    seen = {(r["fold"], r["builder_id"]): r["pred_prob"] for r in predictions.collect()}
    fitted = 0
    for fold, (train, test) in enumerate(brute_folds(data, cfg, kind), 1):
        if train.builder_hit.nunique() < 2:
            assert fold not in got  # keeps its number, has no result
            continue
        fitted += 1
        score, _ = newton(train)
        p = score(test)
        assert np.allclose([seen[(fold, i)] for i in test.builder_id], p, atol=1e-7)
        r = got[fold]
        profit = np.where(test.builder_hit == 1, test.stake * (test.decimal_odds - 1), -test.stake)
        assert math.isclose(r["roi"], profit.sum() / test.stake.sum()) and r["train_n"] == len(train) and r["n_obs"] == len(test)
        assert math.isclose(r["brier"], ((p - test.builder_hit) ** 2).mean(), rel_tol=1e-6)
        q = score(train)
        assert math.isclose(r["train_accuracy"], ((q >= 0.5) == train.builder_hit).mean())
        pos, neg = q[train.builder_hit == 1], q[train.builder_hit == 0]
        assert math.isclose(r["train_roc_auc"], ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg)), rel_tol=1e-9)
    assert fitted == len(got) and fitted < len(brute_folds(data, cfg, kind))


def test_training_rows_are_scored_some_folds_at_a_time(spark, df, split, monkeypatch):
    """Before, the rows of all folds were shuffled together; the scores of a stretch go before the next one is taken."""
    cfg, held, measure = FoldConfig(21, 14, 30), [], folds.classifier_metrics
    whole = rows(folds.run_backtest(df, cfg, FEATURES, kind="expanding")[0], "fold")
    largest = max(r["train_n"] for r in whole)

    def counted(scored, *rest):
        held.append(scored.count())
        return measure(scored, *rest)

    def stored_tables():
        return len(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")))

    monkeypatch.setattr(folds, "classifier_metrics", counted)
    spark.conf.set(FOLD_ROWS, str(largest + 30))
    before = stored_tables()
    try:
        parts = rows(folds.run_backtest(df, cfg, FEATURES, kind="expanding")[0], "fold")
    finally:
        spark.conf.unset(FOLD_ROWS)
    assert len(held) > 1 and max(held) <= largest + 30 and stored_tables() == before + 1
    assert [r["fold"] for r in parts] == [r["fold"] for r in whole]
    for a, b in zip(parts, whole):
        assert math.isclose(a["train_accuracy"], b["train_accuracy"]) and math.isclose(a["train_roc_auc"], b["train_roc_auc"])


def test_backtest_summary_trend(spark):
    roi = [0.1, -0.2, 0.05, 0.3, 0.25]
    df = spark.createDataFrame([(i + 1, date(2024, 1, 1 + i), r, r * 10, 10.0) for i, r in enumerate(roi)], "fold int, test_start date, roi double, profit double, total_stake double")
    r = folds.backtest_summary(df).first()
    slope, _ = np.polyfit(range(5), roi, 1)
    r2 = np.corrcoef(range(5), roi)[0, 1] ** 2
    assert math.isclose(r["slope"], slope) and math.isclose(r["r_squared"], r2) and (r["best_fold"], r["worst_fold"]) == (4, 2)
    # two-sided t with 3 degrees of freedom has a closed form
    t = math.sqrt(r2 * 3 / (1 - r2))
    p = 1 - 2 / math.pi * (math.atan(t / math.sqrt(3)) + t / math.sqrt(3) / (1 + t * t / 3))
    assert math.isclose(r["p_value"], p, rel_tol=1e-9) and r["significant"] == (p < 0.05)
    assert math.isclose(r["overall_roi"], sum(roi) / 5) and r["win_rate"] == 0.8


def test_sums_of_a_fold_need_no_row_for_each_fold(spark):
    """Rows in many folds are met once; a stretch of them is each fold's."""
    spans = [(0, 2, 1.0), (1, 4, None), (1, 3, 2.0), (2, 5, 4.0), (3, 2, 8.0)]
    df = spark.createDataFrame([(*s, 1) for s in spans], "_low int, _high int, x double, y int").repartition(2)
    got = folds._by_fold(df, ["x"], "y", [0, 2, 4, 9], 2, lambda k, x, missing, y: np.array([len(y), np.where(missing, 0.5, x).sum()]))
    assert {k: v.tolist() for k, v in got.items()} == {0: [1, 1.0], 2: [4, 7.5], 4: [2, 4.5]}
