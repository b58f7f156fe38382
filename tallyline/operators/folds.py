"""Walk-forward folds, the outcome model on every fold at once, and backtest summaries.

Folds lie on a regular grid of days, so the folds a date belongs to follow from
arithmetic: no interval join is needed, and sizes come from one count per day.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.dist import correlation_p
from ..functions.selection import group_medians
from ..session import FOLD_ROWS, SHUFFLES_REMOVED, setting, settings, stored, tables_removed
from .betting import classifier_metrics, prediction_metrics


@dataclass(frozen=True)
class FoldConfig:
    """Window lengths in days; `step_days` defaults to the test window."""

    train_days: int = 60
    test_days: int = 7
    min_train: int = 200
    step_days: int | None = None
    date: str = "game_date"

    def __post_init__(self) -> None:
        if self.train_days <= 0 or self.test_days <= 0:
            raise ValueError("train_days and test_days must be positive")
        if self.min_train < 0:
            raise ValueError("min_train must not be negative")
        if self.step_days is not None and self.step_days <= 0:
            raise ValueError("step_days must be positive")

    @property
    def step(self) -> int:
        return self.step_days or self.test_days


def _ceil_div(a: Column, b: int) -> Column:
    return F.ceil(a / F.lit(float(b))).cast("int")


def _floor_div(a: Column, b: int) -> Column:
    return F.floor(a / F.lit(float(b))).cast("int")


def _slot_ends(day: Column, last: Column, cfg: FoldConfig, kind: str, part: str) -> tuple[Column, Column]:
    """First and last grid slot whose train (or test) window holds the day; slot i trains from i*step on."""
    t, v, s = cfg.train_days, cfg.test_days, cfg.step
    if part == "test":
        low, high = _ceil_div(day - t - v + 1, s), _floor_div(day - t, s)
    elif kind == "rolling":
        low, high = _ceil_div(day - t + 1, s), _floor_div(day, s)
    elif kind == "expanding":
        low, high = _floor_div(day - t, s) + 1, last
    else:
        raise ValueError(f"unknown split kind {kind!r}")
    return F.greatest(low, F.lit(0)), F.least(high, last)


def _with_ends(df: DataFrame, bounds: Column, cfg: FoldConfig, kind: str, part: str) -> DataFrame:
    """Rows with the first and last slot they are in, `_low` and `_high`; rows in none have a first behind the last."""
    placed = df.withColumn("_b", bounds)
    day = F.datediff(F.col(cfg.date), F.col("_b.first"))
    last = _floor_div(F.datediff(F.col("_b.last"), F.col("_b.first")) - cfg.train_days - cfg.test_days, cfg.step)
    low, high = _slot_ends(day, last, cfg, kind, part)
    return placed.withColumns({"_low": low, "_high": high}).drop("_b")


def _with_slots(df: DataFrame, bounds: Column, cfg: FoldConfig, kind: str, part: str, only: tuple[int, int] | None = None) -> DataFrame:
    """A row for each slot that a row is in; `only` gives the first and last of the slots wanted."""
    ends = _with_ends(df, bounds, cfg, kind, part)
    if only:
        ends = ends.withColumns({"_low": F.greatest("_low", F.lit(only[0])), "_high": F.least("_high", F.lit(only[1]))})
    return ends.filter("_low <= _high").withColumn("slot", F.explode(F.sequence("_low", "_high"))).drop("_low", "_high")


def date_bounds(df: DataFrame, date: str) -> Column:
    """First and last date as one scalar subquery."""
    return df.agg(F.struct(F.min(date).alias("first"), F.max(date).alias("last")).alias("b")).scalar()


def split_summary(df: DataFrame, cfg: FoldConfig, kind: str = "rolling") -> DataFrame:
    """Usable folds: fold (from 0), slot, first and last dates, sizes.

    The last date only bounds the grid and is never tested; folds with too few
    training rows or no test rows are left out.  The table has one row per fold.
    """
    daily = df.filter(F.col(cfg.date).isNotNull()).groupBy(cfg.date).agg(F.count(F.lit(1)).alias("rows"))
    bounds = date_bounds(df, cfg.date)
    parts = [_with_slots(daily, bounds, cfg, kind, p).withColumn("part", F.lit(p)) for p in ("train", "test")]
    both = parts[0].unionByName(parts[1])
    d, r = F.col(cfg.date), F.col("rows")
    train, test = F.col("part") == "train", F.col("part") == "test"
    sized = both.groupBy("slot").agg(
        F.min(F.when(train, d)).alias("train_start"), F.max(F.when(train, d)).alias("train_end"),
        F.min(F.when(test, d)).alias("test_start"), F.max(F.when(test, d)).alias("test_end"),
        F.coalesce(F.sum(F.when(train, r)), F.lit(0)).alias("train_size"),
        F.coalesce(F.sum(F.when(test, r)), F.lit(0)).alias("test_size"))
    usable = sized.filter((F.col("train_size") >= cfg.min_train) & (F.col("test_size") > 0))
    return usable.withColumn("fold", F.row_number().over(Window.orderBy("slot")) - 1)


def fold_rows(df: DataFrame, cfg: FoldConfig, kind: str, part: str, folds: DataFrame) -> DataFrame:
    """Rows of the train or test part with their fold number; `folds` has one row per fold."""
    placed = _with_slots(df.filter(F.col(cfg.date).isNotNull()), date_bounds(df, cfg.date), cfg, kind, part)
    return placed.join(F.broadcast(folds.select("slot", "fold")), "slot").drop("slot")


def fold_metrics(df: DataFrame, cfg: FoldConfig, prob: str, kind: str = "rolling", **columns: str) -> DataFrame:
    """Measures of ready-made predictions on the test part of each fold."""
    test = fold_rows(df, cfg, kind, "test", split_summary(df, cfg, kind))
    return test.groupBy("fold").agg(*prediction_metrics(prob, **columns))


def _by_fold(train: DataFrame, features: Sequence[str], label: str, folds: Sequence[int], size: int,
             work: Callable[[int, np.ndarray, np.ndarray, np.ndarray], np.ndarray]) -> dict[int, np.ndarray]:
    """fold -> the `size` sums that `work(fold, features, missing, label)` gives of its rows, for folds with rows.

    `train` has a row once, with the first and last fold it is in.  Every batch is put in order of these, so that a fold's rows
    are a stretch of it and no row is copied for its folds.  Only the sums reach the driver.
    """
    order = np.array(sorted(folds), np.int64)
    names = ["fold", *[f"s{i}" for i in range(size)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((len(order), size)), np.zeros(len(order), bool)
        for batch in batches:
            low, high, y, *columns = batch.columns
            low, high = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in (low, high))
            at = np.lexsort((high, low))
            low, high, y = low[at], high[at], y.to_numpy(zero_copy_only=False).astype(float)[at]
            missing = np.column_stack([c.is_null().to_numpy(zero_copy_only=False) for c in columns])[at]
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in columns])[at]
            first, upto = np.searchsorted(high, order, "left"), np.searchsorted(low, order, "right")
            for j in np.flatnonzero(first < upto).tolist():
                mine = slice(first[j], upto[j])
                total[j] += work(int(order[j]), x[mine], missing[mine], y[mine])
                met[j] = True
        yield pa.RecordBatch.from_arrays([pa.array(order[met], pa.int32()), *[pa.array(total[met, i]) for i in range(size)]], names)

    rows = train.filter("_low <= _high").select("_low", "_high", F.col(label).cast("double"), *[F.col(f).cast("double") for f in features])
    parts = rows.mapInArrow(run, ", ".join(["fold int", *[f"{n} double" for n in names[1:]]]))
    return {r[0]: np.array(r[1:]) for r in parts.groupBy("fold").agg(*[F.sum(n).alias(n) for n in names[1:]]).collect()}  # one row per fold


def _fold_scaling(train: DataFrame, features: Sequence[str], label: str, medians: dict[tuple[int, str], float], folds: Sequence[int]) -> dict[int, dict]:
    """Per fold: medians, mean and spread of each feature after filling by the fold's median, and class counts.

    A feature without any value in a fold is zero.
    """
    d = len(features)
    fill = {k: np.array([float(medians.get((k, f), 0.0)) for f in features]) for k in folds}

    def sums(k: int, x: np.ndarray, missing: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.concatenate(([len(y), np.count_nonzero(y == 1)], np.where(missing, fill[k], x).sum(axis=0)))

    counts = _by_fold(train, features, label, folds, d + 2, sums)
    means = {k: v[2:] / v[0] for k, v in counts.items()}

    def away(k: int, x: np.ndarray, missing: np.ndarray, y: np.ndarray) -> np.ndarray:
        return ((np.where(missing, fill[k], x) - means[k]) ** 2).sum(axis=0)

    squares = _by_fold(train, features, label, list(counts), d, away)
    return {k: {"n": int(v[0]), "n1": int(v[1]), "med": fill[k], "mu": means[k], "sd": np.sqrt(squares[k] / v[0])} for k, v in counts.items()}


class _Scorer:
    """Column expressions for a fold's parameters, built once and used in every step."""

    def __init__(self, features: Sequence[str]) -> None:
        self.d = len(features)
        self.names = ["fold", "_c0", "_c1", "_b", *[f"_{k}{i}" for k in "wmus" for i in range(self.d)]]
        self.schema = ", ".join(f"{n} {'int' if n == 'fold' else 'double'}" for n in self.names)
        self.z = {f"_z{i}": (F.coalesce(F.col(f).cast("double"), F.col(f"_m{i}")) - F.col(f"_u{i}")) / F.col(f"_s{i}")
                  for i, f in enumerate(features)}
        self.margin = F.col("_b")
        for i in range(self.d):
            self.margin = self.margin + F.col(f"_w{i}") * F.col(f"_z{i}")
        self.prob = 1.0 / (1.0 + F.exp(-F.col("_margin")))

    def __call__(self, df: DataFrame, params: DataFrame) -> DataFrame:
        """Add standardised features _z<i>, _margin and pred_prob; folds without parameters drop out."""
        joined = df.join(F.broadcast(params), "fold")  # one row per fold
        return joined.withColumns(self.z).withColumn("_margin", self.margin).withColumn("pred_prob", self.prob)


def _log_sums(fit: dict, x: np.ndarray, missing: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Loss, gradient and half Hessian of the weighted log-likelihood; a row without a label has no loss and no gradient."""
    z = np.column_stack((np.ones(len(y)), (np.where(missing, fit["med"], x) - fit["mu"]) / fit["sd"]))
    margin = z @ fit["beta"]
    with np.errstate(over="ignore"):
        p = 1.0 / (1.0 + np.exp(-margin))
    weight, known = np.where(y == 1, fit["c1"], fit["c0"]), ~np.isnan(y)
    # log(1 + exp(m)) - y*m without overflow
    loss = weight * (np.maximum(margin, 0.0) + np.log1p(np.exp(-np.abs(margin))) - y * margin)
    half = z.T @ (z * (weight * p * (1 - p))[:, None])
    return np.concatenate(([loss[known].sum()], np.where(known, weight * (p - y), 0.0) @ z, half[np.tril_indices(z.shape[1])]))


def fit_folds(train: DataFrame, features: Sequence[str], label: str, medians: dict[tuple[int, str], float], folds: Sequence[int],
              tolerance: float = 1e-9, rounds: int = 200) -> DataFrame:
    """Class-balanced L2 logistic fits of every fold together, by Newton steps; `medians` fill missing features.

    `train` has the columns `_low` and `_high`, the first and last fold a row is in; `folds` are those wanted.  Each step is one
    sum over the training rows: per fold the gradient and the half Hessian, (d+1)(d+4)/2+1 numbers.  Only those sums reach the driver.
    A fold whose training rows have one class is left out, and so is one whose steps
    have not come below `tolerance` after `rounds`: no result stands for an unfinished fit.
    """
    spark = train.sparkSession
    d = len(features)
    fits = {}
    for k, r in _fold_scaling(train, features, label, medians, folds).items():
        if 0 < r["n1"] < r["n"]:
            fits[k] = dict(
                med=r["med"], mu=r["mu"], sd=np.where(r["sd"] == 0, 1.0, r["sd"]), c0=r["n"] / (2.0 * (r["n"] - r["n1"])), c1=r["n"] / (2.0 * r["n1"]),
                beta=np.zeros(d + 1), step=np.zeros(d + 1), loss=np.inf, done=False)
    score = _Scorer(features)

    def table(rows: dict) -> DataFrame:
        return spark.createDataFrame(
            [(k, float(f["c0"]), float(f["c1"]), *map(float, f["beta"]), *map(float, f["med"]), *map(float, f["mu"]), *map(float, f["sd"]))
             for k, f in rows.items()], score.schema)

    for _ in range(rounds):
        open_fits = {k: f for k, f in fits.items() if not f["done"]}
        if not open_fits:
            break
        step = _by_fold(train, features, label, list(open_fits), 1 + (d + 1) * (d + 4) // 2, lambda k, *rows: _log_sums(open_fits[k], *rows))
        for k, told in step.items():
            f = fits[k]
            ridge = np.r_[0.0, np.ones(d)]
            now = told[0] + 0.5 * float(np.sum(ridge * f["beta"] ** 2))
            if now > f["loss"] + 1e-9 * abs(now):
                f["step"] = f["step"] / 2
                f["beta"] = f["beta"] - f["step"]
                continue
            f["loss"] = now
            g = told[1:d + 2] + ridge * f["beta"]
            h = np.zeros((d + 1, d + 1))
            h[np.tril_indices(d + 1)] = told[d + 2:]
            h = h + np.tril(h, -1).T
            h += np.diag(ridge)
            f["step"] = -np.linalg.solve(h, g)
            f["beta"] = f["beta"] + f["step"]
            f["done"] = bool(np.max(np.abs(f["step"])) < tolerance)
    return table({k: f for k, f in fits.items() if f["done"]})


def _together(sizes: Sequence[tuple[int, int]], most: int) -> list[list[tuple[int, int]]]:
    """Neighbouring (fold, rows) in stretches of at most `most` rows, or of one fold."""
    groups, held = [], 0
    for fold, rows in sorted(sizes):
        if not groups or held + rows > most:
            groups.append([])
            held = 0
        groups[-1].append((fold, rows))
        held += rows
    return groups


def _train_scores(spark: SparkSession, train: Callable[[tuple[int, int]], DataFrame], score: Callable[[DataFrame], DataFrame], label: str,
                  sizes: Sequence[tuple[int, int]]) -> list[tuple[int, float, float]]:
    """(fold, accuracy, AUC) on the training rows of each fold; `train` gives those of a stretch of folds.

    The AUC orders the scores of every fold, so each fold's rows are shuffled.  Folds are taken a stretch at a time and its
    shuffle files and tables removed before the next, so that disk holds FOLD_ROWS rows however many folds a row is in.
    """
    told = []
    for group in _together(sizes, setting(spark, FOLD_ROWS)):
        with settings(spark, SHUFFLES_REMOVED), tables_removed(spark):
            rows = score(train((group[0][0], group[-1][0]))).select("fold", label, "pred_prob")
            measured = classifier_metrics(rows, "pred_prob", label, ["fold"], max(n for _, n in group))
            told += [(r["fold"], r["accuracy"], r["roc_auc"]) for r in measured.select("fold", "accuracy", "roc_auc").collect()]  # one row per fold
    return told


def run_backtest(df: DataFrame, cfg: FoldConfig, features: Sequence[str], *, label: str = "builder_hit",
                 ticket: str = "builder_id", odds: str = "decimal_odds", stake: str = "stake",
                 kind: str = "rolling", train_metrics: bool = True) -> tuple[DataFrame, DataFrame]:
    """(results per fold, predictions per ticket and fold) of a rolling or expanding walk-forward test.

    Folds count from 1 over the usable ones; a fold that cannot be fitted keeps
    its number and has no result.  The needed columns are written once to the
    checkpoint folder because every Newton step reads them.  Medians come from counts by day, so no
    exchange holds a row for each fold.  `train_metrics=False` leaves out the
    accuracy and AUC on the training rows, whose scores the AUC has to order.
    """
    spark = df.sparkSession
    needed = df.select(ticket, cfg.date, label, odds, stake, *features).filter(F.col(cfg.date).isNotNull())
    base = stored(needed.sortWithinPartitions(cfg.date))  # a batch then holds few dates
    folds = split_summary(base, cfg, kind).collect()  # one row per fold
    ends = base.agg(F.min(cfg.date).alias("first"), F.max(cfg.date).alias("last")).first()
    bounds = F.struct(F.lit(ends["first"]).cast("date").alias("first"), F.lit(ends["last"]).cast("date").alias("last"))
    number = spark.createDataFrame([(r["slot"], r["fold"] + 1) for r in folds], "slot int, number int")
    usable = F.broadcast(number.select(F.col("slot").alias("fold")))  # one row per fold

    def part(name: str, rows: DataFrame = base, only: tuple[int, int] | None = None) -> DataFrame:
        placed = _with_slots(rows, bounds, cfg, kind, name, only).withColumnRenamed("slot", "fold")
        return placed.join(usable, "fold", "left_semi")

    # Inside the fit a fold goes by its grid slot.
    with settings(spark, SHUFFLES_REMOVED):
        medians = group_medians(base, [cfg.date], features, lambda counts: part("train", counts))
        params = fit_folds(_with_ends(base, bounds, cfg, kind, "train"), features, label, medians, [r["slot"] for r in folds])
    score = _Scorer(features)
    named = F.broadcast(number.withColumnRenamed("slot", "fold"))
    keep = [ticket, cfg.date, "pred_prob", label, odds, stake]
    predictions = score(part("test"), params).join(named, "fold").select(*keep, F.col("number").alias("fold"))
    dates = spark.createDataFrame(
        [(r["fold"] + 1, r["train_size"], r["test_size"], r["train_start"], r["train_end"], r["test_start"], r["test_end"]) for r in folds],
        "fold int, train_n long, test_n long, train_start date, train_end date, test_start date, test_end date")
    measured = predictions.groupBy("fold").agg(*prediction_metrics("pred_prob", label, odds, stake)).join(F.broadcast(dates), "fold")
    if not train_metrics:
        return measured, predictions
    numbers = {r["slot"]: r["fold"] + 1 for r in folds}
    told = _train_scores(spark, lambda only: part("train", base, only), lambda rows: score(rows, params), label, [(r["slot"], r["train_size"]) for r in folds])
    on_train = spark.createDataFrame([(numbers[k], *measures) for k, *measures in told], "fold int, train_accuracy double, train_roc_auc double")
    return measured.join(F.broadcast(on_train), "fold"), predictions


def backtest_summary(results: DataFrame, order: str = "test_start") -> DataFrame:
    """Overall return figures and the linear trend of ROI over the folds, as one row.

    The input has one row per fold, so numbering it in one window is small.
    """
    numbered = results.withColumn("_x", F.row_number().over(Window.orderBy(order)) - 1)
    known = F.col("roi").isNotNull()  # of folds with the same return the first counts
    overall = numbered.agg(
        F.count(F.lit(1)).alias("n_folds"), F.avg("roi").alias("mean_roi"), F.percentile("roi", 0.5).alias("median_roi"),
        F.stddev_samp("roi").alias("std_roi"), F.min("roi").alias("min_roi"), F.max("roi").alias("max_roi"),
        F.sum("profit").alias("total_profit"), F.sum("total_stake").alias("total_stake"),
        F.try_divide(F.sum("profit"), F.sum("total_stake")).alias("overall_roi"),
        F.avg((F.col("roi") > 0).cast("int")).alias("win_rate"),
        F.max_by("fold", F.when(known, F.struct("roi", (-F.col("fold")).alias("first")))).alias("best_fold"),
        F.min_by("fold", F.when(known, F.struct("roi", "fold"))).alias("worst_fold"),
        F.regr_slope("roi", "_x").alias("slope"), F.regr_intercept("roi", "_x").alias("intercept"),
        F.regr_r2("roi", "_x").alias("r_squared"))
    free = (F.col("n_folds") - 2).cast("double")
    p = correlation_p(F.sqrt("r_squared"), F.col("n_folds"))
    tested = overall.withColumn("p_value", F.when((free > 0) & F.col("r_squared").isNotNull(), p))
    return tested.withColumn("significant", F.col("p_value") < 0.05)
