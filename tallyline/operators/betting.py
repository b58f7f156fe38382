"""Returns, calibration, stake sizing, segments and classifier measures of settled tickets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import ratio
from ..functions.ordered import arrange, finish, join_spread, quantiles, running, with_row_frames
from ..session import MAX_GROUP_ROWS, setting, stored
from .windows import profit

METRICS = ("n_obs", "hit_rate", "pred_hit_rate", "roi", "profit", "yield", "sharpe_ratio", "brier", "total_stake")


def return_metrics(hit: str = "builder_hit", odds: str = "decimal_odds", stake: str | Column = "stake") -> list[Column]:
    """Aggregates: roi (0 without stake), profit, yield per bet, sharpe_ratio of unit returns, total_stake."""
    staked = F.col(stake) if isinstance(stake, str) else stake
    won = profit(hit, odds, staked)
    unit = profit(hit, odds, F.lit(1.0))
    return [
        F.coalesce(F.try_divide(F.sum(won), F.sum(staked)), F.lit(0.0)).alias("roi"),
        F.coalesce(F.sum(won), F.lit(0.0)).alias("profit"),
        F.coalesce(F.try_divide(F.sum(won), F.count(F.lit(1))), F.lit(0.0)).alias("yield"),
        F.coalesce(F.try_divide(F.avg(unit), F.stddev_samp(unit)), F.lit(0.0)).alias("sharpe_ratio"),
        F.coalesce(F.sum(staked), F.lit(0.0)).alias("total_stake"),
    ]


def prediction_metrics(prob: str, hit: str = "builder_hit", odds: str = "decimal_odds", stake: str = "stake") -> list[Column]:
    gap = F.col(prob) - F.col(hit)
    return [
        F.count(F.lit(1)).alias("n_obs"), F.avg(hit).alias("hit_rate"), F.avg(prob).alias("pred_hit_rate"),
        F.avg(gap * gap).alias("brier"), *return_metrics(hit, odds, stake),
    ]


def evaluate(df: DataFrame, prob: str, *, keys: Sequence[str] = (), hit: str = "builder_hit",
             odds: str = "decimal_odds", stake: str = "stake") -> DataFrame:
    """All measures in one aggregate, for the whole table or per segment."""
    known = df.dropna(subset=list(keys)) if keys else df
    return known.groupBy(*keys).agg(*prediction_metrics(prob, hit, odds, stake))


def calibration_table(df: DataFrame, prob: str, label: str, n_bins: int = 10, keys: Sequence[str] = ()) -> DataFrame:
    """bin, n, predicted_prob, actual_rate and calibration_error over equal-count bins.

    A value equal to an edge belongs to the lower bin; empty bins are absent.
    """
    edges = {f"e{i}": i / n_bins for i in range(1, n_bins)}
    cuts = quantiles(df, keys, prob, edges).select(*keys, F.array(*edges).alias("_edges"))
    scored = df.filter(F.col(prob).isNotNull()).select(*keys, F.col(prob).alias("_p"), F.col(label).alias("_y"))
    placed = join_spread(scored, cuts, keys) if keys else scored.withColumn("_edges", cuts.scalar())
    binned = placed.withColumn("bin", F.size(F.filter("_edges", lambda e: e < F.col("_p"))))
    table = binned.groupBy(*keys, "bin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("_p").alias("predicted_prob"), F.avg("_y").alias("actual_rate"))
    return table.withColumn("calibration_error", F.col("actual_rate") - F.col("predicted_prob"))


def calibration_error(table: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return table.groupBy(*keys).agg(F.avg(F.abs("calibration_error")).alias("mean_abs_error"))


def _score_counts(df: DataFrame, score: str, label: str, keys: Sequence[str]) -> DataFrame:
    known = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*keys, F.col(score).alias("threshold")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg"))


def roc_points(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), drop_collinear: bool = True) -> DataFrame:
    """threshold, fpr and tpr from the highest score down, after the start (0, 0), which has no threshold.

    Points inside a straight run of equal steps are left out, as plotting libraries do; the first and last stay.
    """
    counts = _score_counts(df, score, label, keys)
    arranged = arrange(counts, keys, [F.col("threshold").desc()])
    ran = finish(running(arranged, {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg"))}))
    sums = counts.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"), F.min("threshold").alias("_last"),
                                     F.max("threshold").alias("_first"))
    whole = ran.join(sums, list(keys)) if keys else ran.withColumn(
        "_s", sums.select(F.struct("p", "q", "_last", "_first")).scalar()).select("*", "_s.*").drop("_s")
    if drop_collinear:
        # Ascending order makes the next lower score the previous row.
        whole = with_row_frames(whole, keys, [F.col("threshold").asc()], lambda w: {
            "_same": (F.lag("pos").over(w) == F.col("pos")) & (F.lag("neg").over(w) == F.col("neg"))}, reach=1)
        corner = (F.col("threshold") == F.col("_last")) | (F.col("threshold") == F.col("_first"))
        whole = whole.filter(corner | ~F.coalesce(F.col("_same"), F.lit(False)))
    points = whole.select(*keys, "threshold", ratio("fp", "q").alias("fpr"), ratio("tp", "p").alias("tpr"))
    start = sums.filter("_last IS NOT NULL").select(*keys, F.lit(None).cast(points.schema["threshold"].dataType).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return points.unionByName(start)


def auc_table(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve: share of (hit, miss) pairs ranked right, ties counting half."""
    counts = _score_counts(df, score, label, keys)
    ran = finish(running(arrange(counts, keys, [F.col("threshold").asc()]), {"below": ("sum", F.col("neg"))}))
    wins = F.sum(F.col("pos") * (F.col("below") - F.col("neg") / 2.0))
    return ran.groupBy(*keys).agg(F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def classifier_metrics(df: DataFrame, prob: str, label: str, keys: Sequence[str] = (), group_rows: int | None = None) -> DataFrame:
    """accuracy, brier, log_loss (probabilities clipped at 1e-7), roc_auc, counts and rates.

    Everything follows from the hits and misses at each score, so the rows are read once.  `group_rows` is a known upper
    bound on the rows of a group; where a group may be too large for a plain window the counts are stored.
    """
    counts = _score_counts(df, prob, label, keys)
    if group_rows is not None and group_rows > setting(df.sparkSession, MAX_GROUP_ROWS):
        counts, group_rows = stored(counts), None
    ran = finish(running(arrange(counts, keys, [F.col("threshold").asc()], group_rows), {"below": ("sum", F.col("neg"))}))
    p, pos, neg = F.col("threshold"), F.col("pos"), F.col("neg")
    n = F.sum(pos + neg)
    clipped = F.greatest(F.least(p, F.lit(1 - 1e-7)), F.lit(1e-7))
    wins = F.sum(pos * (F.col("below") - neg / 2.0))
    return ran.groupBy(*keys).agg(
        (F.sum(F.when(p >= 0.5, pos).otherwise(neg)) / n).alias("accuracy"),
        (F.sum(pos * (1 - p) * (1 - p) + neg * p * p) / n).alias("brier"),
        (F.sum(-pos * F.ln(clipped) - neg * F.ln(1 - clipped)) / n).alias("log_loss"),
        n.alias("n_obs"), (F.sum(pos) / n).alias("positive_rate"),
        (F.sum(F.when(p >= 0.5, pos + neg).otherwise(0)) / n).alias("pred_positive_rate"),
        F.try_divide(wins, F.sum("pos").cast("double") * F.sum("neg")).alias("roc_auc"))


def confusion_counts(df: DataFrame, prob: str, label: str) -> DataFrame:
    return df.groupBy(F.col(label).alias("actual"), (F.col(prob) >= 0.5).cast("int").alias("predicted")).agg(
        F.count(F.lit(1)).alias("rows"))


def class_report(df: DataFrame, prob: str, label: str) -> DataFrame:
    """precision, recall, f1 and support of classes 0 and 1 from the four confusion counts."""
    cells = confusion_counts(df, prob, label)
    per = cells.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("label"), F.col("rows"), (F.col("actual") == c).alias("is"), (F.col("predicted") == c).alias("said"))
        for c in (0, 1)])).alias("r")).select("r.*")
    both = F.sum(F.when(F.col("is") & F.col("said"), F.col("rows")).otherwise(0))
    actual, said = F.sum(F.when(F.col("is"), F.col("rows")).otherwise(0)), F.sum(F.when(F.col("said"), F.col("rows")).otherwise(0))
    zero = F.lit(0.0)
    return per.groupBy("label").agg(
        F.coalesce(F.try_divide(both.cast("double"), said), zero).alias("precision"),
        F.coalesce(F.try_divide(both.cast("double"), actual), zero).alias("recall"),
        F.coalesce(F.try_divide(2.0 * both, said + actual), zero).alias("f1"), actual.alias("support"))


def stake_sizing(df: DataFrame, prob: str, *, hit: str = "builder_hit", odds: str = "decimal_odds",
                 kelly_fraction: float = 0.25) -> DataFrame:
    """roi, profit, sharpe, avg_stake and max_stake of four staking rules, stakes scaled to sum to n.

    Profit is linear in the stake, so scaling happens after one pass of sums.
    """
    p, b = F.col(prob), F.col(odds) - 1.0
    kelly = F.greatest(F.coalesce(F.try_divide(b * p - (1 - p), b), F.lit(0.0)), F.lit(0.0))
    rules = {"unit_stake": F.lit(1.0), "full_kelly": kelly, "fractional_kelly": kelly * kelly_fraction,
             "probability_weighted": p}
    unit = profit(hit, odds, F.lit(1.0))
    rows = df.select(unit.alias("unit"), F.explode(F.array(*[
        F.struct(F.lit(n).alias("strategy"), s.cast("double").alias("stake")) for n, s in rules.items()])).alias("r")
    ).select("unit", "r.*")
    sums = rows.groupBy("strategy").agg(
        F.count(F.lit(1)).alias("n"), F.sum("stake").alias("staked"), F.sum(F.col("stake") * F.col("unit")).alias("won"),
        F.max("stake").alias("top"),
        F.coalesce(F.try_divide(F.avg("unit"), F.stddev_samp("unit")), F.lit(0.0)).alias("sharpe"))
    scale = F.when(F.col("staked") > 0, F.col("n") / F.col("staked")).otherwise(1.0)
    return sums.select(
        "strategy", F.coalesce(F.try_divide("won", "staked"), F.lit(0.0)).alias("roi"),
        (F.col("won") * scale).alias("profit"), "sharpe",
        (F.col("staked") * scale / F.col("n")).alias("avg_stake"), (F.col("top") * scale).alias("max_stake"))
