"""Ticket-outcome model: train, save, predict, explain."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.exprs import unpivot
from ..functions.selection import group_medians
from ..session import stored
from .betting import classifier_metrics
from .folds import fit_folds

# The default inputs.  The two edge features are computed from the
# realised result, so they leak the outcome; use PRE_GAME_FEATURES to avoid that.
FEATURES = ("n_legs", "mean_abs_edge", "max_abs_edge", "book_implied_prob")
PRE_GAME_FEATURES = ("n_legs", "book_implied_prob", "pct_over", "n_unique_players", "n_unique_stats")


def train(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "builder_hit") -> PipelineModel:
    """Median fill, standardising, class-balanced L2 logistic regression (C = 1); a model that Spark ML can save and load.

    The training columns are written once to the checkpoint folder, since medians, scaling and every Newton step read
    them.  Newton steps on grouped sums end below 1e-9 also for nearly collinear features, where a line search on the
    loss stops at some 1e-6.
    """
    missing = sorted(set(features) - set(df.columns))
    if missing:
        raise ValueError(f"missing features {missing}")
    data = stored(df.select(*[F.col(f).cast("double").alias(f) for f in features], F.col(label).cast("double").alias(label)))
    classes = data.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n1")).first()
    if not 0 < classes["n1"] < classes["n"]:
        raise ValueError("training rows hold one class only")

    def one_fold(rows: DataFrame) -> DataFrame:
        return rows.withColumn("fold", F.lit(0))

    whole = data.withColumns({"_low": F.lit(0), "_high": F.lit(0)})
    fit = fit_folds(whole, features, label, group_medians(data, [], features, one_fold), [0]).first()
    if fit is None:
        raise ArithmeticError("the outcome model did not converge")
    scaled = ", ".join(
        f"(coalesce(cast(`{f}` as double), {fit[f'_m{i}']!r}D) - {fit[f'_u{i}']!r}D) / {fit[f'_s{i}']!r}D AS `z_{f}`" for i, f in enumerate(features))
    margin = " + ".join([f"{fit['_b']!r}D", *(f"{fit[f'_w{i}']!r}D * `z_{f}`" for i, f in enumerate(features))])
    statements = (f"*, {scaled}", f"*, {margin} AS margin", "*, 1 / (1 + exp(-margin)) AS pred_prob")
    return PipelineModel([SQLTransformer(statement=f"SELECT {x} FROM __THIS__") for x in statements])


def model_table(model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """(feature, coefficient, fill, mean, spread): the model as rows; the intercept is the row without a feature.

    The numbers are read off the model itself: what it makes of all features at zero, of one at one, of one missing.
    """
    spark = SparkSession.active()
    probes = [{}, *({f: 1.0} for f in features), *({f: None} for f in features)]
    rows = [(i, *(p.get(f, 0.0) for f in features)) for i, p in enumerate(probes)]
    frame = spark.createDataFrame(rows, ", ".join(["probe int", *(f"`{f}` double" for f in features)]))
    seen = {r["probe"]: r for r in model.transform(frame).collect()}  # two rows per feature
    out, intercept = [], seen[0]["margin"]
    for i, f in enumerate(features):
        z = f"z_{f}"
        spread = 1.0 / (seen[1 + i][z] - seen[0][z])
        mean, weight = -seen[0][z] * spread, (seen[1 + i]["margin"] - seen[0]["margin"]) * spread
        intercept -= weight * seen[0][z]
        out.append((f, weight, mean + seen[1 + len(features) + i][z] * spread, mean, spread))
    return spark.createDataFrame([(None, intercept, None, None, None), *out], "feature string, coefficient double, fill double, mean double, spread double")


def coefficients(model: PipelineModel, features: Sequence[str] = FEATURES) -> DataFrame:
    """feature, coefficient, abs_coefficient, largest first; one row per feature."""
    return model_table(model, features).filter("feature IS NOT NULL").select(
        "feature", "coefficient", F.abs("coefficient").alias("abs_coefficient")).orderBy(F.col("abs_coefficient").desc(), "feature")


def predict(model: PipelineModel, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The input rows with pred_prob and pred_hit."""
    return model.transform(df).select(*df.columns, "pred_prob", (F.col("pred_prob") >= threshold).cast("int").alias("pred_hit"))


def predict_from_table(table: DataFrame, df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """`predict` by a model stored as rows, such as one read from Parquet: no fitted object is needed.

    The table has one row per feature and becomes one row of maps; a missing value takes its fill.
    """
    known = table.filter("feature IS NOT NULL")
    features = [r["feature"] for r in known.select("feature").collect()]
    entry = F.when(F.col("feature").isNotNull(), F.struct("feature", F.struct("coefficient", "fill", "mean", "spread")))
    whole = table.agg(F.struct(F.map_from_entries(F.collect_list(entry)).alias("m"), F.max(F.when(F.col("feature").isNull(), F.col("coefficient"))).alias("b")).alias("model"))
    placed = df.withColumn("_model", whole.scalar())
    margin = F.col("_model.b")
    for f in features:
        part = F.col("_model.m")[f]
        margin = margin + part["coefficient"] * (F.coalesce(F.col(f"`{f}`").cast("double"), part["fill"]) - part["mean"]) / part["spread"]
    prob = 1.0 / (1.0 + F.exp(-margin))
    return placed.withColumn("pred_prob", prob).select(*df.columns, "pred_prob", (F.col("pred_prob") >= threshold).cast("int").alias("pred_hit"))


def evaluate_model(model: PipelineModel, df: DataFrame, label: str = "builder_hit") -> DataFrame:
    return classifier_metrics(predict(model, df), "pred_prob", label)


def feature_impact(model: PipelineModel, df: DataFrame, features: Sequence[str] = FEATURES) -> DataFrame:
    """Coefficients with mean, std, min and max of each feature, largest first."""
    stats = unpivot(df, [], features, "feature", "value").groupBy("feature").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    return coefficients(model, features).join(stats, "feature").orderBy(F.col("abs_coefficient").desc(), "feature")
