"""The wager workflow from files to tables: each step reads stored tables and writes stored tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..operators import counts, dependence, legs as leg_ops, outcome
from ..operators.cleaning import context_features
from ..operators.folds import FoldConfig, backtest_summary, run_backtest
from ..sources import checks, readers
from ..sources.readers import read_table
from ..sources.writers import key_values, write_model, write_report, write_table


def prepare(spark: SparkSession, logs_csv: str, lines_csv: str, legs_csv: str, out: str, book: str | None = None) -> DataFrame:
    """player_games, ticket_legs and tickets; returns the run summary.

    The files are parsed once and stored as Parquet before any operator reads them.  Facts
    are stored by date, so later date ranges read only their partitions.
    """
    def parsed(name: str, df: DataFrame) -> DataFrame:
        write_table(df, f"{out}/{name}")
        return read_table(spark, f"{out}/{name}")

    logs = parsed("input_logs", readers.read_game_logs(spark, logs_csv))
    lines = parsed("input_lines", readers.read_quoted_lines(spark, lines_csv))
    bets = parsed("input_legs", readers.read_ticket_legs(spark, legs_csv))
    write_table(context_features(logs), f"{out}/player_games", ["game_date"])
    games = read_table(spark, f"{out}/player_games")
    write_table(leg_ops.leg_table(bets, games, lines, book=book), f"{out}/ticket_legs", ["game_date"])
    write_table(leg_ops.ticket_table(read_table(spark, f"{out}/ticket_legs")), f"{out}/tickets")
    write_table(checks.consistency_counts(logs, bets), f"{out}/consistency")
    return checks.run_summary(games, read_table(spark, f"{out}/tickets"))


def price_lines(spark: SparkSession, tables: str, lines: DataFrame, out: str, *, min_games: int = 20, min_edge: float = 0.05) -> None:
    """distribution_models, tail_probabilities and value_bets."""
    games = read_table(spark, f"{tables}/player_games")
    write_table(counts.attach_count_models(counts.distribution_summary(games, min_games=min_games)), f"{out}/distribution_models")
    write_table(counts.line_tail_probabilities(read_table(spark, f"{out}/distribution_models"), lines), f"{out}/tail_probabilities")
    write_table(counts.value_bets(read_table(spark, f"{out}/tail_probabilities"), min_edge=min_edge), f"{out}/value_bets")


def measure_dependence(spark: SparkSession, tables: str, out: str, *, min_games: int = 20, method: str = "spearman", threshold: float = 0.7) -> None:
    """player_correlations, global_correlations, correlation_summary, correlation_comparison and high_correlations."""
    games = read_table(spark, f"{tables}/player_games")
    write_table(dependence.entity_correlations(games, min_games=min_games, method=method), f"{out}/player_correlations")
    write_table(dependence.global_correlation(games, method=method), f"{out}/global_correlations")
    per, whole = read_table(spark, f"{out}/player_correlations"), read_table(spark, f"{out}/global_correlations")
    write_table(dependence.correlation_summary(per), f"{out}/correlation_summary")
    write_table(dependence.compare_with_global(per, whole), f"{out}/correlation_comparison")
    write_table(dependence.high_correlation_pairs(per, threshold), f"{out}/high_correlations")


def fit_outcome(spark: SparkSession, tables: str, out: str, features: Sequence[str] = outcome.FEATURES) -> PipelineModel:
    """The model with its metrics, feature_importance and feature_analysis."""
    tickets = read_table(spark, f"{tables}/tickets")
    model = outcome.train(tickets, features)
    write_model(model, f"{out}/model")
    write_table(outcome.evaluate_model(model, tickets), f"{out}/metrics")
    write_table(outcome.coefficients(model, features), f"{out}/feature_importance")
    write_table(outcome.feature_impact(model, tickets, features), f"{out}/feature_analysis")
    return model


def backtest(spark: SparkSession, tables: str, out: str, cfg: FoldConfig = FoldConfig(min_train=500), features: Sequence[str] = outcome.FEATURES,
             kind: str = "rolling") -> DataFrame:
    """fold_results, predictions and a key/value analysis report; returns the summary row."""
    results, predictions = run_backtest(read_table(spark, f"{tables}/tickets"), cfg, features, kind=kind)
    write_table(results, f"{out}/fold_results")
    write_table(predictions, f"{out}/predictions")
    summary = backtest_summary(read_table(spark, f"{out}/fold_results"))
    trend = ["slope", "intercept", "r_squared", "p_value", "significant"]
    write_report(key_values(summary.drop(*trend), "overall").unionByName(key_values(summary.select(*trend), "trend")), f"{out}/analysis")
    return summary
