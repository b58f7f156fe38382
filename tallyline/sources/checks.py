"""Profiles, cross-table checks and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation, functions as F


def column_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """column, type, non_null, nulls, distinct - one scan.

    Distinct counting goes through (column, value) rows combined before the
    shuffle, so neither a wide table nor a hot value gathers in one task.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    cells = df.select(F.explode(F.array(*[
        # Adding zero makes -0.0 the same value as 0.0.
        F.struct(F.lit(c).alias("column"), F.lit(types[c]).alias("type"),
                 (F.col(c) + 0.0 if types[c] in ("double", "float") else F.col(c)).cast("string").alias("value"))
        for c in columns
    ])).alias("cell")).select("cell.*")
    counted = cells.groupBy("column", "type", "value").agg(F.count(F.lit(1)).alias("rows"))
    return counted.groupBy("column", "type").agg(
        F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("rows"))), F.lit(0)).alias("non_null"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("rows"))), F.lit(0)).alias("nulls"),
        F.count("value").alias("distinct"),
    )


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of `left` that `right` does not have."""
    return (
        left.select(key).dropna().distinct()
        .join(right.select(key).dropna().distinct(), key, "left_anti")
    )


def consistency_counts(
    games: DataFrame, legs: DataFrame, *, game: str = "game_id", player: str = "player_id",
    ticket: str = "builder_id", date: str = "game_date",
) -> DataFrame:
    """One (check, value) row per count or date bound; the caller decides what is acceptable.

    Each table is read once: its keys become narrow (kind, key) rows, combined before they move.
    """
    def cells(df: DataFrame, side: str, kinds: dict[str, str]) -> DataFrame:
        rows = df.select(F.explode(F.array(*[
            F.struct(F.lit(kind).alias("kind"), F.col(c).cast("string").alias("key")) for kind, c in kinds.items()])).alias("c"))
        return rows.select("c.*", F.lit(side).alias("side")).filter("key IS NOT NULL")

    both = cells(games, "logs", {"games": game, "players": player, "dates": date}).unionByName(
        cells(legs, "tickets", {"games": game, "players": player, "tickets": ticket, "dates": date}))
    keys = both.groupBy("kind", "key").agg(F.bool_or(F.col("side") == "logs").alias("logs"), F.bool_or(F.col("side") == "tickets").alias("tickets"))
    kind, logs, bets = F.col("kind"), F.col("logs"), F.col("tickets")
    checks = {
        "games_missing_from_logs": F.count_if((kind == "games") & ~logs), "players_missing_from_logs": F.count_if((kind == "players") & ~logs),
        "n_games_logs": F.count_if((kind == "games") & logs), "n_games_tickets": F.count_if((kind == "games") & bets),
        "n_players_logs": F.count_if((kind == "players") & logs), "n_players_tickets": F.count_if((kind == "players") & bets),
        "n_tickets": F.count_if(kind == "tickets"),
        "first_date_logs": F.min(F.when((kind == "dates") & logs, F.col("key"))), "last_date_logs": F.max(F.when((kind == "dates") & logs, F.col("key"))),
        "first_date_tickets": F.min(F.when((kind == "dates") & bets, F.col("key"))), "last_date_tickets": F.max(F.when((kind == "dates") & bets, F.col("key"))),
    }
    one = keys.agg(*[value.cast("string").alias(name) for name, value in checks.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("value")) for n in checks])).alias("r")).select("r.*")


def invalid_odds(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """How many odds are below 1.0 in each column (they are kept in the data)."""
    counts = df.agg(*[F.count_if(F.col(c) < 1.0).alias(c) for c in columns])
    return counts.unpivot([], list(columns), "column", "n_invalid")


def observe_invalid_odds(df: DataFrame, columns: Sequence[str], name: str = "invalid_odds") -> tuple[DataFrame, Observation]:
    """The same counts gathered while another action reads the rows; no extra scan."""
    seen = Observation(name)
    return df.observe(seen, *[F.count_if(F.col(c) < 1.0).alias(c) for c in columns]), seen


def run_summary(logs: DataFrame, tickets: DataFrame) -> DataFrame:
    """Games, players, tickets, legs, mean legs per ticket and hit rate as (metric, value)."""
    kept = logs.agg(F.count_distinct("game_id").cast("double").alias("n_games"), F.count_distinct("player_id").cast("double").alias("n_players"))
    rolled = tickets.agg(
        F.count(F.lit(1)).cast("double").alias("n_tickets"),
        F.sum("n_legs").cast("double").alias("n_legs"),
        F.avg("n_legs").alias("mean_legs"),
        F.avg("builder_hit").alias("hit_rate"),
    )
    return kept.unpivot([], kept.columns, "metric", "value").unionByName(rolled.unpivot([], rolled.columns, "metric", "value"))
