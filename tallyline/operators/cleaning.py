"""Row-wise cleaning, context features and activity filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.exprs import flag, ratio_or_zero, unpivot
from ..functions.ordered import quantiles, row_numbers
from .windows import rest_days

# Source column names and the short stat names derived from them.
SEASON_STATS = {
    "points": "PTS", "assists": "AST", "reboundsTotal": "REB", "threePointersMade": "FG3M",
    "steals": "STL", "blocks": "BLK", "turnovers": "TOV", "fieldGoalsMade": "FGM",
    "fieldGoalsAttempted": "FGA", "threePointersAttempted": "FG3A", "freeThrowsMade": "FTM",
    "freeThrowsAttempted": "FTA", "plusMinusPoints": "PLUS_MINUS", "numMinutes": "MIN",
}


def date_parts(df: DataFrame, timestamp: str) -> DataFrame:
    """game_date_only, day_of_week (English name), month and ISO week."""
    day = F.to_date(timestamp)
    return df.withColumns({
        "game_date_only": day,
        "day_of_week": F.date_format(day, "EEEE"),
        "month": F.month(day),
        "week": F.weekofyear(day),
    })


def guarded_ratios(df: DataFrame, ratios: Mapping[str, tuple[str, str]]) -> DataFrame:
    """name -> (numerator, denominator); 0 where the denominator is not positive or missing."""
    return df.withColumns({name: ratio_or_zero(num, den) for name, (num, den) in ratios.items()})


def clean_season(df: DataFrame, min_minutes: float = 5.0) -> DataFrame:
    """Names, date parts, short stat names, percentages and per-minute rates; rows under
    `min_minutes` are dropped.  Everything is one projection over one scan."""
    named = date_parts(df, "gameDate").withColumns({
        "player_name": F.concat("firstName", F.lit(" "), "lastName"),
        "player_team": F.concat("playerteamCity", F.lit(" "), "playerteamName"),
        "opponent_team": F.concat("opponentteamCity", F.lit(" "), "opponentteamName"),
        "win": F.col("win").cast("boolean"),
        "home": F.col("home").cast("boolean"),
        "minutes_played": F.col("numMinutes"),
        **{new: F.col(old) for old, new in SEASON_STATS.items() if old in df.columns},
    })
    rated = guarded_ratios(named, {
        "FG_PCT": ("FGM", "FGA"), "FG3_PCT": ("FG3M", "FG3A"), "FT_PCT": ("FTM", "FTA"),
        "PTS_PER_MIN": ("PTS", "minutes_played"), "AST_PER_MIN": ("AST", "minutes_played"),
        "REB_PER_MIN": ("REB", "minutes_played"),
    })
    return rated.filter(F.col("minutes_played") >= min_minutes)


def home_flag(df: DataFrame, column: str = "home_away") -> DataFrame:
    """is_home 1/0 from 'H'; NULL throughout when the column is absent."""
    value = flag(F.col(column) == "H") if column in df.columns else F.lit(None).cast("int")
    return df.withColumn("is_home", value)


def context_features(df: DataFrame, *, entity: str = "player_id", date: str = "game_date",
                     tiebreak: str = "game_id") -> DataFrame:
    return rest_days(home_flag(df), entity=entity, date=date, tiebreak=tiebreak)


def active_entities(df: DataFrame, *, entity: str = "player_id", min_games: int = 20,
                    minutes: str = "minutes", min_minutes: float = 5.0) -> DataFrame:
    """Rows of entities with enough rows and, if minutes are known, a high enough mean."""
    aggs = [F.count(F.lit(1)).alias("_games")]
    keep = F.col("_games") >= min_games
    if minutes in df.columns:
        aggs.append(F.avg(minutes).alias("_minutes"))
        keep = keep & (F.col("_minutes") >= min_minutes)
    chosen = df.dropna(subset=[entity]).groupBy(entity).agg(*aggs).filter(keep).select(entity)
    return df.join(chosen, entity, "left_semi")


def impute(df: DataFrame, strategy: str = "median", columns: Sequence[str] | None = None) -> DataFrame:
    """Fill missing numbers with the column's median, mean or 0, or drop those rows."""
    if columns is None:
        columns = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    columns = [c for c in columns if c in df.columns]
    if strategy == "drop":
        return df.dropna(subset=columns)
    if strategy == "zero":
        return df.fillna(0, subset=columns)
    if strategy == "mean":
        means = df.agg(*[F.avg(c).alias(c) for c in columns]).first()
        fills = {c: means[c] for c in columns}
    elif strategy == "median":
        medians = quantiles(unpivot(df, [], columns, "column", "value"), ["column"], "value", {"median": 0.5})
        fills = {r["column"]: r["median"] for r in medians.collect()}  # one row per column
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    known = {c: v for c, v in fills.items() if v is not None}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(v)) for c, v in known.items()})


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """<column>_code: the position of each value among the sorted distinct values, -1 when missing.

    Storage needs no such marking (Parquet keeps a dictionary); codes are for models.
    """
    for c in [c for c in columns if c in df.columns]:
        values = df.filter(F.col(c).isNotNull()).select(c).distinct()
        codes = row_numbers(values, [], [F.col(c).asc()], f"{c}_code").withColumn(f"{c}_code", F.col(f"{c}_code") - 1)
        df = df.join(codes, c, "left").withColumn(f"{c}_code", F.coalesce(f"{c}_code", F.lit(-1)))
    return df


def attempt_filter(df: DataFrame, percentage: str, attempts: str | None, min_attempts: int) -> DataFrame:
    """Rows of a percentage stat with enough attempts and a non-zero value."""
    kept = df.filter(F.col(percentage).isNotNull() & (F.col(percentage) > 0))
    return kept if attempts is None else kept.filter(F.col(attempts) >= min_attempts)


def attempt_filter_summary(df: DataFrame, stats: Mapping[str, tuple[str, int]]) -> DataFrame:
    """stat, original_n, low_attempts_removed, zeros_removed, final_n, pct_filtered; one scan."""
    rows = df.select(F.explode(F.array(*[
        F.struct(F.lit(stat).alias("stat"), F.col(stat).cast("double").alias("value"),
                 (F.col(tries) >= floor).alias("enough"))
        for stat, (tries, floor) in stats.items()
    ])).alias("r")).select("r.*").filter(F.col("value").isNotNull())
    enough = F.coalesce(F.col("enough"), F.lit(False))
    counted = rows.groupBy("stat").agg(
        F.count(F.lit(1)).alias("original_n"),
        F.count_if(~enough).alias("low_attempts_removed"),
        F.count_if(enough & (F.col("value") == 0)).alias("zeros_removed"),
    )
    final = F.col("original_n") - F.col("low_attempts_removed") - F.col("zeros_removed")
    return counted.withColumn("final_n", final).withColumn(
        "pct_filtered", (F.col("original_n") - F.col("final_n")) / F.col("original_n") * 100.0
    )


def date_range(df: DataFrame, date: str, start=None, end=None) -> DataFrame:
    """Rows between two dates, both included; a partition filter on a date-partitioned table."""
    if start is not None:
        df = df.filter(F.col(date) >= F.lit(start).cast("date"))
    if end is not None:
        df = df.filter(F.col(date) <= F.lit(end).cast("date"))
    return df


def find_entities(df: DataFrame, name: str, text: str) -> DataFrame:
    """Distinct names equal to (match_rank 0) or containing (match_rank 1) the text, any case."""
    needle = text.lower()
    names = df.select(name).filter(F.lower(name).contains(needle)).distinct()
    return names.withColumn("match_rank", F.when(F.lower(name) == needle, 0).otherwise(1)).orderBy("match_rank", name)
