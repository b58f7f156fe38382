"""Season, team, split and daily aggregates, consistency, line hit rates and rankings.

Column names are arguments: `measures` maps an output name to the input column.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import first_known, flag, ratio, round_half_even, unpivot
from ..functions.ordered import cumulative_counts, join_spread, quantiles_of_counts

# The averages reported per player and the input stat of each.
PLAYER_AVERAGES = {
    "PPG": "PTS", "APG": "AST", "RPG": "REB", "FG3M_PG": "FG3M", "SPG": "STL", "BPG": "BLK", "TPG": "TOV",
    "MPG": "minutes_played", "FG_PCT": "FG_PCT", "FG3_PCT": "FG3_PCT", "FT_PCT": "FT_PCT",
    "WIN_PCT": "win", "HOME_PCT": "home", "AVG_PLUS_MINUS": "PLUS_MINUS",
}
# Stat, the name of its average, and the average a consistent player needs.
CONSISTENCY_FLOORS = {"PTS": ("PPG", 10.0), "AST": ("APG", 3.0), "REB": ("RPG", 5.0), "FG3M": ("FG3M_PG", 2.0)}


def _mean(column: str) -> Column:
    """Average of a number or a boolean."""
    return F.avg(F.col(column).cast("double"))


def player_season(df: DataFrame, *, entity: str = "player_name", entity_id: str = "personId", game: str = "gameId",
                  team: str | None = "player_team", order: Sequence[str] = ("game_date_only", "gameId"),
                  averages: Mapping[str, str] = PLAYER_AVERAGES, spread: Mapping[str, str] | None = None,
                  composites: Mapping[str, Sequence[str]] | None = None, min_games: int = 10) -> DataFrame:
    """Season line per player from one grouping.

    Averages are rounded to 2 places before the game filter and before anything
    derived from them.  `spread` maps a stat to the average its CV divides by and
    adds <stat>_STD and <stat>_CV.  `team` adds the most frequent team.
    """
    aggs = [first_known(entity_id, F.struct(*order)).alias("player_id"), F.count(game).alias("games_played")]
    aggs += [round_half_even(_mean(c), 2).alias(n) for n, c in averages.items()]
    spread = spread or {}
    aggs += [round_half_even(F.stddev_samp(s), 2).alias(f"{s}_STD") for s in spread]
    if team is not None:
        aggs.append(F.mode(team, True).alias("team"))
    season = df.filter(F.col(entity).isNotNull()).groupBy(entity).agg(*aggs).filter(F.col("games_played") >= min_games)
    if composites is None:
        composites = {"PTS_AST": ("PPG", "APG"), "PTS_REB": ("PPG", "RPG"), "PTS_AST_REB": ("PPG", "APG", "RPG")}
    derived = {}
    for name, parts in composites.items():
        total = F.col(parts[0])
        for p in parts[1:]:
            total = total + F.col(p)
        derived[name] = total
    derived.update({f"{s}_CV": round_half_even(ratio(f"{s}_STD", avg), 3) for s, avg in spread.items()})
    return season.withColumns(derived) if derived else season


def team_season(df: DataFrame, *, team: str = "player_team", entity_id: str = "personId", game: str = "gameId",
                averages: Mapping[str, str], rank_by: str = "win_rate") -> DataFrame:
    """Player-games, rounded averages and distinct players per team, best first."""
    return (
        df.filter(F.col(team).isNotNull()).groupBy(team)
        .agg(F.count(game).alias("total_player_games"),
             *[round_half_even(_mean(c), 2).alias(n) for n, c in averages.items()],
             F.count_distinct(entity_id).alias("unique_players"))
        .orderBy(F.col(rank_by).desc_nulls_last(), team)
    )


def split_profile(df: DataFrame, by: str, averages: Mapping[str, str], *, game: str = "gameId",
                  labels: tuple[str, str] = ("Away", "Home"), digits: int = 3) -> DataFrame:
    """One row per side of a boolean column plus a difference row (true side - false side).

    The difference comes from the two rounded rows and appears when both exist.
    """
    sides = df.filter(F.col(by).isNotNull()).groupBy(by).agg(
        F.count(game).cast("double").alias("games"),
        *[round_half_even(_mean(c), digits).alias(n) for n, c in averages.items()])
    names = ["games", *averages]
    named = sides.select(F.when(F.col(by), labels[1]).otherwise(labels[0]).alias("side"), *names)
    gap = sides.agg(
        F.count(F.lit(1)).alias("_sides"),
        *[(F.max(F.when(F.col(by), F.col(n))) - F.max(F.when(~F.col(by), F.col(n)))).alias(n) for n in names],
    ).filter("_sides = 2").select(F.lit("Difference").alias("side"), *names)
    return named.unionByName(gap)


def weekday_profile(df: DataFrame, date: str, averages: Mapping[str, str], *, game: str = "gameId") -> DataFrame:
    """Monday to Sunday."""
    grouped = df.filter(F.col(date).isNotNull()).groupBy(
        F.weekday(date).alias("day_index"), F.date_format(date, "EEEE").alias("day_of_week"))
    return grouped.agg(F.count(game).alias("games"),
                       *[round_half_even(_mean(c), 2).alias(n) for n, c in averages.items()]).orderBy("day_index")


def daily_series(df: DataFrame, date: str, averages: Mapping[str, str], *, game: str = "gameId") -> DataFrame:
    return df.filter(F.col(date).isNotNull()).groupBy(date).agg(
        F.count(game).alias("games"), *[_mean(c).alias(n) for n, c in averages.items()])


def season_summary(df: DataFrame, *, game: str, entity: str, team: str, date: str, measures: Sequence[str],
                   win: str = "win", home: str = "home") -> DataFrame:
    """The headline figures as (metric, value) text rows, from one scan."""
    w = F.col(win).cast("double")
    one = df.agg(
        *[F.count_distinct(c).cast("string").alias(name) for name, c in (("games", game), ("players", entity), ("teams", team))],
        F.min(date).cast("string").alias("first_date"), F.max(date).cast("string").alias("last_date"),
        *[F.format_string("%.2f", F.avg(m)).alias(f"avg_{m}") for m in measures],
        F.format_string("%.1f", F.avg(w) * 100).alias("win_rate_pct"),
        F.format_string("%.1f", F.avg(F.when(F.col(home), w)) * 100).alias("home_win_rate_pct"),
        F.format_string("%.1f", F.avg(F.when(~F.col(home), w)) * 100).alias("away_win_rate_pct"))
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias("value")) for n in one.columns])).alias("r")).select("r.*")


def modal_team(df: DataFrame, *, entity: str = "player_name", team: str = "player_team") -> DataFrame:
    """The most frequent team per player, the smallest name on a tie.

    Counted by (player, team) first, so a player's rows are never gathered.
    """
    counts = df.dropna(subset=[entity, team]).groupBy(entity, team).agg(F.count(F.lit(1)).alias("rows"))
    return counts.groupBy(entity).agg(F.min_by(team, F.struct(-F.col("rows"), F.col(team))).alias("team"))


def prop_candidates(season: DataFrame, min_games: int = 20, floor: tuple[str, float] = ("PPG", 15.0)) -> DataFrame:
    return season.filter((F.col("games_played") >= min_games) & (F.col(floor[0]) >= floor[1]))


def elite_consistency(season: DataFrame, stats: Sequence[str] = ("PTS", "AST", "REB", "FG3M"),
                      min_games: int = 15, max_cv: float = 0.40) -> DataFrame:
    keep = F.col("games_played") >= min_games
    for s in stats:
        keep = keep & (F.col(f"{s}_CV") < max_cv)
    return season.filter(keep)


def consistent_by_stat(season: DataFrame, floors: Mapping[str, tuple[str, float]] = CONSISTENCY_FLOORS, *,
                       entity: str = "player_name", min_games: int = 15, max_cv: float = 0.40, top: int = 20) -> DataFrame:
    """The `top` averages per stat among low-CV players, as (stat, player, games, average, std, cv)."""
    rows = season.select(entity, "games_played", F.explode(F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(avg).alias("average"), F.lit(float(least)).alias("floor"),
                 F.col(f"{s}_STD").alias("std"), F.col(f"{s}_CV").alias("cv"))
        for s, (avg, least) in floors.items()])).alias("r")).select(entity, "games_played", "r.*")
    kept = rows.filter((F.col("games_played") >= min_games) & (F.col("average") >= F.col("floor"))
                       & (F.col("cv") < max_cv)).drop("floor")
    return top_per_group(kept, ["stat"], [F.col("average").desc(), F.col(entity).asc()], top)


def consistency_band(cv: str | Column) -> Column:
    """consistent under .40, mid under .60, otherwise (or unknown) poor."""
    c = F.col(cv) if isinstance(cv, str) else cv
    return F.when(c < 0.40, "consistent").when(c < 0.60, "mid").otherwise("poor")


def line_hit_rates(df: DataFrame, season: DataFrame, stats: Mapping[str, str], *, entity: str = "player_name",
                   offsets: Sequence[float] = (-10, -5, 5, 10), min_games: int = 10) -> DataFrame:
    """% of a player's rows above (rounded average + offset), as (entity, team, games, stat, average, offset, hit_rate).

    The season table joins back once, spread over salts, and every line is a
    conditional average in one grouping: rows are neither multiplied nor re-read per line.
    """
    known = season.select(entity, *(["team"] if "team" in season.columns else []),
                          *[F.col(avg).alias(f"_avg_{s}") for s, avg in stats.items()])
    joined = join_spread(df.select(entity, *stats), known, [entity])
    rate = {}
    for s in stats:
        usable = F.col(f"_avg_{s}").isNotNull() & (F.col(f"_avg_{s}") != 0)
        for i, o in enumerate(offsets):
            rate[f"_r_{s}_{i}"] = F.avg(F.when(usable, flag(F.col(s) > F.col(f"_avg_{s}") + float(o)))) * 100.0
    carried = [F.first(c).alias(c) for c in known.columns if c != entity]
    grouped = joined.groupBy(entity).agg(F.count(F.lit(1)).alias("games"), *carried,
                                         *[c.alias(n) for n, c in rate.items()]).filter(F.col("games") >= min_games)
    cells = F.array(*[
        F.struct(F.lit(s).alias("stat"), F.col(f"_avg_{s}").alias("average"), F.lit(float(o)).alias("offset"),
                 F.col(f"_r_{s}_{i}").alias("hit_rate"))
        for s in stats for i, o in enumerate(offsets)])
    keep = [c for c in (entity, "team", "games") if c in grouped.columns]
    return grouped.select(*keep, F.explode(cells).alias("c")).select(*keep, "c.*")


def league_line_summary(rates: DataFrame) -> DataFrame:
    return rates.groupBy("stat", "offset").agg(F.avg("hit_rate").alias("hit_rate"))


def top_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int, rank: str | None = None) -> DataFrame:
    """First n rows per group; Spark keeps n per group before the shuffle, so hot groups stay small."""
    name = rank or "_rank"
    ranked = df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col(name) <= n)
    return ranked if rank else ranked.drop(name)


def top_by_team(rates: DataFrame, *, entity: str = "player_name", n: int = 15) -> DataFrame:
    """Per team, stat and line the n best averages."""
    return top_per_group(rates, ["team", "stat", "offset"], [F.col("average").desc_nulls_last(), F.col(entity).asc()], n,
                         rank="team_rank")


def top_by_roster(rates: DataFrame, games: DataFrame, *, entity: str = "player_name", team: str = "player_team", n: int = 15) -> DataFrame:
    """Per team, stat and line the n best averages of everyone who ever played for the team: a traded player stands in each roster."""
    rosters = games.select(F.col(team).alias("team"), entity).dropna().distinct()
    return top_by_team(rates.drop("team").join(rosters, entity), entity=entity, n=n)


def top_by_stat(rates: DataFrame, *, entity: str = "player_name", n: int = 30) -> DataFrame:
    """Per stat and line the n best averages of the whole league."""
    return top_per_group(rates, ["stat", "offset"], [F.col("average").desc_nulls_last(), F.col(entity).asc()], n, rank="stat_rank")


def top_rows(df: DataFrame, by: str, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(by).desc_nulls_last(), *tiebreak).limit(n)


def bottom_rows(df: DataFrame, by: str, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(F.col(by).asc_nulls_last(), *tiebreak).limit(n)


def two_stage_top(df: DataFrame, first: str, then: str, n: int, tiebreak: Sequence[str] = ()) -> DataFrame:
    """The n largest by `first`, listed by smallest `then`."""
    return bottom_rows(top_rows(df, first, n, tiebreak), then, n, tiebreak)


def preview(df: DataFrame, order: Sequence[str], rows: int) -> DataFrame:
    """First and last rows/2 rows by `order`, doubles rounded to 2 places."""
    half = rows // 2
    head = df.orderBy(*[F.col(o).asc() for o in order]).limit(half).withColumn("part", F.lit("head"))
    tail = df.orderBy(*[F.col(o).desc() for o in order]).limit(rows - half).withColumn("part", F.lit("tail"))
    both = head.unionByName(tail)
    doubles = [c for c, t in df.dtypes if t in ("double", "float")]
    return both.withColumns({c: round_half_even(c, 2) for c in doubles}) if doubles else both


def value_counts_table(df: DataFrame, column: str, top: int | None = 20) -> DataFrame:
    """value, rows and share of non-null rows, most frequent first."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("rows"))
    shared = counts.withColumn("share", F.col("rows") / counts.agg(F.sum("rows")).scalar())
    ordered = shared.orderBy(F.col("rows").desc(), "value")
    return ordered if top is None else ordered.limit(top)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles, max, missing, missing_pct and distinct per numeric column."""
    long = unpivot(df, [], columns, "column", "value")
    moments = long.groupBy("column").agg(
        F.count("value").alias("count"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"),
        F.count_if(F.col("value").isNull()).alias("missing"), F.count(F.lit(1)).alias("_rows"))
    spread = quantiles_of_counts(cumulative_counts(long, ["column"], "value"), ["column"], "value",
                                 {"p25": 0.25, "p50": 0.5, "p75": 0.75}, [F.count(F.lit(1)).alias("distinct")])
    return moments.join(spread, "column", "left").withColumn(
        "missing_pct", F.col("missing") / F.col("_rows") * 100.0).drop("_rows")
