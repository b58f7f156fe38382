"""Ticket legs: join to results and quoted lines, settle, roll up to tickets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.exprs import beats_line, first_known, flag, implied_probability, pick

STATS = ("pts", "fg3m", "ast", "reb")
GAME_KEYS = ("game_id", "game_date", "player_id")


def attach_results(legs: DataFrame, games: DataFrame, stats: Sequence[str] = STATS,
                   keys: Sequence[str] = GAME_KEYS) -> DataFrame:
    """Left join of the realised stats and the known context columns."""
    context = [c for c in ("days_rest", "is_home") if c in games.columns]
    return legs.join(games.select(*keys, *stats, *context), list(keys), "left")


def attach_lines(legs: DataFrame, lines: DataFrame | None, keys: Sequence[str] = GAME_KEYS,
                 book: str | None = None) -> DataFrame:
    """Left join of quoted line and odds.  Several books fan a leg out unless one is named."""
    if lines is None:
        nothing = F.lit(None).cast("double")
        return legs.withColumns({"line_book": nothing, "over_odds": nothing, "under_odds": nothing})
    if book is not None:
        lines = lines.filter(F.col("book") == book)
    quoted = lines.select(*keys, "stat", F.col("line").alias("line_book"), "over_odds", "under_odds")
    return legs.join(quoted, [*keys, "stat"], "left")


def settle_legs(joined: DataFrame, stats: Sequence[str] = STATS) -> DataFrame:
    """realised, effective_line, direction_lower, leg_hit and the deviation features."""
    settled = joined.withColumns({
        "realised": pick("stat", stats),
        "effective_line": F.coalesce("line", "line_book"),
        "direction_lower": F.lower("direction"),
    })
    gap = F.col("realised") - F.col("effective_line")
    return settled.withColumns({
        "leg_hit": beats_line(F.col("realised"), F.col("effective_line"), F.col("direction_lower") == "over"),
        "realised_minus_line": gap,
        "realised_pct_diff": F.try_divide(gap, F.col("effective_line")) * 100.0,
    })


def leg_table(legs: DataFrame, games: DataFrame, lines: DataFrame | None, stats: Sequence[str] = STATS,
              keys: Sequence[str] = GAME_KEYS, book: str | None = None) -> DataFrame:
    return settle_legs(attach_lines(attach_results(legs, games, stats, keys), lines, keys, book), stats)


def _order(order: Sequence[str]) -> Column:
    """One numeric column orders inside a hash aggregate; text or several columns need a sorting one."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*order)


def _outcome_aggs(order: Sequence[str]) -> list[Column]:
    by = _order(order)
    return [
        first_known("game_date", by).alias("game_date"),
        first_known("game_id", by).alias("game_id"),
        F.count_distinct("leg_id").alias("n_legs"),
        F.min("leg_hit").alias("builder_hit"),
        F.avg(F.abs("realised_minus_line")).alias("mean_abs_edge"),
        F.max(F.abs("realised_minus_line")).alias("max_abs_edge"),
        F.coalesce(first_known("stake", by), F.lit(1.0)).alias("stake"),
        first_known("builder_total_odds", by).alias("decimal_odds"),
        F.count_if(F.col("direction_lower") == "over").alias("n_over"),
        F.count_if(F.col("direction_lower") == "under").alias("n_under"),
    ]


def mix_flags(tickets: DataFrame) -> DataFrame:
    """Implied probability and the over/under mix of each ticket."""
    legs, over, under = F.col("n_legs"), F.col("n_over"), F.col("n_under")
    return tickets.withColumns({
        "book_implied_prob": implied_probability("decimal_odds"),
        "pct_over": F.try_divide(over.cast("double"), legs),
        "pct_under": F.try_divide(under.cast("double"), legs),
        "is_all_over": flag(over == legs),
        "is_all_under": flag(under == legs),
        "is_mixed": flag((over > 0) & (under > 0)),
    })


def ticket_rollup(leg_df: DataFrame, *, ticket: str = "builder_id", order: Sequence[str] = ("leg_id",)) -> DataFrame:
    """One row per ticket.  n_legs counts distinct legs; n_over and n_under count joined rows."""
    grouped = leg_df.filter(F.col(ticket).isNotNull()).groupBy(ticket).agg(*_outcome_aggs(order))
    return mix_flags(grouped)


def _stat_flags(stats: Sequence[str]) -> list[Column]:
    return [F.max(flag(F.col("stat") == s)).alias(f"has_{s}") for s in stats]


def _stat_total(df: DataFrame, stats: Sequence[str]) -> DataFrame:
    total = F.lit(0)
    for s in stats:
        total = total + F.col(f"has_{s}")
    return df.withColumn("n_unique_stats", total)


def stat_composition(leg_df: DataFrame, *, ticket: str = "builder_id", stats: Sequence[str] = STATS) -> DataFrame:
    """has_<stat> flags and how many of the stats a ticket uses."""
    grouped = leg_df.filter(F.col(ticket).isNotNull()).groupBy(ticket).agg(*_stat_flags(stats))
    return _stat_total(grouped, stats)


def _diversity_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "same_player_ratio": F.try_divide(F.col("n_total_legs").cast("double"), F.col("n_unique_players")),
        "is_single_player": flag(F.col("n_unique_players") == 1),
    })


def player_diversity(leg_df: DataFrame, *, ticket: str = "builder_id", player: str = "player_id") -> DataFrame:
    grouped = leg_df.filter(F.col(ticket).isNotNull()).groupBy(ticket).agg(
        F.count_distinct(player).alias("n_unique_players"), F.count(player).alias("n_total_legs"))
    return _diversity_columns(grouped)


def ticket_table(leg_df: DataFrame, *, ticket: str = "builder_id", order: Sequence[str] = ("leg_id",),
                 stats: Sequence[str] = STATS) -> DataFrame:
    """Roll-up, stat composition and player diversity from one grouping of the legs.

    Players are counted at the first row of each: a second distinct count beside that of the legs would copy every row for
    each of them and deal the copies anew.
    """
    first = F.row_number().over(Window.partitionBy(ticket, "player_id").orderBy("player_id")) == 1
    grouped = leg_df.filter(F.col(ticket).isNotNull()).withColumn("_first", first).groupBy(ticket).agg(
        *_outcome_aggs(order), *_stat_flags(stats),
        F.count_if(F.col("_first") & F.col("player_id").isNotNull()).alias("n_unique_players"), F.count("player_id").alias("n_total_legs"),
    )
    return _diversity_columns(_stat_total(mix_flags(grouped), stats))


def correlation_risk(tickets: DataFrame) -> DataFrame:
    """Tickets whose legs are all of one player are flagged as risky."""
    return tickets.withColumn("high_correlation_risk", F.col("is_single_player"))


def ticket_pair_correlation(leg_df: DataFrame, correlations: DataFrame, *, ticket: str = "builder_id", leg: str = "leg_id", stats: Sequence[str] = STATS,
                            threshold: float = 0.7, x: str = "stat_x", y: str = "stat_y", corr: str = "corr") -> DataFrame:
    """(ticket, n_legs, n_pairs, mean_pair_corr, max_pair_corr, high_correlation_risk): how alike the legs of a ticket move.

    Every two legs of a ticket take the correlation of their stats from the table, whichever way round it names them; pairs
    of a stat with itself take its diagonal, or 1 where it has none.  Pairs the table does not know, such as those of other
    stats, are left out; a ticket without a known pair has NULL means and no risk.  Legs are told by `leg`.  Only the number
    of legs of each stat matters, so no pair of legs is formed, however many a ticket has; a row per two stats is looked up.
    """
    two = F.struct(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    known = correlations.filter(F.col(x).isin(*stats) & F.col(y).isin(*stats) & F.col(corr).isNotNull()).groupBy(two.alias("p")).agg(F.first(corr).alias("c"))
    # At most one entry for every two stats.
    lookup = known.agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "p.a", "p.b"), "c")))).scalar()
    legs = leg_df.filter(F.col(ticket).isNotNull()).select(F.col(ticket).alias("ticket"), F.col(leg).alias("leg"), "stat").distinct()
    counts = legs.groupBy("ticket").agg(F.count(F.lit(1)).alias("n_legs"), *[F.count_if(F.col("stat") == s).alias(f"n_{s}") for s in stats])
    placed = counts.withColumn("known", lookup)

    def entry(i: int, j: int) -> Column:
        a, b = sorted((stats[i], stats[j]))
        n, m = F.col(f"n_{stats[i]}"), F.col(f"n_{stats[j]}")
        found = F.try_element_at("known", F.lit(f"{a}|{b}"))
        return F.struct((n * (n - 1) / 2 if i == j else n * m).cast("bigint").alias("n"), (F.coalesce(found, F.lit(1.0)) if i == j else found).alias("c"))

    pairs = F.array(*[entry(i, j) for i in range(len(stats)) for j in range(i, len(stats))])
    met = placed.withColumn("pairs", F.filter(pairs, lambda p: (p["n"] > 0) & p["c"].isNotNull()))
    n_pairs = F.aggregate("pairs", F.lit(0).cast("bigint"), lambda s, p: s + p["n"])
    total = F.aggregate("pairs", F.lit(0.0), lambda s, p: s + p["n"] * p["c"])
    mean = F.try_divide(total, n_pairs)
    return met.select(F.col("ticket").alias(ticket), "n_legs", n_pairs.alias("n_pairs"), mean.alias("mean_pair_corr"),
                      F.array_max(F.transform("pairs", lambda p: p["c"])).alias("max_pair_corr"), flag(F.coalesce(mean >= threshold, F.lit(False))).alias("high_correlation_risk"))
