"""Replay of ticket templates and dated tickets over history, as sets of nights.

A template is small and comes from the caller, so it rides along as a literal:
matching a row against it needs neither a join nor a shuffle, and rows that match
nothing are gone before the first exchange.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.exprs import beats_line, implied_probability, pick, ratio, round_half_even
from ..functions.ordered import arrange, finish, quantiles, running
from ..sources.readers import ticket_props
from .cleaning import date_range
from .windows import cumulative, longest_streaks, streaks, trailing_mean


@dataclass(frozen=True)
class Facts:
    """Column names of the table a replay runs over."""

    name: str = "player_name"
    date: str = "game_date_only"
    tiebreak: str = "gameId"
    stats: tuple[str, ...] = ("PTS", "AST", "REB", "FG3M", "STL", "BLK", "TOV", "MIN")


def _matches(name: Column, needle: Column, match: str) -> Column:
    """How a prop's player text names an entity: any part, the last word of it, or exactly; case is ignored."""
    text, low = F.lower(needle), F.lower(name)
    if match == "contains":
        return low.contains(text)
    if match == "last_name":
        return low.contains(F.element_at(F.split(F.trim(text), r"\s+"), -1))
    if match == "exact":
        return low == text
    raise ValueError(f"unknown match {match!r}")


def _literal_props(legs: Sequence[Mapping]) -> Column:
    return F.array(*[
        F.struct(F.lit(i).alias("leg"), F.lit(j).alias("prop"), F.lit(p["player"]).alias("player"), F.lit(p["stat"]).alias("stat"),
                 F.lit(float(p["line"])).alias("line"), F.lit(bool(p["over"])).alias("over"))
        for i, leg in enumerate(legs, 1) for j, p in enumerate(leg["props"], 1)])


def _first_match(matched: DataFrame, keys: Sequence[str], facts: Facts) -> DataFrame:
    """One row per night and prop: the smallest (name, tiebreak) among the rows that match."""
    carried = F.struct(F.col(facts.name).alias("name"), "stat", "line", "over", "result")
    return matched.groupBy(*keys).agg(F.min_by(carried, F.struct(facts.name, facts.tiebreak)).alias("m")).select(*keys, "m.*")


def _settled(props: DataFrame) -> DataFrame:
    return props.withColumns({
        "margin": F.col("result") - F.col("line"),
        "hit": beats_line(F.col("result"), F.col("line"), F.col("over")).cast("boolean"),
    })


def season_lookup(season: DataFrame, legs: Sequence[Mapping], *, name: str = "player_name", rank_by: str = "PPG",
                  averages: Mapping[str, str], match: str = "contains") -> DataFrame:
    """(leg, prop, player_avg, cv) of the best-ranked season row each prop names; at most one row per prop.

    A stat without a CV in the season table has none here.
    """
    matched = season.select("*", F.explode(F.filter(_literal_props(legs), lambda p: _matches(F.col(name), p["player"], match))).alias("_p"))
    best = matched.groupBy(F.col("_p.leg").alias("leg"), F.col("_p.prop").alias("prop"), F.col("_p.stat").alias("stat")).agg(
        F.min_by(F.struct(*[c for c in season.columns]), F.struct(F.col(rank_by).isNull().alias("unranked"), (-F.col(rank_by)).alias("r"), F.col(name))).alias("s"))
    avg = F.lit(None).cast("double")
    cv = F.lit(None).cast("double")
    for s, column in averages.items():
        avg = F.when(F.col("stat") == s, F.col(f"s.{column}")).otherwise(avg)
        if f"{s}_CV" in season.columns:
            cv = F.when(F.col("stat") == s, F.col(f"s.{s}_CV")).otherwise(cv)
    return best.select("leg", "prop", avg.alias("player_avg"), cv.alias("cv"))


def settle_props(df: DataFrame, legs: Sequence[Mapping], facts: Facts = Facts(), *, match: str = "contains",
                 lookup: DataFrame | None = None) -> DataFrame:
    """(date, leg, prop, player, stat, line, over, result, margin, hit[, player_avg, cv]) for every night a prop's player played.

    Props on a stat the facts lack are left out.
    """
    stats = [s for s in facts.stats if s in df.columns]
    wanted = F.filter(_literal_props(legs), lambda p: _matches(F.col(facts.name), p["player"], match) & p["stat"].isin(stats))
    matched = df.select(F.col(facts.date).alias("date"), facts.name, facts.tiebreak, *stats, F.explode(wanted).alias("_p")).select(
        "date", facts.name, facts.tiebreak, *stats, "_p.leg", "_p.prop", "_p.stat", "_p.line", "_p.over").withColumn("result", pick("stat", stats))
    settled = _settled(_first_match(matched, ["date", "leg", "prop"], facts)).withColumnRenamed("name", "player")
    if lookup is None:
        return settled
    return settled.join(F.broadcast(lookup), ["leg", "prop"], "left")  # one row per prop of the template


def settle_legs(props: DataFrame, nights: DataFrame, legs: Sequence[Mapping]) -> DataFrame:
    """One row per night and leg; a leg nobody of which played is lost."""
    frame = nights.select("date", F.explode(F.array(*[
        F.struct(F.lit(i).alias("leg"), F.lit(leg["name"]).alias("leg_name")) for i, leg in enumerate(legs, 1)])).alias("l")).select("date", "l.*")
    counted = props.groupBy("date", "leg").agg(F.count(F.lit(1)).alias("props_evaluated"), F.count_if("hit").alias("props_hit"))
    joined = frame.join(counted, ["date", "leg"], "left").fillna(0, ["props_evaluated", "props_hit"])
    return joined.withColumns({
        "hit_rate": F.coalesce(ratio("props_hit", "props_evaluated") * 100.0, F.lit(0.0)),
        "leg_won": (F.col("props_evaluated") > 0) & (F.col("props_hit") == F.col("props_evaluated")),
    })


def settle_nights(legs: DataFrame) -> DataFrame:
    return legs.groupBy("date").agg(F.count(F.lit(1)).alias("legs_evaluated"), F.count_if("leg_won").alias("legs_won"),
                                    F.bool_and("leg_won").alias("acca_won"))


@dataclass(frozen=True)
class Replay:
    props: DataFrame
    legs: DataFrame
    nights: DataFrame


def replay_template(df: DataFrame, template: Mapping, facts: Facts = Facts(), *, start=None, end=None,
                    lookup: DataFrame | None = None, match: str = "contains") -> Replay:
    """Settle a template on every night of a date range."""
    ranged = date_range(df, facts.date, start, end)
    props = settle_props(ranged, template["legs"], facts, match=match, lookup=lookup)
    nights = ranged.select(F.col(facts.date).alias("date")).dropna().distinct()
    legs = settle_legs(props, nights, template["legs"])
    return Replay(props, legs, settle_nights(legs))


def replay_sampled(df: DataFrame, props: Sequence[Mapping], n_nights: int | None = None, facts: Facts = Facts(), *, seed: int = 42,
                   lookup: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nights, props) of a flat prop list on a fixed hash sample of nights, or on all; a night on which nothing could be tested is void."""
    nights = df.select(F.col(facts.date).alias("date")).dropna().distinct()
    if n_nights is None:
        inside = df.filter(F.col(facts.date).isNotNull())
    else:
        chosen = nights.orderBy(F.md5(F.concat_ws("|", F.col("date").cast("string"), F.lit(str(seed)))), "date").limit(n_nights)
        inside = df.join(chosen.withColumnRenamed("date", facts.date), facts.date, "left_semi")
    settled = settle_props(inside, [{"name": "all", "props": list(props)}], facts, lookup=lookup)
    table = settled.groupBy("date").agg(F.count_if("hit").alias("props_hit"), F.count(F.lit(1)).alias("props_tested"),
                                        F.bool_and("hit").alias("acca_hit"))
    return table.withColumn("hit_rate", ratio("props_hit", "props_tested") * 100.0), settled


def replay_summary(nights: DataFrame) -> DataFrame:
    """nights_tested, accas_won, accas_lost, win_rate and the longest winning and losing runs."""
    counts = nights.agg(F.count(F.lit(1)).alias("nights_tested"), F.count_if("acca_won").alias("accas_won"))
    runs = longest_streaks(nights, "acca_won", order=["date"])
    both = counts.withColumn("_s", runs.select(F.struct("max_win_streak", "max_loss_streak")).scalar())
    won, tested = F.col("accas_won"), F.col("nights_tested")
    return both.select("nights_tested", "accas_won", (tested - won).alias("accas_lost"),
                       (ratio("accas_won", "nights_tested") * 100.0).alias("win_rate"), "_s.max_win_streak", "_s.max_loss_streak")


def night_series(nights: DataFrame, size: int = 7) -> DataFrame:
    """Streaks, cumulative wins and the trailing win rate (in %) night by night."""
    marked = nights.withColumn("_w", F.col("acca_won").cast("int"))
    run = streaks(marked, "acca_won", order=["date"])
    total = cumulative(run, {"cum_wins": F.col("_w")}, order=["date"])
    trailing = trailing_mean(total, "_w", size, order=["date"], out="trailing_win_rate")
    return trailing.withColumn("trailing_win_rate", F.col("trailing_win_rate") * 100.0).drop("_w")


def legs_won_counts(nights: DataFrame) -> DataFrame:
    return nights.groupBy("legs_won").agg(F.count(F.lit(1)).alias("nights"))


def prop_success(props: DataFrame) -> DataFrame:
    """hits, total, hit_rate, avg_margin, avg_cv (2 places) and hit_pct (1 place) per player and stat."""
    cv = F.col("cv") if "cv" in props.columns else F.lit(None).cast("double")
    return props.groupBy("player", "stat").agg(
        F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total"),
        round_half_even(F.avg(F.col("hit").cast("int")), 2).alias("hit_rate"),
        round_half_even(F.avg("margin"), 2).alias("avg_margin"), round_half_even(F.avg(cv), 2).alias("avg_cv"),
    ).withColumn("hit_pct", round_half_even(F.col("hit_rate") * 100.0, 1))


def success_by(props: DataFrame, by: str | Column, name: str) -> DataFrame:
    """Hits, total and hit rate in % by any column: player, stat or weekday."""
    key = F.col(by) if isinstance(by, str) else by
    return props.groupBy(key.alias(name)).agg(F.count_if("hit").alias("hits"), F.count(F.lit(1)).alias("total"),
                                              (F.avg(F.col("hit").cast("int")) * 100.0).alias("hit_pct"))


def night_success_by_weekday(nights: DataFrame) -> DataFrame:
    return nights.groupBy(F.weekday("date").alias("day_index"), F.date_format("date", "EEEE").alias("day_of_week")).agg(
        F.count(F.lit(1)).alias("nights"), (F.avg(F.col("acca_won").cast("int")) * 100.0).alias("win_rate"))


def settle_tickets(df: DataFrame, tickets: Sequence[Mapping], facts: Facts = Facts(), *, season: DataFrame | None = None,
                   averages: Mapping[str, str] | None = None, rank_by: str = "PPG",
                   match: str = "last_name") -> tuple[DataFrame, DataFrame]:
    """(tickets, props) of tickets that each name their own date and, maybe, odds (1.0 if absent).

    Facts meet the tickets by date; the name test runs inside that join.  Tickets
    none of whose props could be settled are left out.
    """
    spark = df.sparkSession
    wanted = ticket_props(spark, tickets)
    stats = [s for s in facts.stats if s in df.columns]
    left = df.select(F.col(facts.date).alias("date"), facts.name, facts.tiebreak, *stats)
    matched = left.join(wanted.filter(F.col("stat").isin(stats)), "date").filter(_matches(F.col(facts.name), F.col("player"), match)).withColumn(
        "result", pick("stat", stats))
    props = _settled(_first_match(matched, ["ticket", "date", "odds", "prop"], facts)).withColumnRenamed("name", "player")
    if season is not None:
        flat = [{"name": str(i), "props": t["props"]} for i, t in enumerate(tickets, 1)]
        known = season_lookup(season, flat, name=facts.name, rank_by=rank_by, averages=averages or {}, match=match)
        props = props.join(known.withColumnRenamed("leg", "ticket"), ["ticket", "prop"], "left")
    table = props.groupBy("ticket", "date", "odds").agg(
        F.count(F.lit(1)).alias("total_props"), F.count_if("hit").alias("props_hit"), F.bool_and("hit").alias("leg_won"))
    fair = F.when(F.col("odds") > 0, implied_probability("odds")).otherwise(1.0)
    return table.withColumns({
        "hit_rate": ratio("props_hit", "total_props") * 100.0, "implied_prob": fair, "expected_hit_rate": fair * 100.0}), props


def combined_odds(tickets: DataFrame) -> DataFrame:
    """All tickets as one accumulator: legs, wins, win rate, products of odds and implied probabilities, all_won."""
    return tickets.agg(
        F.count(F.lit(1)).alias("total_legs"), F.count_if("leg_won").alias("legs_won"),
        (F.avg(F.col("leg_won").cast("int")) * 100.0).alias("win_rate"), F.product("odds").alias("combined_odds"),
        F.product("implied_prob").alias("combined_implied_prob"), F.coalesce(F.bool_and("leg_won"), F.lit(False)).alias("all_won"))


def ticket_size_table(tickets: DataFrame) -> DataFrame:
    return tickets.groupBy("total_props").agg(
        F.count(F.lit(1)).alias("tickets"), F.avg("hit_rate").alias("mean_hit_rate"),
        (F.avg(F.col("leg_won").cast("int")) * 100.0).alias("win_rate"))


def cumulative_props(tickets: DataFrame) -> DataFrame:
    return cumulative(tickets, {"cum_props": F.col("total_props"), "cum_hits": F.col("props_hit")}, order=["ticket"])


def margin_summary(props: DataFrame) -> DataFrame:
    """Mean, median, min and max of result - line."""
    mid = quantiles(props.select("margin"), [], "margin", {"median_margin": 0.5}).scalar()
    return props.agg(F.avg("margin").alias("mean_margin"), F.min("margin").alias("min_margin"), F.max("margin").alias("max_margin")).withColumn(
        "median_margin", mid)


def hits_by_consistency(props: DataFrame, cv: str = "cv", limit: float = 0.40) -> DataFrame:
    """Hits by players whose CV is under the limit and by the others; unknown CVs count in neither."""
    hits = props.filter("hit").agg(F.count_if(F.col(cv) < limit).alias("consistent"), F.count_if(F.col(cv) >= limit).alias("inconsistent"))
    return hits.unpivot([], ["consistent", "inconsistent"], "band", "hits")


def reliable_players(props: DataFrame) -> DataFrame:
    """Settled hits and mean margin per player, most hits first."""
    table = props.groupBy("player").agg(F.count_if("hit").alias("hits"), F.avg("margin").alias("avg_margin"))
    return table.filter(F.col("hits") > 0).orderBy(F.col("hits").desc(), "player")


def close_calls(props: DataFrame, within: float = 2.0) -> DataFrame:
    return props.filter(F.abs("margin") < within)


def ticket_edge(rates: DataFrame, legs: DataFrame, *, keys: Sequence[str] = ("player_name", "stat", "offset"),
                ticket: str = "ticket", odds: str = "odds") -> DataFrame:
    """Ticket probability (product of leg hit rates), fair odds, edge over 1/odds and a positive-value flag.

    Legs are taken as independent.  A ticket with a leg that has no rate gets no price.
    """
    priced = legs.join(rates.select(*keys, "hit_rate"), list(keys), "left")
    table = priced.groupBy(ticket).agg(
        F.count(F.lit(1)).alias("n_legs"), F.count("hit_rate").alias("_known"), F.max(odds).alias("odds"),
        F.product(F.col("hit_rate") / 100.0).alias("_p"))
    p = F.when(F.col("_known") == F.col("n_legs"), F.col("_p"))
    return table.withColumn("probability", p).withColumns({
        "fair_odds": F.try_divide(F.lit(1.0), F.col("probability")),
        "edge": F.col("probability") - implied_probability("odds"),
    }).withColumn("positive_ev", F.col("edge") > 0).drop("_known", "_p")


def offered_line_rates(facts: DataFrame, lines: DataFrame, *, keys: Sequence[str] = ("player_id", "stat"), value: str = "value",
                       line: str = "line") -> DataFrame:
    """% of an entity's rows above each offered line, exactly, as (keys, line, games, hit_rate).

    Lines and distinct values are merged into one ordered list per entity; the
    rows counted up to a line are those not above it.  No line meets every row.
    """
    counts = facts.dropna(subset=list(keys)).groupBy(*keys, F.col(value).cast("double").alias("at")).agg(F.count(F.lit(1)).alias("w"))
    games = counts.groupBy(*keys).agg(F.sum("w").alias("games"), F.sum(F.when(F.col("at").isNotNull(), F.col("w")).otherwise(0)).alias("_known"))
    asked = lines.dropna(subset=[*keys, line]).select(*keys, F.col(line).cast("double").alias("at")).distinct()
    merged = counts.filter(F.col("at").isNotNull()).withColumn("is_line", F.lit(0)).unionByName(
        asked.withColumns({"w": F.lit(0).cast("long"), "is_line": F.lit(1)}))
    ran = finish(running(arrange(merged, keys, [F.col("at").asc(), F.col("is_line").asc()]), {"upto": ("sum", F.col("w"))}))
    return ran.filter("is_line = 1").join(games, list(keys)).select(
        *keys, F.col("at").alias(line), "games", ((F.col("_known") - F.col("upto")) / F.col("games") * 100.0).alias("hit_rate"))
