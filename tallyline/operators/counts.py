"""Count distributions per entity, line probabilities and value signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.dist import family_cdf, family_sf
from ..functions.exprs import greatest_or_null, unpivot
from ..functions.ordered import profile

# The reported percentiles.
PERCENTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90}


def distribution_summary_long(df: DataFrame, *, keys: Sequence[str] = ("player_id", "stat"), value: str = "value",
                              min_games: int = 20) -> DataFrame:
    """n_games, mean, std, var, percentiles, min and max per key; missing values are left out first."""
    table = profile(df.select(*keys, F.col(value).cast("double").alias(value)), keys, value, PERCENTILES)
    return table.filter(F.col("n") >= min_games).withColumnRenamed("n", "n_games")


def distribution_summary(df: DataFrame, stats: Sequence[str] = ("pts", "fg3m", "ast", "reb"), *,
                         entity: str = "player_id", min_games: int = 20) -> DataFrame:
    return distribution_summary_long(unpivot(df, [entity], stats, "stat", "value"), keys=[entity, "stat"],
                                     value="value", min_games=min_games)


def attach_count_models(summary: DataFrame, *, mean: str = "mean", var: str = "var") -> DataFrame:
    """family and params(mu, n, p, loc): Poisson unless the variance clearly exceeds the mean.

    "Close" means |var-mean| <= 1e-8 + 0.1*|mean|.  A mean of 0 or less is degenerate.
    A single observation has no variance and gets Poisson.
    """
    m, v = F.col(mean), F.col(var)
    close = (F.abs(v - m) <= 1e-8 + 0.1 * F.abs(m)) | (v < m)
    r = F.try_divide(m * m, v - m)
    p = F.try_divide(r, r + m)
    over = ~F.coalesce(close, F.lit(True)) & (r > 0) & (p > 0) & (p < 1)
    family = F.when(m.isNull(), None).when(m <= 0, "degenerate").when(F.coalesce(over, F.lit(False)), "nbinom").otherwise("poisson")
    with_family = summary.withColumn("family", family)
    f = F.col("family")
    return with_family.withColumn("params", F.struct(
        F.when(f == "poisson", m).alias("mu"), F.when(f == "nbinom", r).alias("n"),
        F.when(f == "nbinom", p).alias("p"), F.when(f == "degenerate", F.lit(0.0)).alias("loc")))


def family_shares(models: DataFrame) -> DataFrame:
    counts = models.groupBy("family").agg(F.count(F.lit(1)).alias("n_models"))
    return counts.withColumn("share_pct", F.col("n_models") / counts.agg(F.sum("n_models")).scalar() * 100.0)


def _priced(tail, k: Column) -> Column:
    p = F.col("params")
    made = tail("family", k.cast("double"), F.coalesce(p["mu"], p["n"]), F.coalesce(p["p"], F.lit(0.0)))
    return F.when(F.col("family").isin("poisson", "nbinom"), made)


def line_tail_probabilities(models: DataFrame, lines: DataFrame, *, keys: Sequence[str] = ("player_id", "stat"),
                            line: str = "line", push: str = "over") -> DataFrame:
    """prob_over, prob_under and fair odds for every line that has a model.

    A whole-number line counts a tie as over; push="void" reports it apart in
    prob_push.  Every (model, whole number) pair is priced once, however many lines
    ask for it, and exactly, however long the line.
    """
    keys = list(keys)
    whole = F.col(line) == F.floor(line)
    below = F.greatest(F.when(whole, F.col(line) - 1).otherwise(F.floor(F.col(line) - 1e-9)).cast("long"), F.lit(-1).cast("long"))
    # A missing line keeps its row through the join and gets no price.
    known = lines.dropna(subset=keys).withColumn("_k", F.coalesce(below, F.lit(-1).cast("long")))
    asked = known.select(*keys, "_k").distinct().join(models.select(*keys, "family", "params"), keys).filter(F.col("family").isNotNull())
    priced = asked.withColumns({"_under": _priced(family_cdf, F.col("_k")), "_over": _priced(family_sf, F.col("_k"))})
    if push == "void":
        priced = priced.withColumns({"_upto": _priced(family_cdf, F.col("_k") + 1), "_beyond": _priced(family_sf, F.col("_k") + 1)})
    table = known.join(priced.drop("family", "params"), [*keys, "_k"])
    has_line = F.col(line).isNotNull()
    out = table.withColumn("prob_under", F.when(has_line, F.col("_under")))
    if push == "void":
        tie = (F.col(line) >= 0) & whole
        out = out.withColumns({
            "prob_push": F.when(has_line & F.col("_under").isNotNull(), F.when(tie, F.col("_upto") - F.col("_under")).otherwise(0.0)),
            "prob_over": F.when(has_line, F.when(tie, F.col("_beyond")).otherwise(F.col("_over"))),
        }).drop("_upto", "_beyond")
    else:
        out = out.withColumn("prob_over", F.when(has_line, F.col("_over")))
    return out.withColumns({
        "implied_odds_over": F.when(F.col("prob_over") > 0, 1.0 / F.col("prob_over")),
        "implied_odds_under": F.when(F.col("prob_under") > 0, 1.0 / F.col("prob_under")),
    }).drop("_k", "_under", "_over")


# What ties a probability to its own quote.
QUOTE = ("game_id", "player_id", "stat", "book", "line")


def value_bets(tails: DataFrame, lines: DataFrame | None = None, *, min_edge: float = 0.05, keys: Sequence[str] = QUOTE) -> DataFrame:
    """Lines whose model edge (prob*odds-1) on either side reaches `min_edge`, with the better side.

    Without `lines`, or with the default keys where `tails` carries its own odds, each quote meets its own price and no
    join is needed.  Dropping book and line from the keys pairs every quote of a player's stat with every other.
    """
    if lines is None or (tuple(keys) == QUOTE and {"over_odds", "under_odds"} <= set(tails.columns)):
        joined = tails
    else:
        joined = tails.drop("over_odds", "under_odds").join(lines.select(*keys, "over_odds", "under_odds"), list(keys))
    edged = joined.withColumns({
        "edge_over": F.col("prob_over") * F.col("over_odds") - 1,
        "edge_under": F.col("prob_under") * F.col("under_odds") - 1,
    })
    return edged.filter((F.col("edge_over") >= min_edge) | (F.col("edge_under") >= min_edge)).withColumns({
        "best_direction": F.when(F.col("edge_over") > F.col("edge_under"), "over").otherwise("under"),
        "best_edge": greatest_or_null("edge_over", "edge_under"),
    })
