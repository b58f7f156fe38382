"""Correlation, rank dependence, tail dependence, entropy and mutual information.

Work on many variables runs on (variable, value, weight) or (pair, x, y, weight)
rows that are combined before the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.dist import correlation_p, two_sided_normal_p
from ..functions.exprs import safe_corr, unpivot
from ..functions.ordered import (
    average_ranks, arrange, cumulative_counts, finish, quantiles, quantiles_of_counts, running, value_counts,
)
from ..session import BROADCAST_ROWS, MAX_GROUP_ROWS, setting, stored, tasks_for

STATS = ("pts", "fg3m", "ast", "reb")


def _pairs(stats: Sequence[str], diagonal: bool) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(stats) for b in stats[i if diagonal else i + 1:]]


def _ranked(df: DataFrame, keys: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Replace each stat by its tie-averaged rank inside the group."""
    spark = df.sparkSession
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).agg(F.max("rows").alias("most"), F.sum("rows").alias("rows")).first()
    if (sizes["most"] or 0) <= setting(spark, MAX_GROUP_ROWS):
        df, ranks = df.repartition(tasks_for(spark, sizes["rows"] or 0), *keys), {}
        for s in stats:
            by = Window.partitionBy(*keys)
            ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, s))
            ranks[s] = F.rank().over(by.orderBy(s)) + (ties - 1) / 2.0
        return df.select(*keys, *[c.alias(s) for s, c in ranks.items()])
    out = df
    for s in stats:
        table = average_ranks(df.select(*keys, s), keys, s).select(*keys, s, F.col("avg_rank").alias(f"_r_{s}"))
        out = out.join(table, [*keys, s])
    return out.select(*keys, *[F.col(f"_r_{s}").alias(s) for s in stats])


def entity_correlations(df: DataFrame, stats: Sequence[str] = STATS, *, entity: str = "player_id",
                        min_games: int = 20, method: str = "spearman") -> DataFrame:
    """(entity, stat_x, stat_y, corr, n_games, method) over complete rows, upper triangle with diagonal.

    A constant stat has no correlation (NULL), also with itself.
    """
    rows = df.select(entity, *[F.col(s).cast("double").alias(s) for s in stats]).dropna()
    if method == "spearman":
        rows = _ranked(rows, [entity], stats)
    elif method != "pearson":
        raise ValueError(f"unknown method {method!r}")
    pairs = _pairs(stats, True)
    wide = rows.groupBy(entity).agg(F.count(F.lit(1)).alias("n_games"), *[
        safe_corr(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)]).filter(F.col("n_games") >= min_games)
    cells = F.array(*[F.struct(F.lit(a).alias("stat_x"), F.lit(b).alias("stat_y"), F.col(f"c{i}").alias("corr"))
                      for i, (a, b) in enumerate(pairs)])
    return wide.select(entity, F.explode(cells).alias("c"), "n_games").select(
        entity, "c.stat_x", "c.stat_y", "c.corr", "n_games", F.lit(method).alias("method"))


def _complete(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(v).cast("double").alias(v) for v in variables]).dropna()


def _pair_rows(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(var_x, var_y, x, y) rows; every use of it combines on the map side."""
    return rows.select(F.explode(F.array(*[
        F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"), F.col(a).alias("x"), F.col(b).alias("y"))
        for a, b in pairs])).alias("p")).select("p.*")


def _pair_cells(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return _pair_rows(rows, pairs).groupBy("var_x", "var_y", "x", "y").agg(F.count(F.lit(1)).alias("cell"))


def _pearson(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    return _pair_rows(rows, pairs).groupBy("var_x", "var_y").agg(
        safe_corr("x", "y").alias("pearson"), F.count(F.lit(1)).alias("n"))


def _ranked_columns(rows: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Each variable's tie-averaged rank, centred on (n+1)/2, in the variable's place.

    Each variable is ranked once, over its distinct values.  Rank tables that together are small, by count, go to every
    task and no row moves; larger ones meet the rows by value and the rows come together again by number, so that
    what is shuffled is twice a row for each variable, however many pairs there are.
    """
    spark = rows.sparkSession
    long = unpivot(rows, [], variables, "variable", "value")
    ranks = stored(average_ranks(long, ["variable"], "value").select(
        "variable", "value", (F.col("avg_rank") - (F.col("n") + 1) / 2.0).alias("rank")))
    if ranks.count() <= setting(spark, BROADCAST_ROWS):
        for v in variables:
            table = ranks.filter(F.col("variable") == v).select(F.col("value").alias("_value"), F.col("rank").alias(f"_r_{v}"))
            rows = rows.join(F.broadcast(table), F.col(v) == F.col("_value")).drop("_value")
        return rows.select(*[F.col(f"_r_{v}").alias(v) for v in variables])
    numbered = stored(rows.withColumn("_row", F.monotonically_increasing_id()))
    met = unpivot(numbered, ["_row"], variables, "variable", "value").join(ranks, ["variable", "value"])
    return met.groupBy("_row").agg(*[F.max(F.when(F.col("variable") == v, F.col("rank"))).alias(v) for v in variables]).drop("_row")


def _spearman(rows: DataFrame, pairs: Sequence[tuple[str, str]], variables: Sequence[str]) -> DataFrame:
    """(var_x, var_y, spearman, n) of all pairs from one pass over ranked rows."""
    squares = [F.sum(F.col(v) * F.col(v)).alias(f"_s_{v}") for v in variables]
    products = [F.sum(F.col(a) * F.col(b)).alias(f"_p{i}") for i, (a, b) in enumerate(pairs)]
    wide = _ranked_columns(rows, variables).agg(F.count(F.lit(1)).alias("n"), *squares, *products).filter("n > 0")
    return wide.select("n", F.explode(F.array(*[
        F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y"),
                 F.try_divide(F.col(f"_p{i}"), F.sqrt(F.col(f"_s_{a}") * F.col(f"_s_{b}"))).alias("spearman"))
        for i, (a, b) in enumerate(pairs)])).alias("p")).select("p.*", "n")


def global_correlation(df: DataFrame, stats: Sequence[str] = STATS, *, method: str = "spearman") -> DataFrame:
    """(stat_x, stat_y, corr, n_obs, method) over complete rows."""
    rows, pairs = _complete(df, stats), _pairs(stats, True)
    if method == "spearman":
        table = _spearman(rows, pairs, stats)
    elif method == "pearson":
        table = _pearson(rows, pairs)
    else:
        raise ValueError(f"unknown method {method!r}")
    return table.select(F.col("var_x").alias("stat_x"), F.col("var_y").alias("stat_y"), F.col(method).alias("corr"),
                        F.col("n").alias("n_obs"), F.lit(method).alias("method"))


def _off_diagonal(df: DataFrame) -> DataFrame:
    return df.filter(F.col("stat_x") != F.col("stat_y"))


def _corr_spread(df: DataFrame, keys: Sequence[str], names: Mapping[str, str]) -> DataFrame:
    """mean, median, std, min and max of `corr` per key from one pass of value counts.

    Correlations lie in [-1, 1], so sums of squares lose nothing.
    """
    c, w = F.col("corr"), F.col("weight")
    table = quantiles_of_counts(cumulative_counts(df, keys, "corr"), keys, "corr", {"median": 0.5}, [
        F.sum(w).alias("_w"), F.sum(w * c).alias("_s"), F.sum(w * c * c).alias("_q"), F.min(c).alias("min"), F.max(c).alias("max")])
    n = F.col("_w")
    var = F.when(n > 1, F.greatest((F.col("_q") - F.col("_s") * F.col("_s") / n) / F.when(n > 1, n - 1), F.lit(0.0)))
    measured = table.withColumns({"mean": F.col("_s") / n, "std": F.sqrt(var)})
    # A pair without any correlation keeps its row.
    full = df.select(*keys).distinct().join(measured, list(keys), "left")
    return full.select(*keys, *[F.col(k).alias(v) for k, v in names.items()])


def correlation_summary(entity_corr: DataFrame) -> DataFrame:
    """mean, median, std, min and max of the entities' correlation per pair."""
    return _corr_spread(_off_diagonal(entity_corr), ["stat_x", "stat_y"], {k: f"{k}_corr" for k in ("mean", "median", "std", "min", "max")})


def compare_with_global(entity_corr: DataFrame, global_corr: DataFrame) -> DataFrame:
    """Global correlation next to the entities' mean, median and std, whichever way round the pair is named."""
    def named(df: DataFrame) -> DataFrame:
        return _off_diagonal(df).withColumns({"_a": F.least("stat_x", "stat_y"), "_b": F.greatest("stat_x", "stat_y")})
    stats = _corr_spread(named(entity_corr).select("_a", "_b", "corr"), ["_a", "_b"], {k: f"player_{k}_corr" for k in ("mean", "median", "std")})
    return named(global_corr).join(stats, ["_a", "_b"]).select(
        "stat_x", "stat_y", F.col("corr").alias("global_corr"), "player_mean_corr", "player_median_corr", "player_std_corr")


def high_correlation_pairs(entity_corr: DataFrame, threshold: float = 0.7) -> DataFrame:
    return _off_diagonal(entity_corr).filter(F.abs("corr") >= threshold)


def pair_counts(high: DataFrame) -> DataFrame:
    return high.groupBy("stat_x", "stat_y").agg(F.count(F.lit(1)).alias("n_players")).orderBy(
        F.col("n_players").desc(), "stat_x", "stat_y")


def strongest_correlations(global_corr: DataFrame, n: int = 3, by_abs: bool = False) -> DataFrame:
    by = F.abs("corr") if by_abs else F.col("corr")
    return _off_diagonal(global_corr).orderBy(by.desc_nulls_last(), "stat_x", "stat_y").limit(n)


def _discordance(cells: DataFrame) -> DataFrame:
    """Per pair the weight of pairs ordered one way by x and the other way by y.

    Two y ranks differ first at one bit, so each such pair is counted at exactly
    one bit: inside rows sharing the higher bits, ones that come before zeros in x
    order.  This takes log2(distinct y) running sums and forms no pairs of rows.
    """
    y_values = cells.select("var_x", "var_y", "y").distinct()
    spread = cumulative_counts(y_values, ["var_x", "var_y"], "y").select(
        "var_x", "var_y", "y", (F.col("upto") - 1).alias("code"))
    coded = cells.join(spread, ["var_x", "var_y", "y"])
    bits = spread.agg(F.ceil(F.log2(F.max("code") + 1)).cast("int").alias("bits")).first()["bits"] or 0
    if bits == 0:
        return cells.select("var_x", "var_y").distinct().withColumn("discordant", F.lit(0.0))
    levels = coded.select("var_x", "var_y", "x", "cell", F.explode(F.array(*[
        F.struct(F.lit(b).alias("level"), F.shiftright("code", b + 1).alias("prefix"),
                 F.shiftright("code", b).bitwiseAND(F.lit(1)).alias("bit"))
        for b in range(bits)])).alias("l")).select("var_x", "var_y", "x", "cell", "l.*")
    merged = levels.groupBy("var_x", "var_y", "level", "prefix", "x", "bit").agg(F.sum("cell").alias("cell"))
    keys = ["var_x", "var_y", "level", "prefix"]
    # Zeros sort before ones at the same x, so ones counted so far lie strictly below in x.
    ran = finish(running(arrange(merged, keys, [F.col("x").asc(), F.col("bit").asc()]),
                         {"ones": ("sum", F.when(F.col("bit") == 1, F.col("cell")).otherwise(F.lit(0)))}))
    return ran.groupBy("var_x", "var_y").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("cell").cast("double") * F.col("ones")).otherwise(0.0)).alias("discordant"))


def kendall_table(rows: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Kendall tau-b with the tie-corrected normal p-value per pair."""
    return _kendall(_pair_cells(rows, pairs))


def _tie_sums(cells: DataFrame, side: str) -> DataFrame:
    t = F.col("t").cast("double")
    return cells.groupBy("var_x", "var_y", side).agg(F.sum("cell").alias("t")).groupBy("var_x", "var_y").agg(
        F.sum(t * (t - 1) / 2).alias(f"tie_{side}"), F.sum(t * (t - 1) * (t - 2)).alias(f"t3_{side}"),
        F.sum(t * (t - 1) * (2 * t + 5)).alias(f"v_{side}"))


# Up to this many rows without ties Kendall's p-value is exact.
EXACT_ROWS = 33


def _inversion_shares(most: int) -> list[tuple[int, int, float]]:
    """(n, d, share of the orders of n things with at most d inversions), by the recurrence over n."""
    out, shares = [], [1.0]
    for n in range(1, most + 1):
        sums = [math.fsum(shares[max(0, d - n + 1):d + 1]) / n for d in range(n * (n - 1) // 2 + 1)]
        shares, upto = sums, 0.0
        for d, share in enumerate(sums):
            upto += share
            out.append((n, d, upto))
    return out


def _kendall(cells: DataFrame) -> DataFrame:
    """tau-b with its p-value: exact for up to EXACT_ROWS rows without ties, else the tie-corrected normal one."""
    keys = ["var_x", "var_y"]
    c = F.col("cell").cast("double")
    both = cells.groupBy(*keys).agg(F.sum(c).alias("n"), F.sum(c * (c - 1) / 2).alias("tie_xy"))
    table = both.join(_tie_sums(cells, "x"), keys).join(_tie_sums(cells, "y"), keys).join(_discordance(cells), keys)
    n, tx, ty = F.col("n"), F.col("tie_x"), F.col("tie_y")
    total = n * (n - 1) / 2
    diff = total - tx - ty + F.col("tie_xy") - 2 * F.col("discordant")
    spread = n * (n - 1)
    var = (spread * (2 * n + 5) - F.col("v_x") - F.col("v_y")) / 18 + F.try_divide(2 * tx * ty, spread) + F.try_divide(
        F.col("t3_x") * F.col("t3_y"), 9 * spread * (n - 2))
    untied = (tx == 0) & (ty == 0) & (n <= EXACT_ROWS)
    fewer = F.when(untied, F.least("discordant", total - F.col("discordant"))).cast("int")
    measured = table.select(*keys, F.try_divide(diff, F.sqrt((total - tx) * (total - ty))).alias("kendall"), F.try_divide(diff, F.sqrt(var)).alias("_z"),
                            n.cast("int").alias("_n"), fewer.alias("_d"))
    # A few thousand rows, whatever the data.
    shares = cells.sparkSession.createDataFrame(_inversion_shares(EXACT_ROWS), "_sn int, _sd int, _share double")
    met = measured.join(F.broadcast(shares), (F.col("_n") == F.col("_sn")) & (F.col("_d") == F.col("_sd")), "left")
    normal = F.when(F.col("_z").isNotNull(), two_sided_normal_p("_z"))
    exact = F.least(2.0 * F.col("_share"), F.lit(1.0))
    return met.withColumn("kendall_p", F.when(F.col("_share").isNotNull() & F.col("kendall").isNotNull(), exact).otherwise(normal)).select(*keys, "kendall", "kendall_p")


def tail_dependence(rows: DataFrame, pairs: Sequence[tuple[str, str]], *, upper: float = 0.9, lower: float = 0.1,
                    min_rows: int = 10) -> DataFrame:
    """Pearson among rows at or above the upper (at or below the lower) quantile of x; asymmetry is their gap."""
    xs = sorted({a for a, _ in pairs})
    cuts = quantiles(unpivot(rows, [], xs, "var_x", "value"), ["var_x"], "value", {"hi": upper, "lo": lower})
    marked = _pair_rows(rows, pairs).join(F.broadcast(cuts), "var_x")  # one row per variable
    up, down = F.col("x") >= F.col("hi"), F.col("x") <= F.col("lo")

    def corr_where(cond: Column) -> Column:
        x, y = F.when(cond, F.col("x")), F.when(cond, F.col("y"))
        return F.when(F.count_if(cond) > min_rows, safe_corr(x, y))

    return marked.groupBy("var_x", "var_y").agg(
        corr_where(up).alias("upper_tail"), corr_where(down).alias("lower_tail")).withColumn(
        "tail_asymmetry", F.col("upper_tail") - F.col("lower_tail"))


def pair_dependence(df: DataFrame, variables: Sequence[str], *, min_rows: int = 50) -> DataFrame:
    """Pearson, Spearman and Kendall with p-values, tail correlations, type and strength per pair.

    The (pair, x, y) counts are written once to the checkpoint folder: Kendall's ties and every step of the
    discordance count read them.
    """
    rows, pairs = _complete(df, variables), _pairs(variables, False)
    keys = ["var_x", "var_y"]
    cells = stored(_pair_cells(rows, pairs))
    table = (
        _pearson(rows, pairs).filter(F.col("n") >= min_rows)
        .join(_spearman(rows, pairs, variables).drop("n"), keys)
        .join(_kendall(cells), keys)
        .join(tail_dependence(rows, pairs), keys)
    )
    rho, r, n = F.col("spearman"), F.col("pearson"), F.col("n").cast("double")
    tested = table.withColumn("spearman_p", F.when(rho.isNotNull() & (n > 2), correlation_p(rho, n)))
    # The labels of type and strength.
    return tested.withColumns({
        "dependency_type": F.when(F.abs(rho - r) < 0.1, "Linear")
        .when(F.abs(rho) > F.abs(r) + 0.1, "Monotonic (Non-linear)").otherwise("Non-monotonic"),
        "strength": F.when(F.abs(rho) > 0.5, "Strong").when(F.abs(rho) > 0.3, "Moderate").otherwise("Weak"),
    })


def dependence_mix(table: DataFrame) -> DataFrame:
    """Pairs by type and by strength with their share."""
    rows = table.select(F.explode(F.array(
        F.struct(F.lit("type").alias("kind"), F.col("dependency_type").alias("label")),
        F.struct(F.lit("strength").alias("kind"), F.col("strength").alias("label")))).alias("r")).select("r.*")
    counts = rows.groupBy("kind", "label").agg(F.count(F.lit(1)).alias("pairs"))
    return counts.withColumn("share_pct", F.col("pairs") / F.sum("pairs").over(Window.partitionBy("kind")) * 100.0)


def top_pairs(table: DataFrame, score: str, n: int, *, by_abs: bool = False, keep_ties: bool = False,
              keys: Sequence[str] = ("var_x", "var_y")) -> DataFrame:
    """Best pairs; with keep_ties every pair tied with the n-th is kept."""
    by = F.abs(score) if by_abs else F.col(score)
    if keep_ties:
        ranked = table.withColumn("_k", F.rank().over(Window.orderBy(by.desc_nulls_last())))  # one row per pair
        return ranked.filter(F.col("_k") <= n).drop("_k")
    return table.orderBy(by.desc_nulls_last(), *keys).limit(n)


def correlation_matrix(pairs: DataFrame, variables: Sequence[str], value: str = "corr", x: str = "stat_x", y: str = "stat_y") -> DataFrame:
    """Long pairs to a symmetric matrix with unit diagonal, one row per variable."""
    off = pairs.filter(F.col(x) != F.col(y)).select(F.explode(F.array(
        F.struct(F.col(x).alias("variable"), F.col(y).alias("other"), F.col(value).alias("v")),
        F.struct(F.col(y).alias("variable"), F.col(x).alias("other"), F.col(value).alias("v")))).alias("c")).select("c.*")
    wide = off.groupBy("variable").pivot("other", list(variables)).agg(F.first("v"))
    return wide.select("variable", *[
        F.when(F.col("variable") == v, F.lit(1.0)).otherwise(F.col(f"`{v}`")).alias(v) for v in variables])


def matrix_to_pairs(matrix: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Upper triangle of a matrix as (stat_x, stat_y, corr) rows."""
    long = matrix.unpivot(["variable"], list(variables), "other", "corr")
    place = F.create_map(*[c for i, v in enumerate(variables) for c in (F.lit(v), F.lit(i))])
    return long.filter(place[F.col("variable")] < place[F.col("other")]).select(
        F.col("variable").alias("stat_x"), F.col("other").alias("stat_y"), "corr")


def bin_table(long: DataFrame) -> DataFrame:
    """Per variable: n, min, max, mean, std and the Freedman-Diaconis bin count held in [5, 50] (10 without spread)."""
    counted = cumulative_counts(long, ["variable"], "value")
    spread = quantiles_of_counts(counted, ["variable"], "value", {"q25": 0.25, "q75": 0.75})
    sums = long.filter(F.col("value").isNotNull()).groupBy("variable").agg(
        F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"),
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
    width = 2 * (F.col("q75") - F.col("q25")) / F.pow(F.col("n").cast("double"), F.lit(1 / 3))
    bins = F.when(width > 0, F.ceil((F.col("hi") - F.col("lo")) / width)).otherwise(F.lit(10))
    return sums.join(spread, "variable").withColumn("n_bins", F.least(F.greatest(bins, F.lit(5)), F.lit(50)).cast("int"))


def _bin_of(value: Column) -> Column:
    """Equal-width bin, the last bin closed; a constant variable sits in the middle bin."""
    span = F.col("hi") - F.col("lo")
    return F.when(span > 0, F.least(F.floor((value - F.col("lo")) / span * F.col("n_bins")), F.col("n_bins") - 1)).otherwise(
        F.floor(F.col("n_bins") / 2)).cast("int")


def entropy_table(df: DataFrame, variables: Sequence[str], *, min_rows: int = 100) -> DataFrame:
    """Histogram entropy in bits, normalised entropy, CV, bin count and variability class per variable."""
    long = unpivot(df, [], variables, "variable", "value").filter(F.col("value").isNotNull())
    bins = bin_table(long).filter(F.col("n") > min_rows)
    counts = value_counts(long, ["variable"], "value").join(F.broadcast(bins), "variable")  # one row per variable
    binned = counts.groupBy("variable", _bin_of(F.col("value")).alias("bin")).agg(F.sum("weight").alias("w"),
                                                                                F.first("n").alias("n"))
    share = F.col("w") / F.col("n")
    entropy = binned.groupBy("variable").agg((-F.sum(share * F.log2(share))).alias("entropy_bits"))
    level = F.col("normalized_entropy")
    return entropy.join(bins, "variable").select(
        "variable", (F.col("entropy_bits") + 0.0).alias("entropy_bits"),
        (F.col("entropy_bits") / F.log2("n_bins") + 0.0).alias("normalized_entropy"),
        F.try_divide("std", "mean").alias("coefficient_of_variation"), "n_bins",
    ).withColumn("variability", F.when(level > 0.7, "High").when(level > 0.4, "Moderate").otherwise("Low"))


def mutual_information(df: DataFrame, variables: Sequence[str], *, base: float | None = None, min_rows: int = 50) -> DataFrame:
    """(var_x, var_y, mi) with the diagonal, from joint bin counts over complete rows.

    A plug-in estimate in one unit throughout (nats unless `base` is given).
    """
    rows = _complete(df, variables)
    bins = bin_table(unpivot(rows, [], variables, "variable", "value")).filter(F.col("n") >= min_rows)
    small = bins.select("variable", "lo", "hi", "n_bins")
    # One row per variable, reduced to one row of named bounds.
    bounds = small.agg(F.map_from_entries(F.collect_list(F.struct("variable", F.struct("lo", "hi", "n_bins")))).alias("m")).scalar()
    placed = rows.withColumn("_m", bounds)
    def code(v: str) -> Column:
        b = F.col("_m")[v]
        span = b["hi"] - b["lo"]
        return F.when(span > 0, F.least(F.floor((F.col(v) - b["lo"]) / span * b["n_bins"]), b["n_bins"] - 1)).otherwise(
            F.floor(b["n_bins"] / 2)).cast("double")
    coded = placed.filter(F.size("_m") > 0).select(*[code(v).alias(v) for v in variables])
    cells = _pair_cells(coded, _pairs(variables, True))
    def margin(side: str) -> DataFrame:
        return cells.groupBy("var_x", "var_y", side).agg(F.sum("cell").alias(f"m{side}"))
    joint = cells.join(margin("x"), ["var_x", "var_y", "x"]).join(margin("y"), ["var_x", "var_y", "y"])
    total = cells.groupBy("var_x", "var_y").agg(F.sum("cell").alias("n"))
    c, n = F.col("cell").cast("double"), F.col("n").cast("double")
    gain = c / n * F.ln(c * n / (F.col("mx").cast("double") * F.col("my")))
    unit = 1.0 if base is None else 1.0 / math.log(base)
    return joint.join(total, ["var_x", "var_y"]).groupBy("var_x", "var_y").agg((F.sum(gain) * unit).alias("mi"))


def trend_lines(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Least-squares slope, intercept, r2 and n of y on x per pair."""
    return _pair_rows(df.select(*[F.col(v).cast("double").alias(v) for v in sorted({v for p in pairs for v in p})]), pairs).groupBy(
        "var_x", "var_y").agg(
        F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"), F.regr_count("y", "x").alias("n"))


def pseudo_observations(df: DataFrame, x: str, y: str) -> DataFrame:
    """Distinct (x, y) cells with u = rank(x)/(n+1), v = rank(y)/(n+1) and their weight."""
    rows = _complete(df, [x, y])
    long = unpivot(rows, [], [x, y], "variable", "value")
    u = average_ranks(long, ["variable"], "value").select("variable", "value", (F.col("avg_rank") / (F.col("n") + 1)).alias("u"))
    cells = rows.groupBy(x, y).agg(F.count(F.lit(1)).alias("weight"))
    ux = u.filter(F.col("variable") == x).select(F.col("value").alias(x), F.col("u"))
    uy = u.filter(F.col("variable") == y).select(F.col("value").alias(y), F.col("u").alias("v"))
    return cells.join(ux, x).join(uy, y).select(x, y, "weight", "u", "v")


def rank_density(df: DataFrame, x: str, y: str, grid: int = 30) -> DataFrame:
    """Counts on a grid over the rank-transformed unit square."""
    cells = pseudo_observations(df, x, y)
    return cells.groupBy(F.floor(F.col("u") * grid).cast("int").alias("bin_x"), F.floor(F.col("v") * grid).cast("int").alias("bin_y")).agg(
        F.sum("weight").alias("rows"))
