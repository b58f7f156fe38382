"""Exact medians of many overlapping groups at once, by bisection over counts.

Groups are unions of days (or of any other finer key), so values are counted by day and interval and only those counts are
dealt to the groups: no row is copied once per group, and nothing is sorted.  The first pass cuts the numbers into quarter
octaves; each further pass cuts the intervals that still hold a wanted rank into `bins` equal parts, whose least and
greatest values are the next interval.  An interval of one value is a result.  A quarter octave has fewer than 2^51
doubles, so with 1,024 bins some seven passes settle any data, and two or three most.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .exprs import unpivot


def _octave(v: Column) -> Column:
    """A whole number that never falls as the value grows."""
    size = F.floor(F.log2(F.abs(v)) * 4) + 5000
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("int")


def _counted(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("c"), F.min("value").alias("lo"), F.max("value").alias("hi"))


def _upto(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts of a group by bin with the count of all bins below; a group has at most one row per bin."""
    merged = counts.groupBy(*keys, "bin").agg(F.sum("c").alias("c"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    ordered = Window.partitionBy(*keys).orderBy("bin")
    return merged.withColumns({"before": F.sum("c").over(ordered) - F.col("c"), "n": F.sum("c").over(Window.partitionBy(*keys))})


def group_medians(
    rows: DataFrame, by: Sequence[str], features: Sequence[str], place: Callable[[DataFrame], DataFrame], bins: int = 1024,
) -> dict[tuple[int, str], float]:
    """(fold, feature) -> median of the feature's known values in the fold, the mean of both middle values if their number is even.

    `place` turns a table with the columns `by` into one with a column `fold` in their place, one row per fold that a row is
    in.  What is shuffled has at most a row for each `by` and interval; the driver keeps two ranks for each fold and feature.
    A fold without a known value of a feature has no entry.
    """
    spark = rows.sparkSession
    long = unpivot(rows.select(*by, *features), list(by), list(features), "feature", "value").filter(F.col("value").isNotNull())
    long = long.withColumn("octave", _octave(F.col("value")))
    first = _upto(place(_counted(long.withColumnRenamed("octave", "bin"), [*by, "feature", "bin"])), ["fold", "feature"])
    ranks = F.array(F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2))
    asked = first.withColumn("rank", F.explode(F.array_distinct(ranks))).filter("rank >= before AND rank < before + c")
    # Of each fold and feature the driver holds the two middle ranks, with the interval each is in.
    found: dict[tuple[int, str, int], float] = {}
    sizes, waiting = {}, []
    for r in asked.collect():
        sizes[r["fold"], r["feature"]] = r["n"]
        waiting.append((r["fold"], r["feature"], r["rank"], r["rank"] - r["before"], (r["feature"], r["bin"]), r["bin"], r["lo"], r["hi"]))
    while waiting:
        intervals: dict[tuple, list] = {}
        for fold, feature, rank, left, path, octave, lo, hi in waiting:
            if lo == hi:
                found[fold, feature, rank] = lo
            else:
                cut = intervals.setdefault(path, [len(intervals), feature, octave, lo, hi])
                cut[3], cut[4] = min(cut[3], lo), max(cut[4], hi)
        open_ranks = [(fold, intervals[path][0], rank, left) for fold, _, rank, left, path, _, lo, hi in waiting if lo != hi]
        if not open_ranks:
            break
        cuts = spark.createDataFrame([tuple(v) for v in intervals.values()], "cut int, feature string, octave int, low double, high double")
        wanted = spark.createDataFrame(open_ranks, "fold int, cut int, rank bigint, at bigint")
        span = F.col("high") - F.col("low")
        share = F.least(F.floor((F.col("value") - F.col("low")) / F.when(span > 0, span) * bins), F.lit(bins - 1))
        # At most one interval for each rank still open, disjoint within a feature.
        inside = long.join(F.broadcast(cuts), ["feature", "octave"]).filter(F.col("value").between(F.col("low"), F.col("high")))
        counts = _counted(inside.withColumn("bin", F.coalesce(share, F.lit(0)).cast("int")), [*by, "cut", "bin"])
        dealt = place(counts).join(F.broadcast(wanted.select("fold", "cut").distinct()), ["fold", "cut"])
        hit = _upto(dealt, ["fold", "cut"]).join(F.broadcast(wanted), ["fold", "cut"]).filter("at >= before AND at < before + c")
        paths = {v[0]: (p, v[1], v[2]) for p, v in intervals.items()}
        waiting = [(r["fold"], paths[r["cut"]][1], r["rank"], r["at"] - r["before"], (*paths[r["cut"]][0], r["bin"]), paths[r["cut"]][2], r["lo"], r["hi"])
                   for r in hit.collect()]
    middle = {}
    for (fold, feature), n in sizes.items():
        low, high = found[fold, feature, (n - 1) // 2], found[fold, feature, n // 2]
        middle[fold, feature] = low + (high - low) * 0.5
    return middle
