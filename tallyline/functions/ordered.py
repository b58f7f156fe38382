"""Ordered work (running totals, ranks, quantiles, row frames) that survives a hot group.

A plain window puts each group in one task.  Before one is used here, the largest
group is measured with a narrow count; when it exceeds the session's limit the rows
are range-partitioned on (group, order), written once to the checkpoint folder, and
handled piece by piece with a carry of at most one row per piece.  Both ways give
the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from ..session import CHUNK_ROWS, MAX_GROUP_ROWS, setting, stored
from .exprs import percentile_from_sorted

_PIECE = "_piece"
_ROW = "_row"
_BLOCK = "_block"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows in the biggest group; one narrow partial aggregate."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))
    return sizes.agg(F.max("rows")).first()[0] or 0


def largest_distinct(df: DataFrame, keys: Sequence[str], value: str) -> int:
    """An upper estimate of the distinct values in the widest group."""
    rows = largest_group(df, keys)
    if rows <= setting(df.sparkSession, MAX_GROUP_ROWS):
        return rows
    sketch = df.groupBy(*keys).agg(F.approx_count_distinct(value, 0.05).alias("d"))
    return min(rows, int(1.3 * (sketch.agg(F.max("d")).first()[0] or 0)))


@dataclass(frozen=True)
class Arranged:
    """Rows with a group and a total order inside it; `pieces` when range-split."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[Column, ...]
    split: bool

    def window(self) -> WindowSpec:
        parts = [*self.keys, _PIECE] if self.split else list(self.keys)
        return Window.partitionBy(*parts).orderBy(*self.order)


def arrange(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], group_rows: int | None = None
) -> Arranged:
    """Choose the plain or the range-split layout.

    `order` must be total inside a group.  `group_rows` is a known upper bound on
    the group size and saves the measuring job.
    """
    spark = df.sparkSession
    rows = largest_group(df, keys) if group_rows is None else group_rows
    if rows <= setting(spark, MAX_GROUP_ROWS):
        return Arranged(df, tuple(keys), tuple(order), False)
    pieces = max(2, math.ceil(df.count() / setting(spark, CHUNK_ROWS)))
    ranged = stored(
        df.repartitionByRange(pieces, *[F.col(k) for k in keys], *order)
        .withColumn(_PIECE, F.spark_partition_id()))
    return Arranged(ranged, tuple(keys), tuple(order), True)


def before_piece(keys: Sequence[str]) -> WindowSpec:
    """Over one row per group and piece: the group's earlier pieces."""
    return Window.partitionBy(*keys).orderBy(_PIECE).rowsBetween(Window.unboundedPreceding, -1)


def with_carry(arranged: Arranged, rows: DataFrame, summary: DataFrame, carry: dict[str, Column]) -> DataFrame:
    """Rows of a split layout with what their group hands on from its earlier pieces (NULL in its first one).

    `summary` has one row per group and piece, `carry` window expressions over it.  A piece continues at most one group,
    so what is broadcast has at most one row per piece.
    """
    keys = list(arranged.keys)
    earlier = F.count(F.lit(1)).over(before_piece(keys)) > 0
    handed = summary.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col(_PIECE).alias("_k_piece"),
                            *[c.alias(n) for n, c in carry.items()], earlier.alias("_continues")).filter("_continues").drop("_continues")
    same = F.col(_PIECE) == F.col("_k_piece")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return rows.join(F.broadcast(handed), same, "left").drop("_k_piece", *[f"_k_{k}" for k in keys])


def running(arranged: Arranged, totals: dict[str, tuple[str, Column]]) -> DataFrame:
    """Add running aggregates up to and including the current row.

    `totals` maps an output name to ("sum" | "max", expression).
    """
    combine = {"sum": F.sum, "max": F.max}
    upto = arranged.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = arranged.df.withColumns({n: combine[how](c).over(upto) for n, (how, c) in totals.items()})
    if not arranged.split:
        return local
    keys = list(arranged.keys)
    summary = arranged.df.groupBy(*keys, _PIECE).agg(*[combine[how](c).alias(f"_t_{n}") for n, (how, c) in totals.items()])
    joined = with_carry(arranged, local, summary, {f"_c_{n}": combine[how](f"_t_{n}").over(before_piece(keys)) for n, (how, _) in totals.items()})
    merged = {}
    for n, (how, _) in totals.items():
        here, there = F.col(n), F.col(f"_c_{n}")
        merged[n] = F.when(here.isNull(), there).otherwise(here + F.coalesce(there, F.lit(0))) if how == "sum" else F.greatest(here, there)
    return joined.withColumns(merged).drop(*[f"_c_{n}" for n in totals])


def finish(df: DataFrame) -> DataFrame:
    return df.drop(_PIECE, _ROW, _BLOCK)


def row_numbers(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str, group_rows: int | None = None
) -> DataFrame:
    return finish(running(arrange(df, keys, order, group_rows), {name: ("sum", F.lit(1).cast("long"))}))


def with_row_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    columns: Callable[[WindowSpec], dict[str, Column]],
    reach: int,
    group_rows: int | None = None,
) -> DataFrame:
    """Add window columns that look back at most `reach` rows.

    In the split layout rows are numbered inside their group and cut into blocks;
    the last `reach` rows of a block are repeated in front of the next one.
    """
    arranged = arrange(df, keys, order, group_rows)
    if not arranged.split:
        return df.withColumns(columns(arranged.window()))
    block_rows = max(setting(df.sparkSession, CHUNK_ROWS), reach)
    numbered = running(arranged, {_ROW: ("sum", F.lit(1).cast("long"))}).drop(_PIECE)
    block = F.floor((F.col(_ROW) - 1) / block_rows)
    near_end = (F.col(_ROW) - 1) % block_rows >= block_rows - reach
    repeated = numbered.withColumn(
        _BLOCK, F.explode(F.when(near_end, F.array(block, block + 1)).otherwise(F.array(block)))
    )
    spec = Window.partitionBy(*keys, _BLOCK).orderBy(_ROW)
    own = F.floor((F.col(_ROW) - 1) / block_rows) == F.col(_BLOCK)
    return finish(repeated.withColumns(columns(spec)).filter(own))


def heavy_keys(df: DataFrame, keys: Sequence[str], tasks: int) -> dict[int, int]:
    """Hash of each key that holds more rows than an even share of `tasks`, and how many shares it holds, rounded up.

    Counted by a map-side sketch of bounded size, so that a table's keys are never shuffled for it.  Fewer than `tasks` keys
    can exceed a share, which bounds what the driver is told.
    """
    key = F.xxhash64(*[F.col(f"`{k}`") for k in keys]).alias("_k")
    room = 1 << max(10, (16 * tasks - 1).bit_length())
    told = df.select(key).agg(F.count(F.lit(1)).alias("rows"), F.expr(f"approx_top_k(_k, {tasks}, {room})").alias("top")).first()
    share = max(1.0, told["rows"] / tasks)
    return {r["item"]: math.ceil(r["count"] / share) for r in told["top"] or [] if r["count"] > share}


def join_spread(left: DataFrame, right: DataFrame, keys: Sequence[str], tasks: int | None = None) -> DataFrame:
    """Inner join to a table with one row per key, a hot key's rows going to several tasks.

    A grouping by the same keys right after a plain join would keep a hot key in the join's one partition.  Keys with more
    rows of `left` than an even share of the tasks (the session's shuffle partitions) are found by a sketch; each is dealt
    over as many salts as it holds shares, and only its row of `right` is repeated.  Without one this is a plain join.  The
    salt is a hash of the row, so a repeated task agrees.  A NULL key meets nothing.
    """
    tasks = tasks or int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    heavy = heavy_keys(left.dropna(subset=list(keys)), keys, tasks)
    if not heavy:
        return left.join(right, list(keys))
    table = F.create_map(*[F.lit(x) for pair in heavy.items() for x in pair])
    salts = F.coalesce(F.try_element_at(table, F.xxhash64(*[F.col(f"`{k}`") for k in keys])), F.lit(1))
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in left.columns]), salts).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return salted.join(copies, [*keys, "_salt"]).drop("_salt")


def value_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """(keys, value, weight): combined on the map side, spread by value."""
    weighed = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(weighed.alias("weight"))


def cumulative_counts(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values with weight, upto (inclusive running weight) and n (group weight)."""
    spread = largest_distinct(df, keys, value)
    counts = value_counts(df, keys, value, weight)
    arranged = arrange(counts, keys, [F.col(value).asc()], spread)
    ran = running(arranged, {"upto": ("sum", F.col("weight"))})
    if not arranged.split:
        return ran.withColumn("n", F.sum("weight").over(Window.partitionBy(*keys)))
    ran = finish(ran)
    totals = arranged.df.groupBy(*keys).agg(F.sum("weight").alias("n"))
    if not keys:
        return ran.withColumn("n", totals.scalar())
    return join_spread(ran, totals, keys)


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Distinct values with their tie-averaged rank, weight, upto and n."""
    counted = cumulative_counts(df, keys, value, weight)
    return counted.withColumn("avg_rank", F.col("upto") - (F.col("weight") - 1) / 2.0)


def quantiles_of_counts(counted: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float],
                        extra: Sequence[Column] = ()) -> DataFrame:
    """Exact linear-interpolated quantiles from cumulative_counts rows."""
    aggs = []
    for name, p in probs.items():
        position = (F.col("n") - 1) * F.lit(float(p))
        aggs += [
            F.min(F.when(F.col("upto") > F.floor(position), F.col(value))).alias(f"_lo_{name}"),
            F.min(F.when(F.col("upto") > F.ceil(position), F.col(value))).alias(f"_hi_{name}"),
        ]
    grouped = counted.groupBy(*keys).agg(F.max("n").alias("_n"), *aggs, *extra)
    return grouped.withColumns({
        name: percentile_from_sorted((F.col("_n") - 1) * F.lit(float(p)), F.col(f"_lo_{name}"), F.col(f"_hi_{name}"))
        for name, p in probs.items()
    }).drop("_n", *[f"_lo_{n}" for n in probs], *[f"_hi_{n}" for n in probs])


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    return quantiles_of_counts(cumulative_counts(df, keys, value), keys, value, probs)


def profile(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float]) -> DataFrame:
    """n, mean, std, var (sample), min, max and exact quantiles per group.

    Both halves end partitioned by the keys, so joining them moves no rows again.
    """
    known = df.filter(F.col(value).isNotNull()).dropna(subset=list(keys)) if keys else df.filter(F.col(value).isNotNull())
    moments = known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.var_samp(value).alias("var"),
        F.min(value).alias("min"),
        F.max(value).alias("max"),
    )
    return moments.join(quantiles(known, keys, value, probs), list(keys))
