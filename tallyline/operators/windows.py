"""Order-dependent operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ordered import Arranged, arrange, before_piece, finish, running, with_carry, with_row_frames


def rest_days(df: DataFrame, *, entity: str = "player_id", date: str = "game_date",
              tiebreak: str = "game_id", out: str = "days_rest") -> DataFrame:
    """Days since the entity's previous row; the first row gets the median gap of all rows.

    A row without a date has no gap and gets the median.  The median is taken over per-(entity, date) counts: of c rows on a date one
    carries the gap to the date before and c-1 carry 0, so only dates are ordered.
    """
    dated = with_row_frames(
        df.filter(F.col(entity).isNotNull()), [entity], [F.col(date).asc(), F.col(tiebreak).asc()],
        lambda w: {out: F.datediff(F.col(date), F.lag(date).over(w)).cast("double")}, reach=1,
    )
    days = df.filter(F.col(entity).isNotNull() & F.col(date).isNotNull()).groupBy(entity, date).agg(F.count(F.lit(1)).alias("rows"))
    by_day = Window.partitionBy(entity).orderBy(date)
    spaced = days.withColumn("gap", F.datediff(F.col(date), F.lag(date).over(by_day)))
    gaps = spaced.select(F.explode(F.array(
        F.struct("gap", F.lit(1).cast("long").alias("rows")),
        F.struct(F.lit(0).alias("gap"), (F.col("rows") - 1).alias("rows")),
    )).alias("g")).select("g.*").filter("gap is not null and rows > 0")
    # Gaps are whole days, so this table has at most one row per day of the data's span.
    median = gaps.groupBy("gap").agg(F.sum("rows").alias("rows")).agg(F.percentile("gap", 0.5, F.col("rows"))).scalar()
    return dated.withColumn(out, F.coalesce(F.col(out), median))


def rolling_means(df: DataFrame, columns: Sequence[str], windows: Sequence[int] = (5, 10, 20), *,
                  entity: str = "player_id", date: str = "game_date", tiebreak: str = "game_id") -> DataFrame:
    """Mean of the previous w rows of the entity, the current row excluded."""
    def frames(w):
        return {f"{c}_rolling_{n}": F.avg(c).over(w.rowsBetween(-n, -1)) for c in columns for n in windows}
    return with_row_frames(df.filter(F.col(entity).isNotNull()), [entity],
                           [F.col(date).asc(), F.col(tiebreak).asc()], frames, reach=max(windows))


def trailing_mean(df: DataFrame, column: str, size: int, *, order: Sequence[str], keys: Sequence[str] = (),
                  out: str | None = None) -> DataFrame:
    """Mean of the current and the size-1 rows before it."""
    return with_row_frames(df, list(keys), [F.col(o).asc() for o in order],
                           lambda w: {out or f"{column}_trailing_{size}": F.avg(column).over(w.rowsBetween(1 - size, 0))},
                           reach=size)


def profit(hit: str, odds: str, stake: str | Column) -> Column:
    """stake*(odds-1) on a hit, -stake otherwise."""
    s = F.col(stake) if isinstance(stake, str) else stake
    return F.when(F.col(hit) == 1, s * (F.col(odds) - 1.0)).otherwise(-s)


def _curve(df: DataFrame, keys: Sequence[str], order: Sequence[str], hit: str, odds: str, stake: str) -> Arranged:
    """Rows with profit, cum_profit, running_max and drawdown.

    Of a split layout each piece is summed up by its total and its highest running sum; those compose, so one pass over
    the rows gives what every piece starts from, and a second one the rows.
    """
    staked = df.withColumn("profit", profit(hit, odds, stake))
    arranged = arrange(staked, keys, [F.col(o).asc() for o in order])
    upto = arranged.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = arranged.df.withColumn("cum_profit", F.sum("profit").over(upto)).withColumn("running_max", F.max("cum_profit").over(upto))
    if arranged.split:
        earlier = before_piece(keys)
        pieces = rows.groupBy(*keys, "_piece").agg(F.sum("profit").alias("_total"), F.max("cum_profit").alias("_top"))
        pieces = pieces.withColumn("_sum", F.sum("_total").over(earlier))
        peak = F.max(F.col("_top") + F.coalesce("_sum", F.lit(0.0))).over(earlier)
        carried = with_carry(arranged, rows, pieces, {"_sum": F.col("_sum"), "_peak": peak})
        start = F.coalesce("_sum", F.lit(0.0))
        rows = carried.withColumns({
            "cum_profit": F.when(F.col("cum_profit").isNull(), F.col("_sum")).otherwise(F.col("cum_profit") + start),
            "running_max": F.greatest("_peak", F.col("running_max") + start)}).drop("_sum", "_peak")
    return Arranged(rows.withColumn("drawdown", F.col("running_max") - F.col("cum_profit")), arranged.keys, arranged.order, arranged.split)


def equity_curve(df: DataFrame, *, order: Sequence[str], hit: str = "builder_hit", odds: str = "decimal_odds",
                 stake: str = "stake", keys: Sequence[str] = ()) -> DataFrame:
    """profit, cum_profit, running_max (from the first value on) and drawdown per row.

    `order` must be total inside `keys`.
    """
    return finish(_curve(df, keys, order, hit, odds, stake).df)


def drawdown_summary(df: DataFrame, *, order: Sequence[str], hit: str = "builder_hit", odds: str = "decimal_odds",
                     stake: str = "stake", keys: Sequence[str] = ()) -> DataFrame:
    """max_drawdown, max_drawdown_period, final_profit, max_profit, roi_pct, n_bets.

    A period is a run of rows below the peak; rows at the peak number the runs of a piece.  What a piece of a split
    layout leaves is its longest run and the runs open at its two ends, which join those of its neighbours.
    """
    curve = _curve(df, keys, order, hit, odds, stake)
    below = F.col("drawdown") > 0
    upto = curve.window().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    numbered = curve.df.withColumn("_run", F.sum(F.when(below, 0).otherwise(1)).over(upto))
    piece = ["_piece"] if curve.split else []
    by_run = numbered.groupBy(*keys, *piece, "_run").agg(
        F.count_if(below).alias("length"), F.max("drawdown").alias("deepest"), F.max("cum_profit").alias("top"),
        F.sum("profit").alias("profit"), F.sum(stake).alias("staked"), F.count(F.lit(1)).alias("bets"),
    )
    sums = [F.max("deepest").alias("deepest"), F.max("length").alias("longest"), F.sum("profit").alias("profit"), F.max("top").alias("top"),
            F.sum("staked").alias("staked"), F.sum("bets").alias("bets")]
    if curve.split:
        pieces = by_run.groupBy(*keys, "_piece").agg(
            *sums, F.max("_run").alias("peaks"), F.coalesce(F.max(F.when(F.col("_run") == 0, F.col("length"))), F.lit(0)).alias("lead"),
            F.max_by("length", "_run").alias("trail"))
        first = F.coalesce(F.sum("peaks").over(before_piece(keys)), F.lit(0))
        measured = ["deepest", "profit", "top", "staked", "bets"]

        def part(run: Column, length: Column, own: bool) -> Column:
            values = [(F.col(n) if own else F.lit(None).cast(pieces.schema[n].dataType)).alias(n) for n in measured]
            return F.struct(run.alias("run"), length.alias("length"), *values)

        # A piece's own figures go under no run; the runs open at its ends add to those of its neighbours.
        parts = pieces.withColumn("_first", first).select(*keys, F.explode(F.array(
            part(F.lit(None).cast("long"), F.col("longest"), True), part(F.col("_first"), F.col("lead"), False),
            part(F.col("_first") + F.col("peaks"), F.when(F.col("peaks") > 0, F.col("trail")).otherwise(0), False))).alias("e")).select(*keys, "e.*")
        by_run = parts.groupBy(*keys, "run").agg(
            F.max("deepest").alias("deepest"), F.sum("profit").alias("profit"), F.max("top").alias("top"), F.sum("staked").alias("staked"), F.sum("bets").alias("bets"),
            F.when(F.col("run").isNull(), F.max("length")).otherwise(F.sum("length")).alias("length"))
    return by_run.groupBy(*keys).agg(*sums).select(
        *keys, F.col("deepest").alias("max_drawdown"), F.col("longest").alias("max_drawdown_period"), F.col("profit").alias("final_profit"),
        F.col("top").alias("max_profit"), (F.try_divide("profit", "staked") * 100.0).alias("roi_pct"), F.col("bets").alias("n_bets"))


def streaks(df: DataFrame, won: str, *, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """win_streak and loss_streak at each row; a row without an outcome starts a streak of its own.

    Of a split layout a piece is summed up by its ends and the run open at its end, so rows are read twice.
    """
    arranged = arrange(df, keys, [F.col(o).asc() for o in order])
    w = arranged.window()
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = arranged.df.withColumn("_row", F.row_number().over(w))
    new = F.coalesce(F.col(won) != F.lag(won).over(w), F.lit(True))
    rows = rows.withColumn("_start", F.when(new, F.col("_row"))).withColumn("_from", F.max("_start").over(upto))
    length = (F.col("_row") - F.col("_from") + 1).cast("long")
    if arranged.split:
        by_piece = Window.partitionBy(*keys).orderBy("_piece")
        pieces = rows.withColumn("_length", length).groupBy(*keys, "_piece").agg(
            F.min_by(F.struct(F.col(won).alias("v")), "_row").alias("_first"), F.max_by(F.struct(F.col(won).alias("v")), "_row").alias("_last"),
            F.count("_start").alias("_runs"), F.max_by("_length", "_row").alias("_open"))
        pieces = pieces.withColumn("_goes_on", F.coalesce(F.col("_first.v") == F.lag("_last").over(by_piece)["v"], F.lit(False)))
        pieces = pieces.withColumn("_chain", F.sum(F.when(F.col("_goes_on") & (F.col("_runs") == 1), 0).otherwise(1)).over(by_piece))
        chain = Window.partitionBy(*keys, "_chain").orderBy("_piece").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        pieces = pieces.withColumn("_length", F.sum("_open").over(chain))
        rows = with_carry(arranged, rows, pieces, {"_more": F.when(F.col("_goes_on"), F.lag("_length").over(by_piece))})
        length = length + F.when(F.col("_from") == 1, F.coalesce("_more", F.lit(0))).otherwise(0)
    return finish(rows.withColumns({
        "win_streak": F.when(F.col(won), length).otherwise(0).cast("long"),
        "loss_streak": F.when(~F.col(won), length).otherwise(0).cast("long"),
    }).drop("_start", "_from", "_more"))


def longest_streaks(df: DataFrame, won: str, *, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    return streaks(df, won, order=order, keys=keys).groupBy(*keys).agg(
        F.max("win_streak").alias("max_win_streak"), F.max("loss_streak").alias("max_loss_streak"))


def cumulative(df: DataFrame, totals: dict[str, Column], *, order: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Running sums under the given names, plus n_so_far."""
    return finish(running(arrange(df, keys, [F.col(o).asc() for o in order]),
                          {**{n: ("sum", c) for n, c in totals.items()}, "n_so_far": ("sum", F.lit(1).cast("long"))}))
