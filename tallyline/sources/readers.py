"""Validated readers."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .. import schemas
from ..functions.exprs import clamp_negative, to_number


class DataLoadError(Exception):
    """A file is missing or lacks required columns."""


def read_csv(spark: SparkSession, path: str, schema: T.StructType, required: Iterable[str] = ()) -> DataFrame:
    """Header CSV as text, checked for columns, then typed; unreadable values become NULL.

    Types come from `schema`, never from the data, so the file is scanned once.
    """
    try:
        raw = spark.read.option("header", True).csv(path)
    except AnalysisException as error:
        raise DataLoadError(f"cannot read {path}: {error.getCondition()}") from error
    missing = sorted(set(required) - set(raw.columns))
    if missing:
        raise DataLoadError(f"{path} lacks required columns {missing}")
    types = {f.name: f.dataType for f in schema.fields}
    typed = []
    for name in raw.columns:
        kind = types.get(name)
        if isinstance(kind, T.DoubleType):
            typed.append(to_number(name).alias(name))
        elif kind is None or isinstance(kind, T.StringType):
            typed.append(F.col(name))
        else:
            typed.append(F.col(name).try_cast(kind).alias(name))
    return raw.select(*typed)


def clean_game_logs(df: DataFrame, stats: Sequence[str] = ("pts", "fg3m", "ast", "reb")) -> DataFrame:
    """Stats to numbers, negatives to 0."""
    present = [s for s in stats if s in df.columns]
    return df.withColumns({s: clamp_negative(to_number(s)) for s in present})


def clean_quoted_lines(df: DataFrame) -> DataFrame:
    """Keep lines at or above 0 (an absent line is dropped as well)."""
    return df.filter(F.col("line") >= 0)


def clean_ticket_legs(df: DataFrame) -> DataFrame:
    """Lower-case the direction, keep over/under only, and make a stake of 0 or less one unit."""
    kept = df.withColumn("direction", F.lower("direction")).filter(F.col("direction").isin("over", "under"))
    if "stake" in df.columns:
        kept = kept.withColumn("stake", F.when(F.col("stake") <= 0, 1.0).otherwise(F.col("stake")))
    return kept


def read_game_logs(spark: SparkSession, path: str) -> DataFrame:
    return clean_game_logs(read_csv(spark, path, schemas.GAME_LOGS, schemas.GAME_LOGS_REQUIRED))


def read_quoted_lines(spark: SparkSession, path: str) -> DataFrame:
    return clean_quoted_lines(read_csv(spark, path, schemas.QUOTED_LINES, schemas.QUOTED_LINES_REQUIRED))


def read_ticket_legs(spark: SparkSession, path: str) -> DataFrame:
    return clean_ticket_legs(read_csv(spark, path, schemas.TICKET_LEGS, schemas.TICKET_LEGS_REQUIRED))


def read_season_box(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, schemas.SEASON_BOX, ("gameDate",))


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table; NaN in a floating-point column becomes NULL."""
    table = spark.read.parquet(path)
    return table.select(*[
        F.when(~F.isnan(c), c).alias(name) if kind in ("double", "float") else c
        for (name, kind), c in ((f, F.col(f"`{f[0]}`")) for f in table.dtypes)])


def template_props(spark: SparkSession, template: Mapping) -> DataFrame:
    """A nested template as (leg, leg_name, prop, player, stat, line, over); legs count from 1."""
    legs = [
        (leg["name"], [(p["player"], p["stat"], float(p["line"]), bool(p["over"])) for p in leg["props"]])
        for leg in template["legs"]
    ]
    nested = spark.createDataFrame([(template["name"], legs)], schemas.TEMPLATE)
    return (
        nested.select(F.posexplode("legs").alias("leg", "l"))
        .select((F.col("leg") + 1).alias("leg"), F.col("l.name").alias("leg_name"),
                F.posexplode("l.props").alias("prop", "p"))
        .select("leg", "leg_name", (F.col("prop") + 1).alias("prop"), "p.*")
    )


def ticket_props(spark: SparkSession, tickets: Sequence[Mapping]) -> DataFrame:
    """Dated tickets as (ticket, date, odds, prop, player, stat, line, over); odds default to 1.0."""
    rows = [
        (
            t["date"] if isinstance(t["date"], date) else date.fromisoformat(t["date"]),
            t.get("odds"),
            [(p["player"], p["stat"], float(p["line"]), bool(p["over"])) for p in t["props"]],
        )
        for t in tickets
    ]
    nested = spark.createDataFrame([(i, *r) for i, r in enumerate(rows, 1)],
                                   T.StructType([T.StructField("ticket", T.IntegerType()), *schemas.TICKET.fields]))
    return nested.select(
        "ticket", "date", F.coalesce("odds", F.lit(1.0)).alias("odds"), F.posexplode("props").alias("prop", "p")
    ).select("ticket", "date", "odds", (F.col("prop") + 1).alias("prop"), "p.*")
