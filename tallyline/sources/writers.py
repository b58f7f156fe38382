"""Sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet, replacing what is there; facts are usually partitioned by date.

    A partitioned write first gathers each partition value's rows, spread over
    several writers when adaptive execution finds a large one.
    """
    if partition_by:
        df.hint("rebalance", *[F.col(c) for c in partition_by]).write.mode("overwrite").partitionBy(
            *partition_by
        ).parquet(path)
    else:
        df.write.mode("overwrite").parquet(path)


def write_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def key_values(row: DataFrame, section: str) -> DataFrame:
    """A one-row table as (section, key, value) text rows."""
    texts = row.select(*[F.col(c).cast("string").alias(c) for c in row.columns])
    return texts.unpivot([], list(row.columns), "key", "value").select(F.lit(section).alias("section"), "key", "value")


def write_report(sections: DataFrame, path: str) -> None:
    """The (section, key, value) rows as one small CSV file."""
    sections.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
