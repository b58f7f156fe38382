"""Session settings the library relies on."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows one window partition may hold before ordered work is range-split.
MAX_GROUP_ROWS = "spark.tallyline.maxGroupRows"
# Target rows per range-split piece.
CHUNK_ROWS = "spark.tallyline.chunkRows"

# Rows that a counted lookup table may have to be sent to every task.
BROADCAST_ROWS = "spark.tallyline.broadcastRows"

# Rows that a task should hold where a wide grouping, window or distinct count keeps them all.
TASK_ROWS = "spark.tallyline.taskRows"

# Training rows of all folds that are scored together; a fold with more is scored alone.
FOLD_ROWS = "spark.tallyline.foldRows"

_DEFAULTS = {MAX_GROUP_ROWS: 4_000_000, CHUNK_ROWS: 2_000_000, BROADCAST_ROWS: 500_000, TASK_ROWS: 250_000, FOLD_ROWS: 100_000_000}


def setting(spark: SparkSession, key: str) -> int:
    return int(spark.conf.get(key, str(_DEFAULTS[key])))


def tasks_for(spark: SparkSession, rows: int) -> int:
    """Tasks that keep each near TASK_ROWS rows, and no fewer than run at once."""
    return max(spark.sparkContext.defaultParallelism, math.ceil(rows / setting(spark, TASK_ROWS)))


def recommended(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Adaptive execution with skew-join splitting, checkpoints removed when no longer used; ANSI arithmetic stays on."""
    return (
        builder.config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    )


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared checkpoint folder; make one only in local mode."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="tallyline-checkpoint-")
    context.setCheckpointDir(folder)


def stored(df: DataFrame) -> DataFrame:
    """Write a table as Parquet to the shared checkpoint folder and read it again, so that later passes read only their columns.

    Lineage ends here and a lost executor costs nothing.  The folder goes when the driver ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/stored-{uuid.uuid4()}"
    for made in _MADE:
        made.append(path)
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


# Paths of the tables stored within each open `tables_removed`.
_MADE: list[list[str]] = []


@contextmanager
def tables_removed(spark: SparkSession) -> Iterator[None]:
    """Tables that are stored within are removed at its end."""
    _MADE.append(made := [])
    try:
        yield
    finally:
        _MADE[:] = [m for m in _MADE if m is not made]
        for path in made:
            _remove(spark, path)


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Within, the session has these settings; afterwards those it had."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# Spark removes the shuffle files of a step when its result is written, not when the driver happens to collect garbage.
SHUFFLES_REMOVED = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def stored_dealt(df: DataFrame) -> DataFrame:
    """`stored`, for joins and groupings of tables that were all dealt to as many tasks by one of the keys.

    Spark deals both sides of a join again unless they were dealt by all of its keys; within a query only this setting stops
    it, so the table is written at once.
    """
    with settings(df.sparkSession, {"spark.sql.requireAllClusterKeysForCoPartition": "false", **SHUFFLES_REMOVED}):
        return stored(df)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended before the driver: the folder is the cluster's to clear
        pass
