"""What the corpus operators share: input columns, tables in the shared folder, work on Arrow batches."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import ensure_checkpoint_dir

# The characters the contracts call white space.
BLANKS = b" \t\n\x0b\x0c\r"


def named(name: str) -> Column:
    return F.col(f"`{name}`")


def keyed_text(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text): only the two columns an operator reads, so that no other column can clash; a NULL text is empty."""
    return docs.select(named(id_col).alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"))


def unused(name: str, columns: list[str]) -> str:
    """A name that no column has, in any letter case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_text(column: Column) -> Column:
    """The id as the text that splits and samples hash; a NULL id counts as empty."""
    return F.coalesce(column.cast("string"), F.lit(""))


def stored(df: DataFrame) -> DataFrame:
    """Write a table to the cluster's shared folder and read it again: lineage ends here, and a lost executor costs nothing.

    The folder goes when the driver ends.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/table-{uuid.uuid4()}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended before the driver: the folder is the cluster's to clear
        pass


def discard(table: DataFrame) -> None:
    """Remove the files of a stored table that no later step reads."""
    for path in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
        _remove(table.sparkSession, path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Within, Spark removes the shuffle files of a step when its result is written, not when the driver happens to collect garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, rows: int | None = None) -> DataFrame:
    """Apply a function of one Arrow batch to every batch, or to stretches of `rows` rows of it; each may give none."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows or max(1, batch.num_rows)):
                out = function(batch.slice(at, rows) if rows else batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def same_key(left: Column, right: Column) -> Column:
    """Equality under which a missing id equals a missing id."""
    return left.eqNullSafe(right)


def remainder(id_column: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo: how the contracts split training rows from held-out ones."""
    return F.pmod(F.crc32(id_text(id_column).cast("binary")), F.lit(modulus))


# Words of 64 bits in a filter of ids, at most.
FILTER_WORDS = 1 << 18


def may_be_among(rows: DataFrame, id_col: str, wanted: DataFrame, wanted_col: str) -> DataFrame:
    """The rows whose id may be among the wanted ones: all of those, and some others, fewer the fewer ids are wanted.

    A broadcast filter of one hash, some eight bits an id up to FILTER_WORDS words; no row moves.  It is for joins that follow.
    Ids of other kinds than the wanted ones, or that can be equal with other bytes, all may be.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    if kind != wanted.schema[wanted_col].dataType.simpleString() or kind not in ("tinyint", "smallint", "int", "bigint", "string", "date"):
        return rows
    words, ids = 1, wanted.count()
    while words < FILTER_WORDS and 8 * words < ids:
        words *= 2

    def place(column: str) -> Column:
        return F.pmod(F.xxhash64(named(column)), F.lit(64 * words))

    def bit(at: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(at, F.lit(64)).cast("int"))

    at = unused("at", rows.columns)
    bits = wanted.select(place(wanted_col).alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(F.bit_or(bit(F.col("at"))).alias("bits"))
    bits = F.broadcast(bits.select(F.col("word").alias(f"{at}_word"), F.col("bits").alias(f"{at}_bits")))
    met = rows.withColumn(at, place(id_col)).join(bits, F.floor(F.col(at) / 64) == F.col(f"{at}_word"))
    return met.filter(F.col(f"{at}_bits").bitwiseAND(bit(F.col(at))) != 0).select(*[named(c) for c in rows.columns])


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, use: Callable[[Column], Column], fit_rows: int | None = None,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id, text, label): the labelled documents of which `use(id)` holds, all of them or at most `fit_rows` chosen by a hash of the id.

    A bound makes the chosen ids fit to broadcast, so that no text moves to meet its label.  A missing label or id is no label; of several
    labels of a document the largest counts; of equal texts the one with the smallest id stays.
    """
    ids = labels.select(named(id_col).alias("labelled"), named(label).cast("int").alias("label")).filter("labelled IS NOT NULL AND label IS NOT NULL")
    chosen = ids.filter(use(F.col("labelled"))).groupBy("labelled").agg(F.max("label").alias("label"))
    rows = keyed_text(docs, id_col, text_col)
    if fit_rows is not None:
        chosen = F.broadcast(chosen.orderBy(F.xxhash64(id_text(F.col("labelled"))), "labelled").limit(fit_rows))
        met = rows.join(chosen, rows["id"] == chosen["labelled"])
        return met.groupBy(F.sha2("text", 256).alias("same")).agg(F.min(F.struct("id", "text", "label")).alias("r")).select("r.*")
    # Ids and digests alone say which texts count, so that a text moves once, and few that have no label.
    rows = may_be_among(rows.filter(use(F.col("id"))), "id", chosen, "labelled").withColumn("same", F.unhex(F.sha2("text", 256)))
    met = rows.select("id", "same").join(chosen, F.col("id") == F.col("labelled"))
    first = met.groupBy(F.col("same").alias("own")).agg(F.min(F.struct("id", "label")).alias("r")).select("own", F.col("r.id").alias("least"), "r.label")
    kept = rows.join(first, (F.col("same") == F.col("own")) & (F.col("id") == F.col("least")))
    return kept.groupBy("own", "least").agg(F.min(F.struct("id", "text", "label")).alias("r")).select("r.*")
