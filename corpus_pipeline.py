"""Documents to training sequences, in stages; each stage's rows are written as Parquet and read as the next one's documents.

In every stage a NULL text counts as empty, a NULL id is an id of its own, rows repeating an id are judged each by their own
text, ties go to the smallest id, an empty table gives an empty one, and further columns pass unread until the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallyline.llm.common import remainder, stored
from tallyline.llm.decontaminate import keep_clean
from tallyline.llm.exact_dedup import keep_first
from tallyline.llm.packing import pack_documents
from tallyline.llm.queries import PACKING_TOKENIZER, TOXIC_FOLDS, TOXIC_HELD_OUT, public_tokenizer, table
from tallyline.llm.simhash import keep_one, keep_unlike
from tallyline.llm.toxicity import fit_labels, keep_mild


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.3 or more go."""
    model = fit_labels(docs, table(spark, sf_dir, "labels"), lambda c: remainder(c, TOXIC_FOLDS) != TOXIC_HELD_OUT)
    return keep_mild(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space the longest stays, then the smallest id."""
    return keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by fingerprints the smallest id stays, then of those that share 0.8 of their five-word shingles."""
    return keep_unlike(keep_one(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words a twentieth or more lie in benchmark windows go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents and their places in the training sequences."""
    pieces = pack_documents(docs, public_tokenizer(PACKING_TOKENIZER))
    return pieces.select(F.col("id").alias("doc_id"), "piece", "start", "length", F.col("crc").alias("ids_crc32"), "sequence_id", "offset")


STAGES = [
    ("toxicity", drop_toxic), ("exact_dedup", drop_exact_copies), ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated), ("packing", pack),
]

# Decoding, fingerprints and packing cannot be stated in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if place < len(STAGES) - 1:
            docs = stored(docs)
    return docs
