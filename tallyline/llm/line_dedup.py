"""Line deduplication: lines that several documents hold stay in the smallest id alone."""

from __future__ import annotations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import BLANKS, keyed_text, map_batches, same_key

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_CONTINUATION = bytes(range(0x80, 0xC0))


def line_key(line: bytes) -> bytes:
    """The line without blanks at both ends, A-Z lowered."""
    return line.strip(BLANKS).translate(_LOWER)


def key_hash(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the key of a line that is long enough to count, in code points."""
    key = line_key(line)
    chars = len(key) if key.isascii() else len(key.translate(None, _CONTINUATION))
    if chars < min_chars:
        return None
    return xxhash.xxh3_128_digest(key)


def line_hashes(rows: DataFrame, min_chars: int) -> DataFrame:
    """(id, hash): the distinct line keys of each row of (id, text)."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        at, hashes = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            own = {key_hash(line, min_chars) for line in text.encode().split(b"\n")}
            own.discard(None)
            at += [i] * len(own)
            hashes += own
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(hashes, pa.binary())], ["id", "hash"])

    return map_batches(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, hash binary")


def repeated_lines(rows: DataFrame, min_chars: int, min_docs: int) -> DataFrame:
    """(id, hashes): for each document the keys it loses, being held by `min_docs` documents and not owned by this one.

    The keys of a document are made distinct in its task and over its rows; the counts by key combine before they move.
    """
    held = line_hashes(rows, min_chars).distinct()
    counts = held.groupBy("hash").agg(F.count(F.lit(1)).alias("docs"), F.min(F.struct(F.col("id").isNotNull(), "id")).alias("first"))
    shared = counts.filter(F.col("docs") >= min_docs).select("hash", F.col("first.id").alias("owner"))
    lost = held.join(shared, "hash").filter(~F.col("id").eqNullSafe(F.col("owner")))
    return lost.groupBy("id").agg(F.collect_list("hash").alias("hashes"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2
) -> DataFrame:
    """(id, text, n_lines, n_dropped): every text without the lines repeated in other documents.

    Lines end at a line feed.  Keys of at least `min_chars` code points held by at least `min_docs` documents stay, with
    all their lines, in the smallest id alone (a NULL id is the smallest); other lines stay in order.  A NULL or empty text
    is one empty line.  Rows repeating an id are parts of one document.  An empty table gives no rows.
    """
    rows = keyed_text(docs, id_col, text_col)
    lost = repeated_lines(rows, min_chars, min_docs).withColumnRenamed("id", "lost_by")
    met = rows.join(lost, same_key(F.col("id"), F.col("lost_by")), "left").select("id", "text", "hashes")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, n_lines, n_dropped = [], [], []
        for text, hashes in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            lines = text.split("\n")
            kept = lines
            if hashes:
                drop = set(hashes)
                kept = [line for line in lines if key_hash(line.encode(), min_chars) not in drop]
            texts.append("\n".join(kept))
            n_lines.append(len(lines))
            n_dropped.append(len(lines) - len(kept))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())],
                                          ["id", "text", "n_lines", "n_dropped"])

    return map_batches(met, work, f"id {rows.schema['id'].dataType.simpleString()}, text string, n_lines bigint, n_dropped bigint")
