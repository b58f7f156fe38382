"""Alignment of two tokenizers' tokens by the places in the text where tokens of both end.

The ends of the tokens are two ascending lists of byte offsets.  The shorter drives: an exponential search from the last
place brackets each stretch of it in the longer list, a binary search inside the bracket finds the rank of each end.
Ends that both lists hold cut the tokens into groups; the difference of two ranks is how many tokens of the longer list a
token of the shorter one overlaps.

How often two ids end together is counted over all documents.  Of two such tokens the bytes of one end those of the other,
so the vocabularies alone bound the number of different pairs, whatever the corpus: that table may be broadcast.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import keyed_text, map_batches, stored
from .tokens import ByteBpe, PieceBpe, loaded

# Ends of the shorter list that one bracket serves.
_STRETCH = 128
# Pairs that a task holds before it merges them.
_MERGE_AT = 4_000_000


def ranks(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each value of `short` the number of values of `long` below it; both ascend, no value twice."""
    found, low, n = np.empty(len(short), np.int64), 0, len(long)
    for at in range(0, len(short), _STRETCH):
        part = short[at:at + _STRETCH]
        step = len(part)
        while low + step < n and long[low + step] < part[-1]:
            step *= 2
        found[at:at + len(part)] = low + np.searchsorted(long[low:low + step + 1], part)
        low = int(found[at + len(part) - 1])
    return found


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places in a, places in b) of the ends that both hold, and for each token of the shorter list how many of the longer it overlaps."""
    swap = len(a) > len(b)
    short, long = (b, a) if swap else (a, b)
    if not len(short):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    rank = ranks(short, long)
    hit = long[np.minimum(rank, len(long) - 1)] == short
    first = np.concatenate(([0], rank[:-1] + hit[:-1]))
    overlapped = np.minimum(rank, len(long) - 1) - first + 1
    in_short, in_long = np.flatnonzero(hit), rank[hit]
    return (in_long, in_short, overlapped) if swap else (in_short, in_long, overlapped)


class Pair:
    """Both vocabularies, with the texts of their ids by what follows each in a written group."""

    def __init__(self, byte_path: str, piece_path: str):
        self.a, self.b = loaded(ByteBpe, byte_path, True), loaded(PieceBpe, piece_path)
        self.length_a, self.length_b = (np.array([len(x) for x in v.bytes]) for v in (self.a, self.b))
        most = max(len(self.a.bytes), len(self.b.bytes))
        self.written = [f"{i}{mark}" for mark in ",|;" for i in range(most)]
        self.most = most

    def encoded(self, text: str) -> tuple[np.ndarray, np.ndarray] | None:
        """The ids of both, or None if the bytes of one's tokens are not those of the text behind a space."""
        if not text:
            return None
        spaced = " " + text
        a, b, data = self.a.ids(spaced), self.b.ids(text), spaced.encode()
        if b"".join(map(self.a.bytes.__getitem__, a.tolist())) != data or b"".join(map(self.b.bytes.__getitem__, b.tolist())) != data:
            return None
        return a, b

    def groups(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        """a1,a2|b1;a3|b2,b3: the groups that end at the given places of a and b."""
        size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        place_a = np.arange(len(a)) + np.repeat(at_b + 1 - size_b, size_a)
        place_b = np.arange(len(b)) + np.repeat(at_a + 1, size_b)
        mark_a, mark_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        mark_a[at_a], mark_b[at_b] = self.most, 2 * self.most
        order = np.empty(len(a) + len(b), np.int64)
        order[place_a], order[place_b] = a + mark_a, b + mark_b
        return "".join(map(self.written.__getitem__, order.tolist()))[:-1]


def pair_dtype(pair: Pair) -> np.dtype:
    return np.dtype("<u4") if len(pair.a.bytes) * len(pair.b.bytes) <= 1 << 32 else np.dtype("<u8")


def alignments(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_overlaps, groups_sha256, pairs [, groups]) of every row.

    `pairs`: the linked ids in order as numbers a * size of B + b, little endian.  A link is a token of each that end together;
    no token is without bytes, so each group has one.  `n_overlaps`: pairs of tokens that share a byte.
    A NULL or empty text, and one whose tokens do not spell it, has no tokens: zeros and an empty string.
    Rows repeating an id each give their row.
    """
    rows = keyed_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        pair = loaded(Pair, byte_path, piece_path)
        dtype, numbers, shas, links, texts = pair_dtype(pair), [], [], [], []
        for text in batch.column(1).to_pylist():
            both = pair.encoded(text)
            if both is None:
                numbers.append((0, 0, 0, 0, 0))
                shas.append("")
                links.append(b"")
                texts.append("")
                continue
            a, b = (x.astype(np.int64) for x in both)
            at_a, at_b, overlapped = common_ends(np.cumsum(pair.length_a[a]), np.cumsum(pair.length_b[b]))
            written = pair.groups(a, b, at_a, at_b)
            numbers.append((len(a), len(b), len(at_a), len(at_a), int(overlapped.sum())))
            shas.append(hashlib.sha256(written.encode()).hexdigest())
            links.append((a[at_a] * len(pair.b.bytes) + b[at_b]).astype(dtype).tobytes())
            texts.append(written)
        columns = [batch.column(0), *(pa.array(n, pa.int64()) for n in zip(*numbers)), pa.array(shas, pa.string()), pa.array(links, pa.binary())]
        names = ["id", "n_a", "n_b", "n_groups", "n_links", "n_overlaps", "groups_sha256", "pairs"]
        if with_groups:
            columns.append(pa.array(texts, pa.string()))
            names.append("groups")
        return pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_overlaps bigint, groups_sha256 string, pairs binary" + ", groups string" * with_groups
    return map_batches(rows, run, schema, 256)


def most_pairs(byte_path: str, piece_path: str) -> int:
    """How many pairs of ids can end together in any text: the bytes of one end those of the other."""
    pair = loaded(Pair, byte_path, piece_path)
    ids_a, ids_b = defaultdict(int), defaultdict(int)
    for known, ids in ((pair.a.bytes, ids_a), (pair.b.bytes, ids_b)):
        for token in known:
            ids[token] += 1
    shorter = sum(n * ids_b[t[i:]] for t, n in list(ids_a.items()) for i in range(len(t)) if t[i:] in ids_b)
    longer = sum(n * ids_a[t[i:]] for t, n in list(ids_b.items()) for i in range(1, len(t)) if t[i:] in ids_a)
    return shorter + longer


def pair_counts(aligned: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """(pair, n): links of each pair of ids over all rows, counted within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = pair_dtype(loaded(Pair, byte_path, piece_path))
        held, counts, waiting, size = np.empty(0, dtype), np.empty(0, np.int64), [], 0

        def merged():
            found, n = np.unique(np.concatenate([np.frombuffer(x, dtype) for x in waiting] or [held[:0]]), return_counts=True)
            keys, place = np.unique(np.concatenate((held, found)), return_inverse=True)
            return keys, np.bincount(place, np.concatenate((counts, n)), len(keys)).astype(np.int64)

        for batch in batches:
            for links in batch.column(0).to_pylist():
                waiting.append(links)
                size += len(links) // dtype.itemsize
                if size >= _MERGE_AT:
                    held, counts = merged()
                    waiting, size = [], 0
        held, counts = merged()
        yield pa.RecordBatch.from_arrays([pa.array(held.astype(np.int64)), pa.array(counts)], ["pair", "n"])

    parts = aligned.select("pairs").mapInArrow(run, "pair bigint, n bigint")
    return parts.groupBy("pair").agg(F.sum("n").alias("n"))


def align(docs: DataFrame, byte_path: str, piece_path: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> DataFrame:
    """The rows of `alignments` with n_best (links whose pair is the most frequent of its B id, ties included) and count_sum.

    An empty table gives an empty one.
    """
    aligned = stored(alignments(docs, byte_path, piece_path, id_col, text_col, with_groups))
    table = pair_counts(aligned, byte_path, piece_path).toArrow()
    bound = most_pairs(byte_path, piece_path)
    if table.num_rows > bound:  # the vocabularies' own bound: more would mean wrong links
        raise RuntimeError(f"{table.num_rows} pairs of ids where {bound} are possible")
    pair = loaded(Pair, byte_path, piece_path)
    codes, n = table.column("pair").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(codes)
    codes, n = codes[order].astype(pair_dtype(pair)), n[order]
    most = np.zeros(len(pair.b.bytes), np.int64)
    ids_b = (codes % len(pair.b.bytes)).astype(np.int64)
    np.maximum.at(most, ids_b, n)
    sent = aligned.sparkSession.sparkContext.broadcast((codes, n, n == most[ids_b]))
    rest = [c for c in aligned.columns if c != "pairs"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codes, n, best = sent.value
        n_best, count_sum = [], []
        for links in batch.column(batch.num_columns - 1).to_pylist():
            at = np.searchsorted(codes, np.frombuffer(links, codes.dtype))
            n_best.append(int(best[at].sum()))
            count_sum.append(int(n[at].sum()))
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64())], [*rest, "n_best", "count_sum"])

    kept = aligned.select(*rest, "pairs")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in aligned.select(*rest).schema) + ", n_best bigint, count_sum bigint"
    return map_batches(kept, run, schema)
