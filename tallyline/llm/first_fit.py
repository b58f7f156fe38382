"""Packing into padded sequences: first fit decreasing over a tournament tree, in randomised groups of documents.

Each task deals the documents it reads at random among a few open groups and packs a group as soon as it is full, so
nothing is shuffled and a task never holds more than its open groups.  Stretches of a whole sequence are cut off a long
document first; what is left of each document is placed whole, longest first, into the first sequence with room, which a
tournament tree over the room left finds in log time.  Only then are documents cut: the emptiest sequences of the group
are handed out to fill the others up to the brim, and what remains at the end makes sequences whose lengths are powers of
two, which need no padding.  So a group has no padding at all, and cuts few documents that would fit uncut.
"""

from __future__ import annotations

import random
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import keyed_text
from .tokens import ByteBpe, loaded

# Sequence numbers: the task, then the sequence within the task.
_TASK_SHIFT = 40


class Tournament:
    """Room left in bins 0 to n - 1; each inner node holds the larger room of its two children."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [capacity] * (2 * self.leaves)

    def first_fit(self, size: int) -> int:
        """Take `size` off the first bin that has the room; there must be one."""
        room, at = self.room, 1
        while at < self.leaves:
            at *= 2
            if room[at] < size:
                at += 1
        found = at - self.leaves
        room[at] -= size
        while at > 1:
            at //= 2
            room[at] = max(room[2 * at], room[2 * at + 1])
        return found


def pack_group(lengths: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences of (piece, start, stop): the pieces, each at most `capacity` long, with no padding needed.

    First fit decreasing (ties by position), then filling up.  Every sequence holds `capacity` or a power of two.
    """
    tree, bins = Tournament(len(lengths), capacity), []
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        at = tree.first_fit(lengths[piece])
        if at == len(bins):
            bins.append([])
        bins[at].append((piece, 0, lengths[piece]))
    held = [sum(lengths[p] for p, _, _ in b) for b in bins]
    done = [b for b, n in zip(bins, held) if n == capacity or n & (n - 1) == 0]
    open_bins = deque(sorted(([n, b] for b, n in zip(bins, held) if n != capacity and n & (n - 1)), key=lambda x: -x[0]))
    rest: list[tuple[int, int, int]] = []
    while open_bins:
        _, rest = open_bins.pop()
        while rest and open_bins:
            filled = open_bins[0]
            piece, start, stop = rest.pop()
            cut = min(stop, start + capacity - filled[0])
            filled[1].append((piece, start, cut))
            filled[0] += cut - start
            if cut < stop:
                rest.append((piece, cut, stop))
            if filled[0] == capacity:
                done.append(open_bins.popleft()[1])
    total = sum(stop - start for _, start, stop in rest)
    rest.reverse()
    for size in (1 << k for k in reversed(range(total.bit_length())) if total >> k & 1):
        sequence = []
        while size:
            piece, start, stop = rest.pop()
            cut = min(stop, start + size)
            sequence.append((piece, start, cut))
            size -= cut - start
            if cut < stop:
                rest.append((piece, cut, stop))
        done.append(sequence)
    return done


class _Group:
    def __init__(self):
        self.rows, self.tokens = [], 0  # (id, whole document's ids, first id not yet placed)


def pack_padded(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, end_id: int = 1,
    group_docs: int = 4096, group_tokens: int = 4_000_000, open_groups: int = 4, seed: int = 42, with_ids: bool = False,
) -> DataFrame:
    """(id, start, length, crc, doc_tokens, sequence_id, offset [, ids]): the pieces of every document and their places.

    A document is its ids and `end_id`; a NULL or empty text is the end id alone.  Rows repeating an id are documents of their
    own; equal lengths are taken in the order dealt; no rows give no rows.  A group is packed once it has `group_docs`
    documents or `group_tokens` tokens, whichever comes first.  What a task deals out follows from `seed` and its number.
    """
    rows = keyed_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    end = np.array([end_id], "<u4")

    def packed(groups: list[_Group], first: int, id_type: pa.DataType) -> pa.RecordBatch:
        members = [m for g in groups for m in g.rows]
        out = []
        sequences = pack_group([len(ids) - start for _, ids, start in members], capacity)
        for number, sequence in enumerate(sequences):
            offset = 0
            for member, start, stop in sequence:
                key, ids, before = members[member]
                out.append((key, before + start, ids[before + start:before + stop], len(ids), first + number, offset))
                offset += stop - start
        return _batch(out, id_type, with_ids), len(sequences)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part = loaded(ByteBpe, tokenizer, False), TaskContext.get().partitionId()
        deal, number = random.Random(f"{seed}:{part}"), part << _TASK_SHIFT
        groups, id_type = [_Group() for _ in range(open_groups)], None
        for batch in batches:
            id_type, whole = batch.schema.field(0).type, []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.concatenate((known.ids(text), end))
                rest = len(ids) - len(ids) % capacity
                for start in range(0, rest, capacity):
                    whole.append((key, start, ids[start:start + capacity], len(ids), number, 0))
                    number += 1
                if rest < len(ids):
                    at = deal.randrange(open_groups)
                    group = groups[at]
                    # A copy of the rest alone would lose the document's length; a view would keep a long document's ids.
                    group.rows.append((key, _Tail(ids[rest:].copy(), rest), rest))
                    group.tokens += len(ids) - rest
                    if len(group.rows) >= group_docs or group.tokens >= group_tokens:
                        out, n = packed([group], number, id_type)
                        yield out
                        number += n
                        groups[at] = _Group()
            if whole:
                yield _batch(whole, id_type, with_ids)
        if any(g.rows for g in groups):
            yield packed(groups, number, id_type)[0]

    schema = f"id {kind}, start bigint, length bigint, crc bigint, doc_tokens bigint, sequence_id bigint, offset bigint" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)


class _Tail:
    """The last ids of a document, read by their places in the whole document."""

    def __init__(self, ids: np.ndarray, before: int):
        self.ids, self.before = ids, before

    def __len__(self) -> int:
        return self.before + len(self.ids)

    def __getitem__(self, places: slice) -> np.ndarray:
        return self.ids[places.start - self.before:places.stop - self.before]


def _batch(rows: list[tuple], id_type: pa.DataType, with_ids: bool) -> pa.RecordBatch:
    keys, start, ids, doc_tokens, sequence, offset = map(list, zip(*rows))
    numbers = (start, [len(i) for i in ids], [zlib.crc32(i.tobytes()) for i in ids], doc_tokens, sequence, offset)
    columns = [pa.array(keys, id_type), *(pa.array(n, pa.int64()) for n in numbers)]
    names = ["id", "start", "length", "crc", "doc_tokens", "sequence_id", "offset"]
    if with_ids:
        columns.append(pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())))
        names.append("ids")
    return pa.RecordBatch.from_arrays(columns, names)


def token_sequences(pieces: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """(sequence_id, length, ids): the sequences themselves from pieces with ids, padded unless their length is a power of two.

    At most `capacity` ids meet in a group.
    """
    parts = pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    ids = F.flatten(F.col("parts.ids"))
    even = F.col("length").bitwiseAND(F.col("length") - 1) == 0
    missing = F.when(even, 0).otherwise(F.lit(capacity) - F.col("length")).cast("int")
    return parts.select("sequence_id", "length", F.concat(ids, F.array_repeat(F.lit(pad_id), missing)).alias("ids"))
