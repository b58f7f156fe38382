"""Packing documents into sequences: Martello-Toth dominance reduction, then best fit decreasing.

Only the counts of pieces by length matter to the packing, and there are at most `capacity` lengths.  So the driver packs
a histogram, whatever the size of the corpus: both steps place whole runs of equal pieces at once and give a plan of
slots, each saying where the pieces of one length, by rank, go.  Spark ranks the pieces of a length and looks them up.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from tokenizers import Tokenizer, pre_tokenizers

from .common import keyed_text, map_batches, stored

_SPLIT = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([.,;:!?%$&*#|]*)")
# Fixed value: the pre-tokens of tokenizers whose ids can be put together from letters and marks.
_PRE_TOKENS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_CACHE_LIMIT = 800_000


class WordIds(dict):
    """Ids, as little-endian bytes, of what stands between two breaks (space or line feed), kept in a bounded cache.

    For tokenizers that lower case, drop white space and know the pre-tokens above, no token spans a break and a stretch of
    letters with marks behind it is two pre-tokens; their ids come from the model alone.  Any other stretch, and with any
    other tokenizer the whole text, goes through the tokenizer.
    """

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        steps = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        cases = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        self.by_word = (cases == ["NFC", "Replace", "Lowercase"] and [s["type"] for s in steps] == ["Split", "ByteLevel"] and steps[0]["pattern"] == {"Regex": _PRE_TOKENS}
                        and steps[0]["behavior"] == "Removed" and steps[0]["invert"] and not steps[1]["add_prefix_space"])
        self.model = self.tokenizer.model
        level = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = {c: level.pre_tokenize_str(chr(c))[0][0] for c in range(0xC0, 0x100)}
        self.runs: dict[str, bytes] = {}

    def encoded(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def run(self, text: str) -> bytes:
        """Ids of one pre-token of lower-case letters or of marks."""
        if not text:
            return b""
        ids = self.runs.get(text)
        if ids is None:
            if len(self.runs) >= _CACHE_LIMIT:
                self.runs.clear()
            found = self.model.tokenize(text if text.isascii() else text.translate(self.written))
            ids = self.runs[text] = array("I", [t.id for t in found]).tobytes()
        return ids

    def __missing__(self, stretch: str) -> bytes:
        parts = _SPLIT.fullmatch(stretch)
        ids = self.run(parts[1].lower()) + self.run(parts[2]) if parts else self.encoded(stretch)
        if len(stretch) <= 64:
            if len(self) >= _CACHE_LIMIT:
                self.clear()
            self[stretch] = ids
        return ids

    def ids(self, text: str) -> bytes:
        if not self.by_word:
            return self.encoded(text)
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


_LOADED: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One for each worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]


def token_pieces(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """(id, piece, start, length, crc, part, rank [, ids]): the ids of every text and an end id, cut at `capacity`.

    `part` and `rank` number the pieces of one length within the task that made them.  A NULL text is empty and gives the
    end id alone; rows repeating an id each give their pieces.  `tokenizer` is a file that every executor can read.
    """
    rows = keyed_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, part, seen = word_ids(tokenizer), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            row, piece, start, length, crc, rank, ids = [], [], [], [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = known.ids(text) + end
                for p, at in enumerate(range(0, len(data), 4 * capacity)):
                    chunk = data[at:at + 4 * capacity]
                    n = len(chunk) // 4
                    row.append(i)
                    piece.append(p)
                    start.append(at // 4)
                    length.append(n)
                    crc.append(zlib.crc32(chunk))
                    rank.append(seen[n])
                    seen[n] += 1
                    if with_ids:
                        ids.append(np.frombuffer(chunk, "<u4").astype(np.int32))
            columns = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(row), pa.int32()), pa.array(rank, pa.int64())]
            names = ["id", "piece", "start", "length", "crc", "part", "rank"]
            if with_ids:
                columns.append(pa.array(ids, pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"id {kind}, piece int, start bigint, length bigint, crc bigint, part int, rank bigint" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, schema)


class Plan:
    """Bins by pattern.  A slot (length, first rank, first bin, offset, each) places pieces of one length from a rank on,
    `each` side by side in every bin from the first bin on."""

    def __init__(self, capacity: int):
        self.capacity, self.bins = capacity, 0
        self.ranks: dict[int, int] = defaultdict(int)
        self.slots: list[tuple[int, int, int, int, int]] = []

    def add(self, pattern: list[tuple[int, int]], bins: int) -> None:
        """`bins` bins that each hold, in order, `each` pieces of every (length, each)."""
        offset = 0
        for length, each in pattern:
            self.slots.append((length, self.ranks[length], self.bins, offset, each))
            self.ranks[length] += each * bins
            offset += length * each
        if offset > self.capacity:
            raise ValueError("a pattern is longer than its bin")
        self.bins += bins

    def arrays(self) -> tuple[np.ndarray, ...]:
        return tuple(np.array(sorted(self.slots), np.int64).reshape(-1, 5).T)


class _Lengths:
    """The lengths that still have pieces, in order, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.count = {k: n for k, n in counts.items() if n > 0}
        self.order = sorted(self.count)

    def take(self, length: int, n: int) -> None:
        self.count[length] -= n
        if self.count[length] == 0:
            del self.count[length]
            del self.order[bisect_left(self.order, length)]

    def largest(self, most: int) -> int | None:
        at = bisect_right(self.order, most)
        return self.order[at - 1] if at else None

    def smallest(self, n: int) -> list[int]:
        out: list[int] = []
        for k in self.order:
            out += [k] * min(n - len(out), self.count[k])
            if len(out) == n:
                break
        return out


def _dominant(left: _Lengths, item: int, capacity: int) -> list[int] | None:
    """Lengths that may be fixed in a bin with `item` (already taken out) without needing a bin more than the best packing.

    {item} alone if nothing fits with it.  {item, k}, k the largest that fits: if they fill the bin or if no two pieces fit
    with the item, since every other content of the bin then fits in the place of k.  {item, k, b} with b the largest beside
    both: if no three pieces fit, and of no two that fit is the smaller above b.
    """
    room = capacity - item
    k = left.largest(room)
    if k is None:
        return []
    small = left.smallest(3)
    if k == room or len(small) < 2 or small[0] + small[1] > room:
        return [k]
    if len(small) == 3 and sum(small) <= room:
        return None
    left_b = left.largest(room - k)
    if left_b == k and left.count[k] == 1:
        at = bisect_left(left.order, k)
        left_b = left.order[at - 1] if at else None
    if left_b is None:
        return None
    # The largest y that has a partner x >= y with x + y <= room.
    y = left.largest(room // 2)
    while y is not None and left.count[y] == 1:
        at = bisect_left(left.order, y) + 1
        if at < len(left.order) and left.order[at] + y <= room:
            break
        at -= 1
        y = left.order[at - 1] if at else None
    return [k, left_b] if y is None or y <= left_b else None


def reduced(left: _Lengths, capacity: int, plan: Plan) -> None:
    """Fix dominating sets, longest piece first, whole runs at a time, until no piece left has one."""
    while left.order and _one_pass(left, capacity, plan):
        pass


def _one_pass(left: _Lengths, capacity: int, plan: Plan) -> int:
    passed, begun = capacity, plan.bins
    while (item := left.largest(passed)) is not None:
        left.count[item] -= 1  # the piece itself; partners are looked for among the others
        if left.count[item] == 0:
            left.take(item, 0)
        partners = _dominant(left, item, capacity)
        if left.count.get(item) is None:
            left.count[item] = 1
            insort(left.order, item)
        else:
            left.count[item] += 1
        if partners is None:
            passed = item - 1
            continue
        pattern: dict[int, int] = defaultdict(int)
        for length in [item, *partners]:
            pattern[length] += 1
        bins = min(left.count[length] // each for length, each in pattern.items())
        plan.add(sorted(pattern.items(), reverse=True), bins)
        for length, each in pattern.items():
            left.take(length, each * bins)
    return plan.bins - begun


def best_fit(left: _Lengths, capacity: int, plan: Plan) -> None:
    """Longest first, each piece into the bin with the least room that takes it; bins of one content are one group."""
    rooms: list[int] = []
    groups: dict[int, list[tuple[int, tuple[tuple[int, int], ...]]]] = defaultdict(list)

    def put(room: int, bins: int, pattern: tuple[tuple[int, int], ...]) -> None:
        if bins:
            if not groups[room]:
                insort(rooms, room)
            groups[room].append((bins, pattern))

    for length in reversed(left.order):
        n = left.count[length]
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                bins, pattern = groups[room].pop()
                if not groups[room]:
                    rooms.pop(at)
            else:
                room, pattern = capacity, ()
                bins = -(-n // (capacity // length))
            each = room // length  # a bin just filled is the fullest that takes the next piece
            full = min(bins, n // each)
            put(room - each * length, full, (*pattern, (length, each)))
            n -= full * each
            bins -= full
            if bins and n:
                put(room - n * length, 1, (*pattern, (length, n)))
                n, bins = 0, bins - 1
            if pattern:
                put(room, bins, pattern)
    for held in groups.values():
        for bins, pattern in held:
            plan.add(list(pattern), bins)


def pack_histogram(counts: dict[int, int], capacity: int) -> Plan:
    """A plan for pieces given by length and count."""
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError("piece lengths must be from 1 to the capacity")
    plan, left = Plan(capacity), _Lengths(counts)
    reduced(left, capacity, plan)
    best_fit(left, capacity, plan)
    return plan


def packed(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """Add (sequence_id, offset) to stored pieces that carry (length, part, rank).

    Sequences are numbered from 0; the pieces of one stand side by side from offset 0 and never exceed `capacity`.  Pieces
    of one length are interchangeable, so ties are decided by the rank.  An empty table gives no rows.
    """
    counts = stored(pieces.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # one row for each length
    slots = pieces.sparkSession.sparkContext.broadcast(pack_histogram(totals, capacity).arrays())
    # One row for each task and length: it grows with the tasks, so it is never sent to all of them.
    ranked = pieces.join(bases.hint("merge"), ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "part")
    names = ranked.columns

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        lengths, firsts, bins, offsets, each = slots.value
        length = batch.column(names.index("length")).to_numpy()
        rank = batch.column(names.index("rank")).to_numpy()
        # Slots stand in the order of (length, first rank); a piece's slot is the last that does not begin after it.
        kinds, begin = np.unique(lengths, return_index=True)
        before_kind = np.concatenate(([0], np.cumsum([totals[int(k)] for k in kinds])[:-1])) if len(kinds) else np.zeros(0, np.int64)
        at = np.searchsorted(firsts + np.repeat(before_kind, np.diff([*begin, len(lengths)])), rank + before_kind[np.searchsorted(kinds, length)], side="right") - 1
        inside = rank - firsts[at]
        sequence, offset = bins[at] + inside // each[at], offsets[at] + inside % each[at] * length
        keep = [i for i, name in enumerate(names) if name != "rank"]
        return pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(sequence), pa.array(offset)],
                                          [*[names[i] for i in keep], "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return map_batches(ranked, place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """(id, piece, start, length, crc [, ids], sequence_id, offset) for every piece of every row; see `token_pieces` and `packed`."""
    return packed(stored(token_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids)), capacity)


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences themselves, from pieces with ids; each holds at most the capacity."""
    parts = pieces.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
    return parts.select("sequence_id", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
