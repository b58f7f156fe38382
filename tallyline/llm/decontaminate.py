"""Benchmark decontamination: one Aho-Corasick automaton over the windows of all items, each text scanned once.

Texts are normalised byte by byte (A-Z lowered, anything but letters, digits and non-ASCII becomes a break), so the words
of a text are the pieces between breaks.  The automaton reads one symbol for each word: a word of the benchmark has a
symbol of its own, every other word shares one.  Hits are ranges of words, mapped back to code points of the original.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from .common import keyed_text, map_batches, named, stored, unused

_WORDY = bytes(range(48, 58)) + bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256))
_TABLE = bytes(b + 32 if 65 <= b < 91 else b if b in _WORDY else 32 for b in range(256))
_ORIGINAL_WORD = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_OTHER = "\x00"
_SYMBOLS = 1_000_000  # code points from U+10000 on

Range = tuple[int, int]


def words_of(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


def windows(words: list[bytes], size: int) -> list[tuple[bytes, ...]]:
    """Every run of `size` words, or all words where there are fewer."""
    if not words:
        return []
    return [tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]


class Scanner:
    """The automaton of some items (id, text)."""

    def __init__(self, items: list[tuple[object, str]], size: int):
        owners: dict[tuple[bytes, ...], set] = {}
        for item, text in items:
            for window in windows(words_of(text), size):
                owners.setdefault(window, set()).add(item)
        vocabulary = {word for window in owners for word in window}
        if len(vocabulary) > _SYMBOLS:
            raise ValueError("more distinct words than symbols: use a smaller block_chars")
        self.symbols = {word: chr(0x10000 + i) for i, word in enumerate(sorted(vocabulary))}
        self.automaton = ahocorasick.Automaton()
        for window, ids in owners.items():
            self.automaton.add_word("".join(map(self.symbols.__getitem__, window)), (len(window), tuple(ids)))
        if owners:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[Range], set]:
        """(hit ranges of words, items with an occurring window)."""
        if not self.symbols or not words:
            return [], set()
        symbol = self.symbols.get
        line = "".join([symbol(word, _OTHER) for word in words])
        found = [(end + 1 - count, end + 1, ids) for end, (count, ids) in self.automaton.iter(line)]
        return [(a, b) for a, b, _ in found], set().union(*(ids for _, _, ids in found))


def merged(ranges: list[Range]) -> list[Range]:
    out: list[Range] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def spans(text: str, ranges: list[Range]) -> list[Range]:
    """Code point offsets (start, end) in the original text of ranges of words."""
    if not ranges:
        return []
    at = [m.span() for m in _ORIGINAL_WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in ranges]


_BUILT: list = [None, None]


def _scanner(items: Broadcast, size: int) -> Scanner:
    """Built once in each worker process."""
    if _BUILT[0] is not items.value:
        _BUILT[:] = items.value, Scanner(items.value, size)
    return _BUILT[1]


def item_blocks(items: DataFrame, item_col: str, text_col: str, block_chars: int) -> Iterator[list[tuple[str, str]]]:
    """The items in blocks of about `block_chars` characters, each read when it is asked for; ids as text, whatever their type."""
    rows = items.select(named(item_col).cast("string").alias("item"), F.coalesce(named(text_col), F.lit("")).alias("text")).filter("item IS NOT NULL")
    total = rows.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_chars))
    if blocks == 1:
        yield [tuple(r) for r in rows.collect()]
        return
    dealt = stored(rows.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)).cast("int")))
    for b in range(blocks):
        yield [tuple(r) for r in dealt.filter(F.col("block") == b).select("item", "text").collect()]


def scan_documents(
    docs: DataFrame, items: DataFrame, judge: Callable[[pa.RecordBatch, list[list[bytes]], list[list[Range]], list[set]], pa.RecordBatch],
    schema: str, text_col: str, item_col: str, item_text_col: str, size: int, block_chars: int,
) -> DataFrame:
    """`judge` makes the output of a batch from its words, hit ranges and item ids.

    With several blocks of items, one pass over the texts for each: what earlier passes found travels beside the rows.  A
    block is broadcast for its pass alone, so the driver and an executor never hold more than one.
    """
    context = docs.sparkSession.sparkContext
    width, at = len(docs.columns), docs.columns.index(text_col)
    carried = [unused("ranges", docs.columns), unused("items", docs.columns)]

    def scanned(batch: pa.RecordBatch, block: Broadcast):
        scanner, found = _scanner(block, size), []
        for i, text in enumerate(batch.column(at).to_pylist()):
            words = words_of(text or "")
            ranges, met = scanner.scan(words)
            if batch.num_columns > width:
                ranges += [(r["a"], r["b"]) for r in batch.column(width)[i].as_py()]
                met |= set(batch.column(width + 1)[i].as_py())
            found.append((words, merged(ranges), met))
        return found

    def passing(block: Broadcast):
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = scanned(batch, block)
            ranges = pa.array([[{"a": a, "b": b} for a, b in f[1]] for f in found], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))
            met = pa.array([list(f[2]) for f in found], pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([*batch.columns[:width], ranges, met], [*batch.schema.names[:width], *carried])
        return work

    base = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    now: Broadcast | None = None
    for block in item_blocks(items, item_col, item_text_col, block_chars):
        if now is not None:  # the table written ends this block's lineage
            docs = stored(map_batches(docs, passing(now), f"{base}, `{carried[0]}` array<struct<a:int,b:int>>, `{carried[1]}` array<string>"))
            now.destroy()
        now = context.broadcast(block)

    def finishing(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = scanned(batch, now)
        return judge(batch, [f[0] for f in found], [f[1] for f in found], [f[2] for f in found])

    return map_batches(docs, finishing, schema)


def contamination(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", size: int = 13, block_chars: int = 2_000_000,
) -> DataFrame:
    """(id, n_words, n_hit, items, spans) for every row.

    A document word inside an occurrence of an item window of `size` words is hit; `spans` are the hit stretches as
    (start, end) code points of the original text, `items` the ids, as text and sorted, of the items with an occurring
    window.  A NULL text has no words, a NULL item id is no item, items without words match nothing, rows repeating an
    item id add windows to that item.  Rows repeating a document id are judged each by its own text; an empty table gives
    no rows.
    """
    rows = keyed_text(docs, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def judge(batch, words, ranges, met) -> pa.RecordBatch:
        where = [[{"start": a, "end": b} for a, b in spans(t, r)] for t, r in zip(batch.column(1).to_pylist(), ranges)]
        return pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(map(len, words), pa.int64()), pa.array([sum(b - a for a, b in r) for r in ranges], pa.int64()),
            pa.array([sorted(m) for m in met], pa.list_(pa.string())), pa.array(where, span_type),
        ], ["id", "n_words", "n_hit", "items", "spans"])

    return scan_documents(rows, items, judge, f"id {kind}, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>",
                          "text", item_col, item_text_col, size, block_chars)


def is_contaminated(n_words: int, n_hit: int, share: float = 0.05) -> bool:
    return n_hit > 0 and n_hit / n_words >= share


def keep_clean(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    size: int = 13, share: float = 0.05, block_chars: int = 2_000_000,
) -> DataFrame:
    """The rows of `docs` of whose words less than `share` (or none) are hit, columns unchanged; no row moves.

    A NULL or empty text has no words and stays; a NULL item id is no item; rows repeating a document id, equal ones too, are
    judged each by its own text; without documents there are no rows, without items all stay.
    """
    def judge(batch, words, ranges, met) -> pa.RecordBatch:
        clean = [not is_contaminated(len(w), sum(b - a for a, b in r), share) for w, r in zip(words, ranges)]
        own = pa.RecordBatch.from_arrays(batch.columns[:len(names)], names)
        return own.filter(pa.array(clean, pa.bool_()))

    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return scan_documents(docs, items, judge, schema, text_col, item_col, item_text_col, size, block_chars)
