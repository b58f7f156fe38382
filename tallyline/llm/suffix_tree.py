"""Language-model scores from a probabilistic suffix tree over words, beside a smoothed unigram score.

A text is its words and an end mark; a start mark stands before the first word.  The tree predicts a word from a context of
variable length, the words just before it.  Every run of words that occurs `LEAST` times in training texts enters the tree,
so the tree grows with the corpus.  A context is retained when its next words diverge from what its parent (the longest
retained suffix) predicts: when the likelihood gained over all its occurrences exceeds the cost of its parameters.  Its
distribution keeps the discounted counts of the listed next words and hands the rest to the parent; the root is the smoothed
unigram distribution over all words.  Each word is scored in the longest retained suffix of what precedes it.

The contexts that end in one word form a branch, and a branch depends only on the places after that word.  So texts are kept in
blocks, a block sends each distinct place (the words before and the word, with its count in training texts) to the piece that
holds its branch, a piece grows its branches and answers what each place gains over its root score, and the block adds the
answers up by text.  The branch of a word with more than `WIDE` occurrences is split: its runs of two words are counted and
tested in tables, and the longer contexts that end in it go to pieces by their last two words.

Words are met by 64-bit hashes and numbered by falling count, so that a number tells the count.  A word that occurs less than
`LEAST` times in training texts is in no listed run and has no number of its own.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from .common import discard, keyed_text, map_batches, shuffles_removed, stored

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
END = b"\n"  # the end mark; no word holds a line feed
DISCOUNT = 0.5
# Occurrences in training texts from which a run of words is listed, whatever the size of the corpus.
LEAST = 2
# Words of a block of texts, words for each piece, and occurrences of a word beyond which its branch is split.
BLOCK, PIECE, WIDE = 1_500_000, 400_000, 1_600_000
# Listed pairs of split branches up to which every task gets them; more are joined to the blocks that hold them.
TOLD = 1_000_000
# Numbers of words: all that occur less than LEAST times (or no word at all), the start mark, the most frequent word.
RARE, START, FIRST = 0, 1, 2


def tokens(text: str) -> list[bytes]:
    """The words of a text; white space and letter case are those of ASCII."""
    return text.encode().translate(_LOWER).split()


def word_hash(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little", signed=True)


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, compressed byte by byte of their numbers."""
    return pa.compress(b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns), "zstd", asbytes=True)


def unpacked(data: bytes, rows: int, *kinds: type) -> list[np.ndarray]:
    sizes = [rows * np.dtype(kind).itemsize for kind in kinds]
    raw = np.frombuffer(pa.decompress(data, sum(sizes), "zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(part.reshape(-1, rows).T).reshape(-1).view(kind) for part, kind in zip(np.split(raw, np.cumsum(sizes)[:-1]), kinds)]


def packed_gains(gains: np.ndarray) -> bytes:
    """Gains, of which many are equal: the distinct ones and which each is."""
    values, which = np.unique(gains, return_inverse=True)
    first = packed(values)
    return np.array([len(values), len(first)], np.int32).tobytes() + first + packed(which.astype(np.int32))


def unpacked_gains(data: bytes, rows: int) -> np.ndarray:
    kinds, at = np.frombuffer(data[:8], np.int32)
    return unpacked(data[8:8 + at], int(kinds), np.float64)[0][unpacked(data[8 + at:], rows, np.int32)[0]]


def block_table(rows: DataFrame) -> DataFrame:
    """(block, ids, held, lengths, codes, words, train, times): texts of (id, held_out, text), some BLOCK words together.  codes are
    the texts' words and end marks as places in words, the hashes of the block's distinct words; train and times say how often
    the block's training texts and all its texts hold each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, lengths, codes, own = [], [], [], [], defaultdict(count().__next__)
        block, size = TaskContext.get().partitionId() << 32, 0

        def gathered() -> pa.RecordBatch:
            every, training = np.concatenate(codes), np.repeat(~np.array(held), lengths)
            listed = (pa.concat_arrays(ids), pa.array(held), pa.array(lengths, pa.int64()), pa.array(list(map(word_hash, own)), pa.int64()),
                      pa.array(np.bincount(every[training], minlength=len(own))), pa.array(np.bincount(every, minlength=len(own))))
            lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c) for c in listed]
            columns = [pa.array([block]), *lists[:3], pa.array([packed(every)], pa.binary()), *lists[3:]]
            return pa.RecordBatch.from_arrays(columns, ["block", "ids", "held", "lengths", "codes", "words", "train", "times"])

        for batch in batches:
            for at, (held_out, text) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2))):
                words = tokens(text.as_py())
                words.append(END)
                ids.append(batch.column(0).slice(at, 1))
                held.append(held_out)
                lengths.append(len(words))
                codes.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
                size += len(words)
                if size >= BLOCK:
                    yield gathered()
                    ids, held, lengths, codes, own, block, size = [], [], [], [], defaultdict(count().__next__), block + 1, 0
        if ids:
            yield gathered()

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("id", "held_out", "text").mapInArrow(run, (
        f"block bigint, ids array<{kind}>, held array<boolean>, lengths array<bigint>, codes binary, words array<bigint>, train array<bigint>, times array<bigint>"))


class Counts:
    """The count of a word in training texts by its number; numbers fall with the counts, of which few differ."""

    def __init__(self, times: list[tuple[int, int]], total: int, kinds: int):
        """times: (a count, how many words have it), counts falling."""
        self.first = FIRST + np.cumsum([0] + [n for _, n in times])[:-1]
        self.train = np.array([t for t, _ in times], np.int64)
        self.norm = math.log10(total + kinds + 1)

    def of(self, numbers: np.ndarray) -> np.ndarray:
        if not len(self.train):
            return np.zeros(len(numbers), np.int64)
        return np.where(numbers >= FIRST, self.train[np.searchsorted(self.first, numbers, "right") - 1], 0)

    def said(self, numbers: np.ndarray) -> np.ndarray:
        """log P(word) of the root."""
        return (np.log10(self.of(numbers) + 1) - self.norm) * math.log(10)


def ranked(counts: DataFrame) -> DataFrame:
    """(word, number, train, times): the words that occur LEAST times in training texts, numbered by falling count."""
    rows = stored(counts.filter(F.col("train") >= LEAST).orderBy(F.desc("train"), "word").withColumn("place", F.monotonically_increasing_id()))
    part, before, offsets = F.shiftright("place", 33), FIRST, []
    for r in sorted(rows.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):
        offsets.append((r["part"], before))
        before += r["n"]
    starts = F.broadcast(counts.sparkSession.createDataFrame(offsets, "part bigint, before bigint"))
    return rows.join(starts, part == starts["part"]).select("word", (F.col("place") - F.shiftleft(part, 33) + F.col("before")).cast("int").alias("number"), "train", "times")


def distinct(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(the position of one row of each kind, in the order of the columns; the kind of each row)."""
    bits = max(1, *[int(c.max(initial=0)).bit_length() for c in columns])
    kind, size = columns[0].astype(np.int64), bits
    for column in columns[1:]:
        if size + bits > 63:
            kind = np.unique(kind, return_inverse=True)[1]
            size = int(kind.max(initial=0)).bit_length()
        kind, size = kind << bits | column, size + bits
    kind = np.unique(kind, return_inverse=True)[1]
    one = np.zeros(int(kind.max(initial=-1)) + 1, np.int64)
    one[kind] = np.arange(len(kind))
    return one, kind


def before(row: dict, depth: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(the words before each place of a numbered block, the nearest first, and the word as columns; whether its text trains).
    From a rare word on what precedes is RARE: no run with it is listed."""
    lengths, held = row["lengths"].values.to_numpy(), row["held"].values.to_numpy(zero_copy_only=False)
    numbers, = unpacked(row["codes"].as_py(), int(lengths.sum()), np.int32)
    starts = np.cumsum(lengths) - lengths
    columns = []
    for k in range(1, depth + 1):
        last = np.zeros(len(numbers), np.int32)
        last[k:] = numbers[:-k]
        for j in range(min(k, int(lengths.max()))):  # no run spans texts
            last[starts[lengths > j] + j] = START if j == k - 1 else RARE
        if columns:
            last[columns[-1] == RARE] = RARE
        columns.append(last)
    return [*columns, numbers], np.repeat(~held, lengths)


def laid(row: dict, depth: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """(the distinct places of a numbered block as columns, in order; how often training texts hold each; the texts of all places;
    their kinds).  Places after a rare word are left out: they gain nothing."""
    columns, training = before(row, depth)
    use = np.flatnonzero(columns[0] != RARE)
    columns = [c[use] for c in columns]
    one, kind = distinct(columns)
    lengths = row["lengths"].values.to_numpy()
    texts = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)[use]
    return [c[one] for c in columns], np.bincount(kind, weights=training[use], minlength=len(one)).astype(np.int32), texts, kind


def among(numbers: np.ndarray, wide: np.ndarray) -> np.ndarray:
    """Whether each number is one of the sorted wide ones."""
    return wide[np.minimum(np.searchsorted(wide, numbers), len(wide) - 1)] == numbers if len(wide) else np.zeros(len(numbers), bool)


def by_piece(columns: list[np.ndarray], wide: np.ndarray, pieces: int) -> list[tuple[int, np.ndarray]]:
    """(piece, the places that go to it): by the word before; of wide words by the two before, or, where there are no two, by the word."""
    def mixed(x: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
                x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
        return x ^ (x >> np.uint64(33))

    nearest, second = columns[0], columns[1] if len(columns) > 2 else np.zeros(len(columns[0]), np.int32)
    key = mixed(nearest.astype(np.uint64))
    split = among(nearest, wide)
    key[split] = mixed(key[split] ^ np.where(second[split] == RARE, columns[-1][split], second[split]).astype(np.uint64))
    piece = (key % np.uint64(pieces)).astype(np.int64)
    order = np.argsort(piece, kind="stable")
    ends = np.flatnonzero(np.diff(piece[order])) + 1
    return [(int(piece[rows[0]]), rows) for rows in np.split(order, ends)] if len(order) else []


def grown(columns: list[np.ndarray], n: np.ndarray, gain: np.ndarray, wide: np.ndarray, counts: Counts, cost: float) -> np.ndarray:
    """What each place gains over the root, as a natural logarithm, in the branches that all these distinct places (in order) make up.
    `gain` is what it gains already where the word before is wide and tested elsewhere."""
    word, new = columns[-1], np.zeros(len(n), bool)
    new[:1] = True
    root = counts.said(word)
    for k, last in enumerate(columns[:-1]):
        new[1:] |= last[1:] != last[:-1]
        context = np.cumsum(new) - 1
        valid = (last != RARE) & (word != RARE)
        if not k:
            valid &= ~among(last, wide)
        if k < len(columns) - 2:
            run = np.unique(context << 32 | word, return_inverse=True)[1]
            first = np.zeros(int(run.max(initial=-1)) + 1, np.int64)
            first[run] = np.arange(len(run))
            times = np.bincount(run, weights=n)
        else:  # the whole places, each there once
            run, first, times = np.arange(len(n)), np.arange(len(n)), n
        listed = np.flatnonzero((times >= LEAST) & valid[first])
        met, owner, parent = times[listed], context[first[listed]], (root + gain)[first[listed]]
        seen = np.bincount(context, weights=n)
        held, kinds = (np.bincount(owner, weights=w, minlength=len(seen)) for w in (met, None))
        rest = np.where(kinds > 0, (seen - held + DISCOUNT * kinds) / np.maximum(seen, 1), 1.0)
        more = np.log((met - DISCOUNT) / seen[owner] + rest[owner] * np.exp(parent)) - parent
        handed = np.log(rest)
        gained = np.bincount(owner, weights=met * more, minlength=len(seen)) + (seen - held) * handed
        kept = (kinds > 0) & (gained > cost * (kinds + 1))
        step = np.full(len(times), np.nan)
        step[listed] = more
        step = step[run]
        gain = gain + np.where(kept[context], np.where(np.isnan(step), handed[context], step), 0.0)
    return gain


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Positions of the wanted values in sorted keys, -1 where absent or where the value is negative."""
    at = np.full(len(wanted), -1, np.int64)
    ask = np.flatnonzero(wanted >= 0)
    if len(keys) and len(ask):
        place = np.minimum(np.searchsorted(keys, wanted[ask]), len(keys) - 1)
        hit = keys[place] == wanted[ask]
        at[ask[hit]] = place[hit]
    return at


class SuffixTree:
    """The same tree in memory, for a corpus of which all runs fit: the rules of `grown` stated for all runs at once.

    Runs of words by length.  `keys[m]` are the sorted runs of m words, each the position of the run without its last
    word times `width` plus the last word; runs of one word are the word numbers themselves."""

    def __init__(self, root: np.ndarray, train: np.ndarray, total: int):
        self.width = len(root)
        self.root = root  # log10 P(word) of the root
        self.total = total
        self.keys: dict[int, np.ndarray] = {}
        self.counts: dict[int, np.ndarray] = {1: train}
        self.kept: dict[int, np.ndarray] = {}  # by context length: whether the run is a state
        self.rest: dict[int, np.ndarray] = {}  # log10 of the share a state hands to its parent
        self.listed: dict[int, np.ndarray] = {}  # by run length: log10 P(last word | the run before it), where that is a state

    def runs(self, words: np.ndarray, longest: int) -> list[np.ndarray]:
        """For each run length m from 1: the run of m words that ends at each place, or -1."""
        out = [words]
        for m in range(2, longest + 1):
            before = np.concatenate(([-1], out[-1][:-1])) if len(words) else out[-1]
            out.append(find(self.keys[m], np.where((before >= 0) & (words >= 0), before * self.width + words, -1)))
        return out

    def gains(self, words: np.ndarray, depth: int) -> np.ndarray:
        """For each place: log10 P(word | longest retained suffix) minus log10 P(word) of the root, contexts up to `depth`."""
        runs = self.runs(words, depth + 1)
        gain, settled = np.zeros(len(words)), np.zeros(len(words), bool)
        for k in range(depth, 0, -1):
            state = np.concatenate(([-1], runs[k - 1][:-1]))
            at = np.flatnonzero((state >= 0) & ~settled)
            at = at[self.kept[k][state[at]]]
            run = runs[k][at]
            hit = run >= 0
            gain[at[hit]] += self.listed[k + 1][run[hit]] - self.root[words[at[hit]]]
            settled[at[hit]] = True
            gain[at[~hit]] += self.rest[k][state[at[~hit]]]
        return gain

    def spelled(self, m: int) -> np.ndarray:
        """The words of all runs of m words, one run a row."""
        if m == 1:
            return np.arange(self.width)[:, None]
        return np.concatenate((self.spelled(m - 1)[self.keys[m] // self.width], (self.keys[m] % self.width)[:, None]), axis=1)

    def grow(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Take the runs one word longer than the longest so far, and test the contexts they give distributions to."""
        m = len(self.counts) + 1
        k = m - 1
        order = np.argsort(keys)
        self.keys[m], self.counts[m] = keys[order], counts[order]
        context, last, n = self.keys[m] // self.width, self.keys[m] % self.width, self.counts[m]
        size = len(self.counts[k])
        seen = np.maximum(self.counts[k], 1).astype(float)  # how often each context occurs in training texts
        held = np.bincount(context, weights=n, minlength=size)
        kinds = np.bincount(context, minlength=size)
        seen = np.maximum(seen, held)
        rest = (seen - held + DISCOUNT * kinds) / seen
        # What the parent says: each run without its first word, scored with shorter contexts; rows are kept apart by -1.
        shorter = np.concatenate((np.full((len(n), 1), -1), self.spelled(m)[:, 1:]), axis=1)
        parent = self.root[last] + (self.gains(shorter.ravel(), k - 1).reshape(shorter.shape)[:, -1] if k > 1 and len(n) else 0.0)
        share = (n - DISCOUNT) / seen[context] + rest[context] * 10.0 ** parent
        safe_rest = np.where(rest > 0, rest, 1.0)
        gained = np.bincount(context, weights=n * (np.log(share) - parent * math.log(10)), minlength=size) + (seen - held) * np.log(safe_rest)
        self.kept[k] = (kinds > 0) & (gained > 0.5 * math.log(max(self.total, 2)) * (kinds + 1))
        self.rest[k], self.listed[m] = np.log10(safe_rest), np.log10(share)


_NUMBERED = "block bigint, ids array<{}>, held array<boolean>, lengths array<bigint>, base array<double>, known array<bigint>, codes binary"


def numbered(blocks: DataFrame, numbers: DataFrame, counts: Counts, kind: str) -> DataFrame:
    """Blocks with the numbers of their words instead of hashes, and base, known: the root's score of each text and how many of
    its words training texts hold.  numbers: (block, place, number) of the words that the block's own counts do not tell."""
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.Table.from_batches([], schema=shape)
        row = {c: left[c][0] for c in left.column_names}
        lengths, train = row["lengths"].values.to_numpy(), row["train"].values.to_numpy().copy()
        number = np.zeros(len(train), np.int32)
        place, found = right["place"].to_numpy(), right["number"].to_numpy()
        number[place] = found
        train[place] = np.where(found == RARE, 1, counts.of(found))
        codes, = unpacked(row["codes"].as_py(), int(lengths.sum()), np.int32)
        texts = np.repeat(np.arange(len(lengths)), lengths)
        base = np.bincount(texts, weights=(np.log10(train + 1) - counts.norm)[codes])
        known = np.bincount(texts, weights=(train > 0)[codes]).astype(np.int64)
        return left.select(["block", "ids", "held", "lengths"]).append_column("base", pa.array([base], pa.list_(pa.float64()))).append_column(
            "known", pa.array([known], pa.list_(pa.int64()))).append_column("codes", pa.array([packed(number[codes])], pa.binary()))

    shape = pa.schema([("block", pa.int64())])
    return blocks.select("block", "ids", "held", "lengths", "codes", "train").groupBy("block").cogroup(numbers.toDF("block", "place", "number").groupBy("block")).applyInArrow(run, _NUMBERED.format(kind))


def pair_table(blocks: DataFrame, wide: np.ndarray) -> DataFrame:
    """(block, pair, n): the pairs of a wide word and the next in each block, and how often its training texts hold them."""
    def pairs(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for row in rows_of(batch):
            columns, training = before(row, 1)
            use = np.flatnonzero(among(columns[0], wide) & (columns[-1] != RARE))
            pair, of = np.unique(columns[0][use].astype(np.int64) << 32 | columns[-1][use], return_inverse=True)
            times = np.bincount(of, weights=training[use], minlength=len(pair)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), row["block"].as_py())), pa.array(pair), pa.array(times)], ["block", "pair", "n"])

    return each_row(blocks.select("block", "held", "lengths", "codes"), pairs, "block bigint, pair bigint, n bigint")


def wide_branches(blocks: DataFrame, wide: np.ndarray, seen: np.ndarray, counts: Counts, cost: float) -> tuple[DataFrame, np.ndarray]:
    """((pair, gain) of the listed pairs of a wide word that is retained as a context and the next word; what a retained wide word
    hands on, 0 for others).  seen: how often training texts hold each wide word."""
    def tested(batch: pa.RecordBatch) -> pa.RecordBatch:
        pair, n = (batch.column(c).to_numpy() for c in ("pair", "n"))
        at, parent = np.searchsorted(wide, pair >> 32), counts.said(pair & 0xFFFFFFFF)
        more = np.log((n - DISCOUNT) / seen[at] + rest[at] * np.exp(parent)) - parent
        return pa.RecordBatch.from_arrays([pa.array(wide[at]), batch.column("pair"), batch.column("n"), pa.array(more)], ["context", "pair", "n", "gain"])

    listed = stored(pair_table(blocks, wide).groupBy("pair").agg(F.sum("n").alias("n")).filter(F.col("n") >= LEAST))
    held, kinds = np.zeros(len(wide)), np.zeros(len(wide))
    for r in listed.groupBy(F.shiftright("pair", 32).alias("context")).agg(F.sum("n").alias("held"), F.count(F.lit(1)).alias("kinds")).collect():
        at = np.searchsorted(wide, r["context"])
        held[at], kinds[at] = r["held"], r["kinds"]
    rest = np.where(kinds > 0, (seen - held + DISCOUNT * kinds) / np.maximum(seen, 1), 1.0)
    told = map_batches(listed, tested, "context bigint, pair bigint, n bigint, gain double")
    gained = (seen - held) * np.log(rest)
    for r in told.groupBy("context").agg(F.sum(F.col("n") * F.col("gain")).alias("gained")).collect():
        gained[np.searchsorted(wide, r["context"])] += r["gained"]
    kept = (kinds > 0) & (gained > cost * (kinds + 1))
    names = blocks.sparkSession.createDataFrame([(int(c),) for c in wide[kept]], "context bigint")
    return told.join(F.broadcast(names), "context").select("pair", "gain"), np.where(kept, np.log(rest), 0.0)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for at in range(batch.num_rows):
        yield {name: batch.column(name)[at] for name in batch.schema.names}


def each_row(df: DataFrame, function: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(lambda batches: (out for batch in batches for out in function(batch)), schema)


def score_texts(
    docs: DataFrame, held_out: Callable[[Column], Column], id_col: str = "doc_id", text_col: str = "text", depth: int = 3, min_share: float | None = None,
) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every document.

    Learns from the documents of which `held_out(id)` does not hold.  `base_score` sums log10((c + 1) / (N + V + 1)) over the
    tokens, the root's distribution with one share for all unseen words; `score` is the tree's log10 probability of the text.
    The branches of words that make up more than `min_share` of all tokens (or, by default, occur more than WIDE times) are split;
    the scores do not depend on it.
    A NULL text is empty: its end mark alone.  Rows repeating an id are one document, each adding its tokens.  An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    rows = keyed_text(docs, id_col, text_col).withColumn("held_out", held_out(F.col("id")))
    kind = rows.schema["id"].dataType.simpleString()
    with shuffles_removed(spark):
        hashed = stored(block_table(rows))
        words = hashed.select("block", F.posexplode(F.arrays_zip("words", "train", "times")).alias("place", "w")).select("block", "place", "w.*").withColumnRenamed("words", "word")
        every = stored(words.groupBy("word").agg(F.sum("train").alias("train"), F.sum("times").alias("times")))
        total, kinds, size = every.agg(F.coalesce(F.sum("train"), F.lit(0)), F.count(F.when(F.col("train") > 0, 1)), F.coalesce(F.sum("times"), F.lit(0))).first()
        named = ranked(every)
        counts = Counts([(r[0], r[1]) for r in named.groupBy("train").agg(F.count(F.lit(1))).orderBy(F.desc("train")).collect()], total, kinds)
        cost = 0.5 * math.log(max(total, 2))
        # The start mark stands as often as the end mark.
        least = WIDE if min_share is None else min_share * size
        ends = every.filter(F.col("word") == F.lit(word_hash(END))).select(F.lit(START).alias("number"), "train", "times")
        frequent = sorted(tuple(r) for r in named.select("number", "train", "times").unionByName(ends).filter(F.col("times") > least).select("number", "train").collect()) if depth else []
        wide, seen = (np.array([r[i] for r in frequent], np.int64) for i in (0, 1))
        known = named.select("word", "number").unionByName(every.filter("train = 1 AND times > train").select("word", F.lit(RARE).alias("number")))
        told = words.select("block", "place", "word", "train").join(known, "word").filter((F.col("number") != RARE) | (F.col("train") == 0))
        blocks = stored(numbered(hashed, told.select("block", "place", "number"), counts, kind))
        for table in (hashed, every, named):
            discard(table)
        pieces = max(1, math.ceil(size / PIECE))
        if len(wide):
            branches, handed = wide_branches(blocks, wide, seen, counts, cost)
        sent_as, answered_as = "block bigint, piece int, size int, data binary, gains binary", "block bigint, piece int, size int, gains binary"

        def sent(row: dict, pair: np.ndarray, gains: np.ndarray) -> pa.RecordBatch:
            columns, n, _, _ = laid(row, depth)
            gain, split = np.zeros(len(n)), among(columns[0], wide)
            if split.any():
                own = columns[0][split].astype(np.int64) << 32 | columns[-1][split]
                at = find(pair, own)
                gain[split] = np.where(at >= 0, gains[at] if len(gains) else 0.0, handed[np.searchsorted(wide, columns[0][split])])
            parts = [(piece, len(at), packed(*[np.diff(c[at], prepend=np.int32(0)) for c in columns[:2]], *[c[at] for c in (*columns[2:], n)]), packed_gains(gain[at])) for piece, at in by_piece(columns, wide, pieces)]
            return pa.RecordBatch.from_arrays([pa.array([row["block"].as_py()] * len(parts), pa.int64()), *[pa.array([p[i] for p in parts], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))]],
                                              ["block", "piece", "size", "data", "gains"])

        def met(left: pa.Table, right: pa.Table) -> pa.Table:
            order = np.argsort(right["pair"].to_numpy())
            return pa.Table.from_batches([sent(row, right["pair"].to_numpy()[order], right["gain"].to_numpy()[order]) for batch in left.to_batches() for row in rows_of(batch)])

        def answered(table: pa.Table) -> pa.Table:
            sizes = table["size"].to_pylist()
            parts = [unpacked(data.as_py(), n, *[np.int32] * (depth + 2)) for data, n in zip(table["data"], sizes)]
            *columns, n = (np.concatenate(c) for c in zip(*[(*[np.cumsum(c, dtype=np.int32) for c in p[:2]], *p[2:]) for p in parts]))
            del parts
            gain = np.concatenate([unpacked_gains(data.as_py(), n) for data, n in zip(table["gains"], sizes)])
            one, same = distinct(columns)
            gain = grown([c[one] for c in columns], np.bincount(same, weights=n, minlength=len(one)), gain[one], wide, counts, cost)[same]
            return table.select(["block", "piece", "size"]).append_column("gains", pa.array([packed_gains(g) for g in np.split(gain, np.cumsum(sizes)[:-1])], pa.binary()))

        def summed(left: pa.Table, right: pa.Table) -> pa.Table:
            out = []
            answers = {piece: unpacked_gains(data.as_py(), n) for piece, n, data in zip(right["piece"].to_pylist(), right["size"].to_pylist(), right["gains"])}
            for batch in left.to_batches():
                for row in rows_of(batch):
                    columns, n, texts, same = laid(row, depth)
                    gain = np.zeros(len(n))
                    for piece, at in by_piece(columns, wide, pieces):
                        gain[at] = answers[piece]
                    sums = np.bincount(texts, weights=gain[same], minlength=len(row["lengths"])) / math.log(10)
                    out.append(pa.Table.from_arrays([row[c].values for c in ("ids", "lengths", "base", "known")] + [pa.array(sums)], ["id", "n_tokens", "base", "known", "gain"]))
            return pa.concat_tables(out)

        sources = blocks.select("block", "held", "lengths", "codes")
        if len(wide) and branches.count() > TOLD:
            own = pair_table(blocks, wide).select("block", "pair").join(branches, "pair").select("block", "pair", "gain")
            asked = sources.groupBy("block").cogroup(own.groupBy("block")).applyInArrow(met, sent_as)
        else:
            table = branches.orderBy("pair").toArrow() if len(wide) else pa.table({"pair": np.zeros(0, np.int64), "gain": np.zeros(0)})
            shared = spark.sparkContext.broadcast((table["pair"].to_numpy(), table["gain"].to_numpy()))
            asked = each_row(sources, lambda batch: (sent(row, *shared.value) for row in rows_of(batch)), sent_as)
        answers = stored(asked.groupBy("piece").applyInArrow(answered, answered_as))
    own = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(summed, f"id {kind}, n_tokens bigint, base double, known bigint, gain double")
    sums = own.groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "base", "known", "gain")])
    return sums.select("id", held_out(F.col("id")).alias("held_out"), "n_tokens", F.col("known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
                       F.col("base").alias("base_score"), (F.col("base") + F.col("gain")).alias("score"))
