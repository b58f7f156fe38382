"""Toxicity of deobfuscated text: a noisy-channel Viterbi decoder restores disguised words, a lexicon learned from labels scores them.

A written character is a letter, a look-alike of a letter, a repeat of the letter before, or a mark between letters.  The
decoder finds the likeliest words behind such a lattice under a character language model of the training texts.  The score
knows the words, the word beginnings and the families (two different words with a common beginning in one text) whose
share among toxic texts is significantly larger (a likelihood-ratio test over all of them).  A penalised logistic fit says
what each adds, starting from its log ratio.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, takewhile

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .common import keyed_text, labelled_sample, map_batches, stored
from .simhash import components, similar_links

# What a character can stand for besides itself.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "(": "c", "<": "c", "+": "t", "€": "e", "£": "l",
}
# Log10 costs of the channel: a look-alike, a repeated letter, a mark to skip, a word break inside a spelled-out run.
LOOKALIKE, REPEAT, MARK, BREAK = -0.5, -0.5, -0.7, -1.5
# A written blank inside a word, and the sign that shows it in a reading.
SPLIT, GLUE = -1.5, "\0"
ORDER = 5
MEMO = 20_000
# Labelled texts count as one where half of their runs of SHINGLE words are the same; those of similarity 0.5 meet with a probability of 0.99.
SHINGLE, ALIKE, VIEWS, WIDTH = 5, 0.5, 16, 2
# Near copies of one text that a task holds together; tokens it remembers, and texts and signs it counts at once.
TOGETHER, HELD = 256, 100_000
STRETCH, SIGNS = 1_000, 4_000_000
# Up to this many different sets of features are fitted on the driver, more by sums over the tasks.
LOCAL_SETS = 50_000

_PLAIN = re.compile(r"[^\W\d_]+")
_DECORATION = re.compile(r"([^\w\s])\1{2,}$")
_BEHIND = "\"'`´“”‘’«»()[]{}>.,;:?!*#%&~-_=/\\…"
_BEFORE = "\"'`´“”‘’«»[]{}.,;:?*#%&~-_=/\\…"
_SPELLED = re.compile(r"(?<!\S)\S(?:\s+\S){2,}(?=[\s.,;:!?]|$)")


def trimmed(token: str) -> str:
    """A token without quotes, brackets and sentence marks around it, and without a run of one mark behind it."""
    if token.isalpha():
        return token
    return _DECORATION.sub("", token).rstrip(_BEHIND).lstrip(_BEFORE)


class CharModel:
    """log10 P(next | up to ORDER - 1 characters before it in the word), Witten-Bell smoothed; "^" begins a word, "$" ends it."""

    def __init__(self, counts: pa.Table | Iterable[tuple[str, str, int]]):
        """From (context, follows, n), kept as sorted arrays: only what is asked for becomes Python objects."""
        if not isinstance(counts, pa.Table):
            counts = pa.table(dict(zip(("context", "follows", "n"), (list(c) for c in zip(*counts)))) or {"context": [], "follows": [], "n": []})
        contexts = np.array(counts["context"].to_pylist(), f"U{ORDER - 1}")
        order = np.argsort(contexts, kind="stable")
        self.contexts, self.starts = np.unique(contexts[order], return_index=True)
        self.follows = np.array(counts["follows"].to_pylist(), "U1")[order]
        self.counts = counts["n"].to_numpy().astype(np.int64)[order]
        self.seen: dict[str, tuple[dict[str, int], int]] = {}
        self.known: dict[tuple[str, str], float] = {}

    def after(self, context: str) -> tuple[dict[str, int], int]:
        """(how often each character follows the context, their sum)."""
        if context not in self.seen:
            if len(self.seen) >= MEMO:
                self.seen.clear()
            at, found = int(np.searchsorted(self.contexts, context)), {}
            if at < len(self.contexts) and self.contexts[at] == context:
                mine = slice(self.starts[at], self.starts[at + 1] if at + 1 < len(self.starts) else None)
                found = dict(zip(self.follows[mine].tolist(), self.counts[mine].tolist()))
            self.seen[context] = (found, sum(found.values()))
        return self.seen[context]

    @staticmethod
    def grams(word: str) -> list[tuple[str, str]]:
        line = f"^{word}$"
        return [(line[max(0, i - k):i], line[i]) for i in range(1, len(line)) for k in range(min(i, ORDER - 1) + 1)]

    def share(self, context: str, follows: str) -> float:
        shorter = self.share(context[1:], follows) if context else 1 / 1_114_112
        seen, n = self.after(context)
        if not seen:
            return shorter
        kinds = len(seen)
        return (seen.get(follows, 0) + kinds * shorter) / (n + kinds)

    def log(self, context: str, follows: str) -> float:
        key = (context, follows)
        if key not in self.known:
            if len(self.known) >= MEMO:
                self.known.clear()
            self.known[key] = math.log10(self.share(context, follows))
        return self.known[key]


Written = tuple | None  # (what stands before, sign), or nothing


def spelt(text: Written) -> str:
    signs = []
    while text:
        text, sign = text
        signs.append(sign)
    return "".join(reversed(signs))


def decode(written: str, model: CharModel, breaks: bool = False) -> list[str]:
    """The likeliest words behind the characters.  With `breaks`, a word may begin anywhere; else one begins behind each
    blank, unless the blank is read as lying inside a word, which GLUE then shows."""
    # State: (characters before, last letter written?) -> (log10 probability, the last sign written with a pointer to those before it).
    states: dict[tuple[str, str], tuple[float, Written]] = {("^", ""): (0.0, None)}
    for at, c in enumerate(written):
        options = [(c, 0.0)] if c.isalpha() else []
        options += [(letter, LOOKALIKE) for letter in LOOKALIKES.get(c, "")]
        again = at > 0 and written[at - 1] == c
        nxt: dict[tuple[str, str], tuple[float, Written]] = {}

        def offer(state: tuple[str, str], p: float, text: Written) -> None:
            if state not in nxt or p > nxt[state][0]:
                nxt[state] = (p, text)

        for (context, last), (p, text) in states.items():
            if c == " ":
                offer((context, last), p + (SPLIT if last else 0.0), (text, GLUE) if last else text)
                if last:
                    offer(("^", ""), p + model.log(context, "$"), (text, " "))
                continue
            for letter, cost in options:
                offer(((context + letter)[1 - ORDER:], letter), p + cost + model.log(context, letter), (text, letter))
                if again and letter == last:
                    offer((context, last), p + REPEAT, text)
                if breaks and last:
                    ended = p + BREAK + model.log(context, "$")
                    offer((("^" + letter)[1 - ORDER:], letter), ended + cost + model.log("^", letter), ((text, " "), letter))
            if not c.isalpha():
                offer((context, last), p + (MARK if options else 0.0), text)
        states = nxt
    ends = [(p + (model.log(context, "$") if last else 0.0), text) for (context, last), (p, text) in states.items() if text]
    likeliest = max((p for p, _ in ends), default=0.0)
    return max((spelt(text) for p, text in ends if p == likeliest), default="").split()


_KIN: dict[str, str] = {}
for _letters in LOOKALIKES.values():
    _first = min(_KIN.get(letter, letter) for letter in _letters)
    _KIN.update({letter: _first for letter in _letters})
_CLASS = {**_KIN, **{c: _KIN[letters[0]] for c, letters in LOOKALIKES.items()}}


class Spellings:
    """What of the lexicon characters can spell: a trie over letter classes without repeats.

    Each character may be skipped unless it is a letter, read as a letter of its class, or repeat the class before: all that
    the decoder may do, whatever it costs.
    """

    def __init__(self, words: Iterable[str]):
        self.nodes: list[dict[str, int]] = [{}]
        self.last = [""]
        self.whole: set[int] = set()
        self.begun: set[int] = set()
        for feature in words:
            at = 0
            for k in (_CLASS.get(c, c) for c in feature.rstrip("$+")):
                if k != self.last[at]:
                    if k not in self.nodes[at]:
                        self.nodes[at][k] = len(self.nodes)
                        self.nodes.append({})
                        self.last.append(k)
                    at = self.nodes[at][k]
            (self.whole if feature.endswith("$") else self.begun).add(at)
        signs: dict[str, str] = defaultdict(str)
        for c, k in _CLASS.items():
            signs[k] += c

        def ways(node: int, depth: int) -> str:
            """A pattern of what may stand behind a node up to `depth` letters on; it may end at any."""
            ahead = []
            for k, n in self.nodes[node].items():
                one = f"[{re.escape(signs[k] + k)}]"
                ahead.append(one + (f"(?:{one}|[^a-z])*(?:$|{ways(n, depth - 1)})" if depth > 1 and n not in self.whole and n not in self.begun else ""))
            return f"(?:{'|'.join(ahead)})" if ahead else "(?!)"

        self.opening = re.compile(f"[^a-z]*(?:$|{ways(0, 3)})")

    def may_open(self, written: str) -> bool:
        """False only where the first letters are on no way into the trie, read in any way; long tokens are not asked."""
        return len(written) > 32 or self.opening.match(written) is not None

    def step(self, at: set[int], c: str) -> set[int]:
        """The nodes that a letter read from the character leads to; a skipped character changes none."""
        if not (c.isalpha() or c in LOOKALIKES):
            return set()
        k = _CLASS.get(c, c)
        return {n for n in (m if self.last[m] == k else self.nodes[m].get(k, 0) for m in at) if n}

    def whole_or_begun(self, written: str) -> bool:
        """Whether a word of the lexicon, or one that begins like it, can stand behind the characters."""
        at = {0}
        for c in written:
            at = self.step(at, c) | (set() if c.isalpha() else at)
            if at & self.begun:
                return True
            if not at:
                return False
        return bool(at & self.whole)

    def within(self, written: str) -> bool:
        """The same for a word that may begin and end anywhere between the characters."""
        at = {0}
        for c in written:
            at = self.step(at, c) | (set() if c.isalpha() else at)
            if at & self.begun or at & self.whole:
                return True
            at.add(0)
        return False

    def onward(self, node: int, written: str) -> tuple[frozenset[int], bool]:
        """(nodes after the characters, of which at least one is read, whether something of the lexicon can end or begin there)."""
        read, unread, hit = set(), {node}, False
        for c in written:
            read = self.step(read | unread, c) | (set() if c.isalpha() else read)
            hit = hit or bool(read & self.begun)
            if c.isalpha():
                unread = set()
                if not read:
                    return frozenset(), hit
        return frozenset(read), hit or bool(read & self.whole)


STEMS = range(3, 9)


def features(word: str) -> list[str]:
    """The word, marked as whole, and its beginnings."""
    return [word + "$", *[word[:k] for k in STEMS if k <= len(word)]]


def families(words: Iterable[str]) -> list[str]:
    """Beginnings, marked as families, with which two or more of the different words go on."""
    return [stem + "+" for stem, n in Counter(word[:k] for word in words for k in STEMS if k < len(word)).items() if n > 1]


class Heads(dict):
    """Maps the first three characters of a token to whether nothing of the lexicon can stand in it or begin with it, whatever
    follows; a bounded memo.

    So it is where the token begins with two letters or more that lead nowhere in the spellings: no mark before them is
    trimmed, and letters may not be skipped.
    """

    def __init__(self, spellings: Spellings):
        super().__init__()
        self.spellings = spellings

    def __missing__(self, head: str) -> bool:
        letters = "".join(takewhile(str.isalpha, head))
        if len(self) >= MEMO:
            self.clear()
        self[head] = len(letters) > 1 and self.spellings.onward(0, letters) == (frozenset(), False)
        return self[head]


class Reader(dict):
    """Maps a lower-case token to the features of the lexicon it reads as; a bounded memo.

    Each word counts by its weightiest feature, and as a member, named "family+word", of its weightiest family.  Plain words read as they stand.  Every other token is decoded if it can
    spell something of the lexicon, and so are runs of single characters and neighbouring tokens that spell a word together;
    no other reading could change the score.
    """

    def __init__(self, weights: dict[str, float], model: CharModel):
        super().__init__()
        self.weights, self.model = weights, model
        self.spellings = Spellings(weights)
        self.starts = {f.rstrip("$+")[:STEMS[0]] for f in weights}
        self.heads = Heads(self.spellings)
        self.moves: dict[tuple[int, str], tuple[frozenset[int], bool]] = {}
        self.looks: dict[str, tuple[str, frozenset[int]]] = {}
        self.longest = 96

    def best(self, word: str) -> tuple[str, ...]:
        if word[:STEMS[0]] not in self.starts:
            return ()
        known = [f for f in features(word) if f in self.weights]
        kin = [f for f in (word[:k] + "+" for k in STEMS if k < len(word)) if f in self.weights]
        one = (max(known, key=lambda f: (self.weights[f], f)),) if known else ()
        return one + ((max(kin, key=lambda f: (self.weights[f], f)) + word,) if kin else ())

    def __missing__(self, token: str) -> tuple[str, ...]:
        core = trimmed(token)
        found = self.best(core) if core else ()
        if not found and core and self.spellings.may_open(core) and self.spellings.whole_or_begun(core):
            found = tuple(f for w in decode(core, self.model) for f in self.best(w))
        if len(token) <= self.longest:
            if len(self) >= MEMO:
                self.clear()
            self[token] = found
        return found

    def spelled(self, run: str) -> tuple[str, ...]:
        """Features of the words in a run of single characters with blanks between."""
        written = "".join(run.split())
        if not self.spellings.within(written):
            return ()
        return tuple(f for w in decode(written, self.model, breaks=True) for f in self.best(w))

    def move(self, node: int, token: str) -> tuple[frozenset[int], bool]:
        """Where the token leads from a node of the spellings; marks alone leave it there."""
        key = (node, token)
        if key not in self.moves:
            core = trimmed(token)
            to = self.spellings.onward(node, core) if core else (frozenset((node,) if node else ()), False)
            if len(token) > self.longest:
                return to
            if len(self.moves) >= MEMO:
                self.moves.clear()
            self.moves[key] = to
        return self.moves[key]

    def look(self, token: str) -> tuple[str, frozenset[int]]:
        """(the single character that the token is, or nothing, where words of the lexicon that begin with it go on)."""
        core = trimmed(token)
        heads = self.spellings.onward(0, core)[0] if self.spellings.may_open(core) else frozenset()
        core = core or token
        out = (core if len(core) == 1 else "", heads)
        if len(token) <= self.longest:
            if len(self.looks) >= MEMO:
                self.looks.clear()
            self.looks[token] = out
        return out

    def glued(self, tokens: list[str]) -> tuple[str, ...]:
        """Features of the words that lie across the blanks between the tokens."""
        written = " ".join(core for core in map(trimmed, tokens) if core)
        return tuple(f for w in decode(written, self.model) if GLUE in w.strip(GLUE) for f in self.best(w.replace(GLUE, "")))

    def found(self, text: str) -> set[str]:
        """The features of a text; a family is one where two different words of it are read."""
        read = self.read(text)
        members = Counter(f.partition("+")[0] + "+" for f in read if f not in self.weights)
        return {f for f in read if f in self.weights} | {f for f, n in members.items() if n > 1}

    def read(self, text: str) -> set[str]:
        tokens, shut = text.lower().split(), self.heads
        asked = [i for i, token in enumerate(tokens) if not shut[token[:3]]]
        out: set[str] = set()
        for token in {tokens[i] for i in asked}:
            out.update(self[token])
        single: list[str] = []
        open_: dict[int, int] = {}  # nodes reached by the tokens so far, and the latest token that leads there

        def go_on(i: int) -> dict[int, int]:
            ahead: dict[int, int] = {}
            hits = set()
            for node, start in open_.items():
                nodes, hit = self.move(node, tokens[i])
                if hit:
                    hits.add(start)
                for n in nodes:
                    ahead[n] = max(start, ahead.get(n, -1))
            for start in hits:
                out.update(self.glued(tokens[start:i + 1]))
            return ahead

        def ended() -> list[str]:
            if len(single) > 2:
                out.update(self.spelled("".join(single)))
            return []

        at, looks = 0, self.looks  # the tokens before `at` are read
        for i in [*asked, len(tokens)]:
            if at < i and single:
                single = ended()
            while open_ and at < i:  # tokens not asked only go on with what is open
                open_ = go_on(at)
                at += 1
            if i < len(tokens):
                one, heads = looks.get(tokens[i]) or self.look(tokens[i])
                if open_:
                    open_ = go_on(i)
                for n in heads:
                    open_[n] = i
                if one:
                    single.append(one)
                elif single:
                    single = ended()
                at = i + 1
        ended()
        return out


def restored(text: str, model: CharModel) -> str:
    """The lower-case text with every disguised token and spelled-out run replaced by its likeliest words."""
    def token(m: re.Match) -> str:
        core = trimmed(m.group())
        if not core or _PLAIN.fullmatch(core) and not re.search(r"(.)\1", core) or not any(c.isalpha() for c in core):
            return m.group()
        return m.group().replace(core, " ".join(decode(core, model)) or core)

    runs = _SPELLED.sub(lambda m: " ".join(decode("".join(m.group().split()), model, breaks=True)) or m.group(), text.lower())
    return re.sub(r"\S+", token, runs)


def near_copies(sample: DataFrame) -> DataFrame:
    """(node, copies, pieces, size): for the rows of (row, text) that have near copies the smallest row linked to them, and in how
    many pieces a large group is counted."""
    groups = stored(components(similar_links(sample.select(F.col("row").alias("place"), "text"), ALIKE, SHINGLE, VIEWS, WIDTH)))
    sizes = groups.groupBy("label").agg(F.count(F.lit(1)).alias("size")).withColumn("pieces", F.ceil(F.col("size") / TOGETHER).cast("int"))
    return groups.join(sizes, "label").select("node", F.col("label").alias("copies"), "pieces", "size")


def firsts(*keys: np.ndarray) -> np.ndarray:
    """Where sorted rows of keys change."""
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(new)


def held_features(texts: list[list[int]], words: list[str]) -> Iterator[tuple[list[str], np.ndarray, np.ndarray, np.ndarray]]:
    """(names, text, place among the names, times) of the features that texts, given by places among sorted words, hold: first the
    words, then the beginnings of each length and the families of each, where the times are none."""
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    key, times = np.unique(text * len(words) + np.fromiter((w for t in texts for w in t), np.int64, len(text)), return_counts=True)
    text, word = key // max(1, len(words)), key % max(1, len(words))
    yield [w + "$" for w in words], text, word, times
    lengths = np.array([len(w) for w in words], np.int64)
    for k in STEMS:
        # Words that begin alike are neighbours, so those of a text are as well.
        own, names, of = np.flatnonzero(lengths >= k), [], []
        for i in own.tolist():
            if not names or names[-1] != words[i][:k]:
                names.append(words[i][:k])
            of.append(len(names) - 1)
        stem = np.full(len(words), -1, np.int64)
        stem[own] = of
        for longer, ending in ((False, ""), (True, "+")):
            at = np.flatnonzero((stem[word] >= 0) & (lengths[word] > k if longer else True))
            t, f = text[at], stem[word[at]]
            first = firsts(t, f) if len(at) else at
            if longer:  # two different words
                first = first[np.diff(np.append(first, len(at))) > 1]
            yield [n + ending for n in names], t[first], f[first], np.zeros(len(first), np.int64)


def word_counts(sample: DataFrame, groups: DataFrame) -> DataFrame:
    """(word, toxic, clean, times): groups of near copies of each class that hold a feature, and how often a whole word occurs.

    Rows without near copies are counted where they lie.  A group counts once: its rows are neighbours in one task, a large one
    in several; where a stretch of rows ends within a group, or the group is large, its features meet by name.
    """
    schema = "word string, copies bigint, toxic bigint, clean bigint, times bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain: dict[str, str] = {}  # the word that a token is, or nothing

        def counted(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            places: dict[str, int] = {}
            texts = []
            for text in batch.column(4).to_pylist():
                mine = []
                for token in text.lower().split():
                    if (word := plain.get(token)) is None:
                        word = plain[token] = core if _PLAIN.fullmatch(core := trimmed(token)) else ""
                    if word:
                        mine.append(places.setdefault(word, len(places)))
                texts.append(mine)
                if len(plain) > HELD:
                    plain.clear()
            words = sorted(places)
            rank = np.empty(len(words), np.int64)
            rank[[places[w] for w in words]] = np.arange(len(words))
            texts = [rank[t].tolist() for t in texts]
            copies, pieces, piece, bad = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(4))
            starts = firsts(copies, pieces, piece, bad)
            unit = np.zeros(len(copies), np.int64)
            unit[starts[1:]] = 1
            unit = np.cumsum(unit)
            bad, copies, single = bad[starts], copies[starts], len(starts) == len(unit)
            named = pieces[starts] > 1
            named[[0, -1]] = True  # these may go on in the rows before and behind
            names, numbers = [], []
            for kind, text, f, times in held_features(texts, words):
                n, seen, of = len(kind), np.bincount(f, weights=times, minlength=len(kind)), unit[text]
                if not single:
                    key = np.unique(of * n + f)
                    of, f = key // max(1, n), key % max(1, n)
                here = ~named[of]
                toxic, clean = (np.bincount(f[here & (bad[of] == b)], minlength=n) for b in (True, False))
                some = np.flatnonzero(toxic + clean + seen)
                away = np.flatnonzero(named[of])
                names.append(pa.array(kind, pa.string()).take(pa.array(np.concatenate((some, f[away])))))
                mark, none = bad[of[away]].astype(np.int64), np.zeros(len(away), np.int64)
                numbers.append((np.concatenate((np.zeros(len(some), np.int64), copies[of[away]])), np.arange(len(some) + len(away)) < len(some),
                                np.concatenate((toxic[some], mark)), np.concatenate((clean[some], 1 - mark)), np.concatenate((seen[some].astype(np.int64), none))))
            group, alone, *counts = (np.concatenate(c) for c in zip(*numbers))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(names), pa.array(group, pa.int64(), mask=alone), *[pa.array(c, pa.int64()) for c in counts]],
                                             ["word", "copies", "toxic", "clean", "times"])

        for batch in batches:
            at = 0
            signs = np.cumsum(pc.utf8_length(batch.column(4)).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:
                upto = int(np.searchsorted(signs, SIGNS + (signs[at - 1] if at else 0)))
                size = max(1, min(STRETCH, upto - at))
                yield from counted(batch.slice(at, size))
                at += size

    bad = (F.col("label") > 0).alias("bad")
    alone = sample.join(groups, sample["row"] == groups["node"], "left_anti").select(F.col("row").alias("copies"), F.lit(1).alias("pieces"), F.lit(0).alias("piece"), bad, "text")
    piece = F.pmod(F.xxhash64("row"), F.col("pieces")).cast("int").alias("piece")
    linked = sample.join(groups, sample["row"] == groups["node"]).select("copies", "pieces", piece, bad, "text")
    linked = linked.repartition("copies", "piece").sortWithinPartitions("copies", "piece", "bad")
    parts = alone.mapInArrow(run, schema).unionByName(linked.mapInArrow(run, schema))
    once = parts.groupBy("word", "copies").agg(*[f(c).alias(f"{n}_{c}") for c in ("toxic", "clean") for n, f in (("all", F.sum), ("one", F.max))], F.sum("times").alias("times"))
    return once.groupBy("word").agg(*[F.sum(F.when(F.col("copies").isNull(), F.col(f"all_{c}")).otherwise(F.col(f"one_{c}"))).alias(c) for c in ("toxic", "clean")],
                                    F.sum("times").alias("times"))


def gram_counts(words: list[str], times: np.ndarray) -> Iterator[tuple[list[str], list[str], np.ndarray]]:
    """(contexts, characters behind them, how often) of words that end with "$", each counted `times` times; for each length of
    the context the same that `CharModel.grams` lists, no pair twice."""
    line = "".join("^" + word for word in words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    offset = np.arange(len(line)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    times = np.repeat(times, lengths)
    signs, own = np.unique(np.frombuffer(line.encode("utf-32-le"), np.uint32), return_inverse=True)
    run = np.zeros(len(line), np.int64)  # a number for the run of characters that ends at each place
    for k in range(ORDER):
        at = np.flatnonzero(offset >= k)
        kinds, first, run[at] = np.unique(run[at - 1] * len(signs) + own[at] if k else own[at], return_index=True, return_inverse=True)
        n = np.bincount(run[at], weights=np.where(offset[at] > 0, times[at], 0), minlength=len(kinds)).astype(np.int64)
        some = np.flatnonzero(n)
        ends = at[first[some]].tolist()
        yield [line[i - k:i] for i in ends], [line[i] for i in ends], n[some]


def char_counts(words: DataFrame) -> pa.Table:
    """n-gram counts of the words; contexts of ORDER - 1 characters at most bound them."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = list(gram_counts(batch.column(0).to_pylist(), batch.column(1).to_numpy()))
        return pa.RecordBatch.from_arrays([pa.array(chain.from_iterable(p[i] for p in parts), pa.string()) for i in (0, 1)] + [pa.array(np.concatenate([p[2] for p in parts]))],
                                          ["context", "follows", "n"])

    parts = map_batches(words.filter("times > 0").select("word", "times"), work, "context string, follows string, n bigint")
    return parts.groupBy("context", "follows").agg(F.sum("n").alias("n")).toArrow()


Sums = tuple[float, np.ndarray, np.ndarray]


def likelihood(held: list[list[int]], y: np.ndarray, counts: np.ndarray, weights: np.ndarray, theta: np.ndarray) -> Sums:
    """(loss, its slope, its curvature) of texts given by the features they hold, each `counts` times, at theta."""
    n = len(weights)
    row = np.repeat(np.arange(len(held)), [len(h) for h in held])
    of = np.fromiter((f for h in held for f in h), np.int64, len(row))
    x = np.bincount(row, weights=weights[of], minlength=len(y))
    z = np.bincount(row, weights=theta[of], minlength=len(y)) + theta[n] * x + theta[n + 1]
    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
    away, bend = counts * (p - y), counts * p * (1 - p)
    slope = np.concatenate((np.bincount(of, weights=away[row], minlength=n), [away @ x, away.sum()]))
    curve = np.zeros((n + 2, n + 2))
    ends = np.searchsorted(row, np.arange(0, len(y) + 512, 512))
    for k, at in enumerate(range(0, len(y), 512)):  # the design of some texts at a time
        mine = slice(ends[k], ends[k + 1])
        design = np.zeros((min(512, len(y) - at), n + 2))
        design[row[mine] - at, of[mine]] = 1.0
        design[:, n], design[:, n + 1] = x[at:at + 512], 1.0
        curve += design.T @ (design * bend[at:at + 512, None])
    return float(counts @ (np.logaddexp(0, z) - y * z)), slope, curve


def settled(sums: Callable[[np.ndarray], Sums], weights: np.ndarray) -> tuple[np.ndarray, float]:
    """(what each feature adds, shift) of P(y) = 1 / (1 + exp(-(sum + shift))), by the sums over the texts at any theta.

    A feature adds its weight times one slope common to all, and what its own texts say beyond it, drawn to nothing as by a
    prior of variance 1: features that stand beside others share their evidence, one that stands alone keeps it.  Newton steps
    with halving; both classes count half a text without features more.  Raises an error if the steps do not settle.
    """
    n = len(weights)
    prior = np.concatenate((np.ones(n), [1e-3, 1e-3]))
    none, ends, halves = [[], []], np.array([0.0, 1.0]), np.array([0.5, 0.5])

    def at(theta: np.ndarray) -> Sums:
        loss, slope, curve = (a + b for a, b in zip(sums(theta), likelihood(none, ends, halves, weights, theta)))
        return loss + 0.5 * float(prior @ theta ** 2), slope + prior * theta, curve + np.diag(prior)

    theta = np.zeros(n + 2)
    now, slope, curve = at(theta)
    for _ in range(100):
        step, size = np.linalg.solve(curve, slope), 1.0
        ahead = at(theta - step)
        while ahead[0] > now and size > 1e-9:
            size /= 2
            ahead = at(theta - size * step)
        theta, done = theta - size * step, float(slope @ step) < 1e-12
        now, slope, curve = min(now, ahead[0]), ahead[1], ahead[2]
        if done:
            return theta[n] * weights + theta[:n], float(theta[n + 1])
    raise RuntimeError("the scores' fit did not settle in 100 steps")


def logistic(held: list[list[int]], y: np.ndarray, weights: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """`settled` for texts given by the features they hold, each once unless `counts` says how often."""
    times = np.ones(len(y)) if counts is None else counts
    return settled(lambda theta: likelihood(held, y, times, weights, theta), weights)


def logistic_sets(sets: DataFrame, weights: np.ndarray) -> tuple[np.ndarray, float]:
    """The same for a table (found, y, times) of different sets of features: each step sums in the tasks, and only the sums of
    every two features reach the driver."""
    n = len(weights)

    def sums(theta: np.ndarray) -> Sums:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: Sums = (0.0, np.zeros(n + 2), np.zeros((n + 2, n + 2)))
            for batch in batches:
                held, y, times = (c.to_pylist() for c in batch.columns)
                total = tuple(a + b for a, b in zip(total, likelihood(held, np.array(y, float), np.array(times, float), weights, theta)))
            flat = np.concatenate(([total[0]], total[1], total[2].ravel()))
            some = np.flatnonzero(flat)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(flat[some])], ["at", "value"])

        flat = np.zeros(1 + (n + 2) * (n + 3))
        told = sets.mapInArrow(work, "at bigint, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
        flat[told["at"].to_numpy()] = told["value"].to_numpy()
        return float(flat[0]), flat[1:n + 3], flat[n + 3:].reshape(n + 2, n + 2)

    return settled(sums, weights)


class ToxicityModel:
    """What the score needs: feature weights, the character counts of the decoder, what each feature adds, and the shift."""

    def __init__(self, weights: dict[str, float], grams: pa.Table | list[tuple[str, str, int]]):
        self.weights, self.grams, self.adds, self.shift = weights, grams, dict.fromkeys(weights, 0.0), 0.0
        self._reader: Reader | None = None

    def __getstate__(self):
        return {**self.__dict__, "_reader": None}

    def reader(self) -> Reader:
        if self._reader is None:
            self._reader = Reader(self.weights, CharModel(self.grams))
        return self._reader

    def probability(self, found: Iterable[str]) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, math.fsum(self.adds[f] for f in found) + self.shift))))

    def score(self, text: str) -> float:
        return self.probability(self.reader().found(text))


def longest_beginnings(sample: DataFrame, weights: dict[str, float]) -> dict[str, float]:
    """Of beginnings that the same toxic texts hold the longest stays, so that other words begin like it less often.

    The texts that hold a feature are told by their number and by two sums of hashes of their rows: no list of them is made.
    """
    if not weights:
        return weights
    names = sample.sparkSession.sparkContext.broadcast(frozenset(weights))

    def held(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = [{w for w in map(trimmed, set(t.lower().split())) if w} for t in batch.column(1).to_pylist()]
        found = [sorted({f for word in own for f in features(word) if f in names.value} | names.value.intersection(families(own))) for own in words]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], ["row", "found"])

    rows = map_batches(sample.filter("label > 0").select("row", "text"), held, "row bigint, found array<string>", STRETCH)
    marks = [F.sum(F.xxhash64("row", F.lit(seed)).cast("decimal(20,0)")).alias(f"s{seed}") for seed in (1, 2)]
    told = rows.select("row", F.explode("found").alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n"), *marks).collect()
    holders = {r["f"]: (r["n"], r["s1"], r["s2"]) for r in told}
    same: dict[tuple, list[str]] = defaultdict(list)
    for f in weights:
        same[holders.get(f, (0, 0, 0))].append(f)

    def longer(f: str, g: str) -> bool:
        return g != f and g.endswith("+") == f.endswith("+") and g.startswith(f.rstrip("+"))

    return {f: w for f, w in weights.items() if not any(longer(f, g) for g in same[holders.get(f, (0, 0, 0))])}


def fit(sample: DataFrame) -> ToxicityModel:
    """Learn from (id, text, label), all of whose rows count.  Without texts of both classes the lexicon is empty and every score is the smoothed share."""
    sample = stored(sample.withColumn("row", F.monotonically_increasing_id()))
    # Near copies are one piece of evidence: words that only stand beside telling ones in copies of a text prove nothing.
    groups = stored(near_copies(sample))
    evidence = sample.select("row", (F.col("label") > 0).alias("toxic")).join(groups.select("node", "copies"), F.col("row") == F.col("node"), "left")
    evidence = evidence.select("toxic", F.coalesce("copies", "row").alias("copies")).distinct()
    size = {r["toxic"]: r["n"] for r in evidence.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(True, 0), size.get(False, 0)
    words = stored(word_counts(sample, groups))
    tested = words.filter(F.col("toxic") + F.col("clean") >= 5)
    limit = 2 * math.log(20 * max(1, tested.count()))

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, 2 * seen * F.log(seen / expected)).otherwise(0.0)

    share, n = toxic / max(1, toxic + clean), F.col("toxic") + F.col("clean")
    away = F.lit(float(toxic)) - F.col("toxic"), F.lit(float(clean)) - F.col("clean")
    g2 = part(F.col("toxic"), n * share) + part(F.col("clean"), n * (1 - share)) + part(away[0], (toxic + clean - n) * share) + part(away[1], (toxic + clean - n) * (1 - share))
    # A feature must also make a text toxic more likely than not, at the lower end of its share's interval (Wilson, 95 %).
    p, z = F.col("toxic") / n, 1.96
    surely = (p + z * z / (2 * n) - z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n)
    telling = tested.filter((F.col("toxic") > n * share) & (g2 > limit) & (surely >= 0.5))
    # A beginning counts for itself only where several words share it and none makes up most of it.
    begun = words.filter((F.col("toxic") > 0) & F.col("word").endswith("$")).select(
        F.explode(F.array(*[F.when(F.length("word") > k, F.left("word", F.lit(k))) for k in STEMS])).alias("word"), F.col("toxic").alias("held"))
    shared = begun.filter("word IS NOT NULL").groupBy("word").agg(F.count(F.lit(1)).alias("kinds"), F.max("held").alias("top"))
    shared = shared.unionByName(shared.withColumn("word", F.concat("word", F.lit("+"))))
    telling = telling.join(shared, "word", "left").filter(F.col("word").endswith("$") | (F.col("kinds") >= 3) & (2 * F.col("top") <= F.col("toxic")))
    rows = telling.select("word", "toxic", "clean").collect() if toxic and clean else []
    weights = {r["word"]: math.log((r["toxic"] + 0.5) / (toxic + 1)) - math.log((r["clean"] + 0.5) / (clean + 1)) for r in rows}
    weights = longest_beginnings(sample, weights)
    model = ToxicityModel(weights, char_counts(words))
    sent = sample.sparkSession.sparkContext.broadcast(model)
    names = sorted(weights)
    place = {f: i for i, f in enumerate(names)}

    def found(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([sorted(place[f] for f in sent.value.reader().found(t)) for t in batch.column(0).to_pylist()], pa.list_(pa.int32())), batch.column(1)], ["found", "y"])

    # The features of the lexicon that texts hold, each set of them once.
    sets = map_batches(sample.select("text", (F.col("label") > 0).cast("int").alias("y")), found, "found array<int>, y int", STRETCH)
    sets = stored(sets.groupBy("found", "y").agg(F.count(F.lit(1)).alias("times")))
    worth = np.array([weights[f] for f in names])
    if sets.count() <= LOCAL_SETS:
        seen = sets.toArrow()
        adds, model.shift = logistic(seen["found"].to_pylist(), np.array(seen["y"].to_pylist(), float), worth, np.array(seen["times"].to_pylist(), float))
    else:
        adds, model.shift = logistic_sets(sets, worth)
    model.adds = dict(zip(names, adds.tolist()))
    return model


def fit_labels(docs: DataFrame, labels: DataFrame, use: Callable[[Column], Column], label: str = "toxic",
               id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """Learn from all labelled documents of which `use(id)` holds."""
    return fit(labelled_sample(docs, labels, label, use, None, id_col, text_col))


def toxicity(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score, found) for every row: the probability of the toxic label and the lexicon's features found, sorted.

    A NULL text counts as empty; rows repeating an id are scored each by its own text; an empty table gives no rows.
    """
    rows = keyed_text(docs, id_col, text_col)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, m = batch.column(1).to_pylist(), shared.value
        found = [sorted(m.reader().found(t)) for t in texts]
        scores = [m.probability(fs) for fs in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))], ["id", "score", "found"])

    return map_batches(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, score double, found array<string>", STRETCH)


def keep_mild(docs: DataFrame, model: ToxicityModel, text_col: str = "text", limit: float = 0.3) -> DataFrame:
    """The rows of `docs` that score below `limit`, columns unchanged; no row moves."""
    at, names = docs.columns.index(text_col), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        mild = [shared.value.score(t or "") < limit for t in batch.column(at).to_pylist()]
        return pa.RecordBatch.from_arrays(batch.columns, names).filter(pa.array(mild, pa.bool_()))

    return map_batches(docs, work, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), STRETCH)
