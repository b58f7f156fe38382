"""Repair of conversations against an exhaustive search, whole and piece by piece."""

import hashlib
import itertools
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tallyline.llm.queries import op13
from tallyline.llm.turn_repair import _END, Paths, Turn, damaged, repair, repair_one

GOOD = re.compile("(s?(ua)+)?")


def cheapest(rows):
    """(cost, audit, turns left) by trying every edit; rows: (initial, doomed, truncated, role, text)."""
    @lru_cache(None)
    def rest(place, left):
        """The least (cost, audit, turns) from this place on, behind the roles left so far."""
        best = [(0, "", ())] if place == len(rows) and GOOD.fullmatch(left) else []
        if place < len(rows):
            initial, doomed, cut, role, text = rows[place]
            options = [(3, "D", left, ())]
            if not doomed:
                options += [(cut, "K", left + initial, ((role, text),))] + [(2 + cut, "R", left + r[0], ((r, text),)) for r in ("user", "assistant")]
            for cost, edit, after, kept in options:
                if re.fullmatch("s?(ua)*u?", after) or not after:
                    best += [(cost + c, edit + a, kept + t) for c, a, t in rest(place + 1, after)]
        if len(left) < 2 * len(rows) + 3:
            for r in ("user", "assistant"):
                if re.fullmatch("s?(ua)*u?", left + r[0]):
                    best += [(2 + c, "I" + a, ((r, ""),) + t) for c, a, t in rest(place, left + r[0])]
        return [min(best)] if best else []

    return rest(0, "")[0]


def kinds(turns):
    return [(*t, {"s": "system", "u": "user", "a": "assistant"}.get(t.initial, t.initial), f"t{i}") for i, t in enumerate(turns)]


def test_cheapest_and_least():
    every = [Turn(i, d, c) for i in "suax" for d, c in ((False, False), (False, True), (True, False))]
    rng = random.Random(1)
    cases = [list(x) for n in (0, 1, 2) for x in itertools.product(every, repeat=n)] + [[rng.choice(every[:9]) for _ in range(rng.randint(3, 6))] for _ in range(150)]
    for turns in cases:
        paths = Paths(turns, _END)
        steps, state = paths.edits(0)
        audit = "".join(e for e, _, _ in steps) + {0: "", 1: "II", 2: "I", 3: ""}[state]
        cost, least, _ = cheapest(tuple(kinds(turns)))
        assert (paths.costs[0][0], audit) == (cost, least), turns


ROLES = ["user", "assistant", "system", "", "tool"]


def talk(rng, n):
    texts = ["Yes.", "No", " ", "", "Why?\n", "so\t", "Well!"]
    out, t = [], 0
    for _ in range(n):
        t += rng.choice([0, 1, 1, 1, 3])
        out.append((t if rng.random() < .95 else None, rng.choice(ROLES[:2]) if rng.random() < .8 else rng.choice(ROLES + [None]), rng.choice(texts + [None, f"text {t}.", f"text {t}"])))
    return out


def by_hand(rows):
    """The result of one conversation taken whole, in the stated order."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return repair_one(rows)


@pytest.mark.parametrize("piece_rows", [3, 50, 100_000])
def test_whole_and_in_pieces(spark, piece_rows):
    """A conversation with a third of all rows, equal rows among them, cut into pieces gives what it gives whole."""
    rng = random.Random(5)
    talks = {c: talk(rng, rng.randint(1, 9)) for c in range(30)} | {77: talk(rng, 90) + [(4, "user", "same.")] * 12, None: talk(rng, 4)}
    rows = [(c, t, r, x, i) for c, turns in talks.items() for i, (t, r, x) in enumerate(turns)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, piece int")
    got = repair(frame, piece_rows=piece_rows)
    found = {r["conv"]: r for r in got.conversations.collect()}
    assert set(found) == set(talks)
    left = {}
    for r in sorted(got.turns.collect(), key=lambda r: (r["piece"], r["at"])):
        left.setdefault(r["conv"], []).append((r["edit"], r["role"], r["text"]))
    for c, turns in talks.items():
        numbers, edits = by_hand(turns)
        r = found[c]
        assert [r[n] for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")] == numbers
        assert left.get(c, []) == edits and r["audit"] == "".join(e for e, _, _ in edits)
        kept = [f"{role}:{text}" for e, role, text in edits if e != "D"]
        assert r["n_turns"] == len(kept) and r["repaired_sha256"] == hashlib.sha256("\n".join(kept).encode()).hexdigest()
        roles = "".join(k[0] for k in kept)
        assert GOOD.fullmatch(roles)


def test_short_conversations_against_search():
    rng = random.Random(9)
    for _ in range(120):
        rows = sorted(((t, r or " ", " " if x is None else x) for t, r, x in talk(rng, rng.randint(1, 5)) if t is not None), key=lambda r: (r[0], r[1], r[2]))
        seen, marked = set(), []
        for _, role, text in rows:
            blank, again = not text.strip(" \t\n\x0b\x0c\r"), (role, text) in seen
            seen.add((role, text))
            cut = not blank and not again and text.rstrip(" \t\n\x0b\x0c\r")[-1] not in ".!?"
            marked.append((role[:1], blank or again, cut, role, text))
        numbers, edits = repair_one(rows)
        cost, audit, turns = cheapest(tuple(marked))
        assert (numbers[5], "".join(e for e, _, _ in edits)) == (cost, audit)
        assert [(r, x) for e, r, x in edits if e != "D"] == list(turns)


def test_damage(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"Say {t}. Ok? Yes!") for c in range(40) for t in range(5)] + [(None, None, None, None)]
    got = damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    want = []
    for c, t, r, x in rows:
        fault = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if fault == 1 else re.sub("[.!?]", "", x) if fault == 2 else x
        want += [(c, t, "user" if fault == 4 else r, x)] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert {zlib.crc32(f"{c}:{t}".encode()) % 20 for c in range(40) for t in range(5)} >= {0, 1, 2, 3, 4}


def test_empty_and_clashing(spark, tmp_path):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair(empty).conversations.count() == 0 and repair(empty).turns.count() == 0
    # One whole conversation is dropped: it still has a row.
    gone = next(c for c in range(10_000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = spark.createDataFrame([(gone, 0, "user", "Hi."), (gone + 1, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    rows.select("*", *[F.lit(1).alias(c) for c in ("conv", "piece", "at", "same", "edit", "row", "first")]).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["conv_id"]: r for r in op13(spark, str(tmp_path)).collect()}
    assert set(got) == {gone, gone + 1}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
