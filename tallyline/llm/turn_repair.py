"""Repair of a conversation's turns at the least cost, with the least audit of the cheapest edits.

Every turn is kept, given another role or deleted, and turns without text may be inserted, until the roles read: a system
turn or none, then user and assistant in turn (or nothing at all).  A node is a place among the turns and what the last
role left was; a first pass from the end gives each node the cost still to come, and the edits that keep to it are its
optimal arcs.  Arcs are ranked by the least audit of one edit from there on, then of 2, 4, 8 ..., each round ranking pairs of
the round before; the ranks choose at each node, and the path is read off through the doubled pointers.

Rows are range-partitioned by conversation and order.  Conversations inside a partition are done there and then; those that
may run on in a neighbour are done piece by piece: a piece is a 4 x 4 table of least costs, chained from the end, so that
no task reads a whole conversation but the one that hashes its text in order, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import named, same_key, stored

_BLANKS = " \t\n\x0b\x0c\r"
# What the last role was: nothing yet, system, user, assistant.
_NOTHING, _SYSTEM, _USER, _ASSISTANT = range(4)
_KEPT = ({"s": _SYSTEM, "u": _USER}, {"u": _USER}, {"a": _ASSISTANT}, {"u": _USER})
# The one role a new or renamed turn can have.
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
_RENAME, _DELETE, _INSERT, _TRUNCATED = 2, 3, 2, 1
_FAR = 1 << 50
_IN_ORDER = ("su", "ua", "au")


class Turn(NamedTuple):
    initial: str
    doomed: bool  # blank or a duplicate: only deletion is open to it
    truncated: bool


def closed(costs: list[int]) -> list[int]:
    """Costs to come once turns may be inserted at this place."""
    user, assistant = min(costs[_USER], costs[_ASSISTANT] + _INSERT), min(costs[_ASSISTANT], costs[_USER] + _INSERT)
    return [min(costs[_NOTHING], user + _INSERT), min(costs[_SYSTEM], user + _INSERT), user, assistant]


# Costs to come behind the last turn, and the edits there.
_END = closed([0, _FAR, _FAR, 0])
_LAST_EDITS = {_NOTHING: (), _SYSTEM: (_USER, _ASSISTANT), _USER: (_ASSISTANT,), _ASSISTANT: ()}


def costs_to_come(turns: list[Turn], end: list[int]) -> list[list[int]]:
    """For each place, and the one behind the last, the least cost from each state on."""
    out = [end]
    for turn in reversed(turns):
        after = out[-1]
        here = [c + _DELETE for c in after]
        if not turn.doomed:
            for state in range(4):
                here[state] = min(here[state], after[_NEXT[state]] + _RENAME + turn.truncated)
                kept = _KEPT[state].get(turn.initial)
                if kept is not None:
                    here[state] = min(here[state], after[kept] + turn.truncated)
        out.append(closed(here))
    out.reverse()
    return out


class Paths:
    """The least cheapest path from each state before a stretch of turns; `end` is the cost to come behind it."""

    def __init__(self, turns: list[Turn], end: list[int]):
        self.costs = costs_to_come(turns, end)
        self.last = 4 * len(turns)
        source, label, target = [], [], []

        def arc(node: int, edit: str, to: int) -> None:
            source.append(node)
            label.append(ord(edit))
            target.append(to)

        for place, turn in enumerate(turns):
            here, after, node = self.costs[place], self.costs[place + 1], 4 * place
            for state in range(4):
                if here[state] == after[state] + _DELETE:
                    arc(node + state, "D", node + 4 + state)
                if here[state] == here[_NEXT[state]] + _INSERT:
                    arc(node + state, "I", node + _NEXT[state])
                if not turn.doomed:
                    kept = _KEPT[state].get(turn.initial)
                    if kept is not None and here[state] == after[kept] + turn.truncated:
                        arc(node + state, "K", node + 4 + kept)
                    if here[state] == after[_NEXT[state]] + _RENAME + turn.truncated:
                        arc(node + state, "R", node + 4 + _NEXT[state])
        for state in range(4):  # the path has ended: no letter, and it stays there
            source.append(self.last + state)
            label.append(0)
            target.append(self.last + state)
        self.source, self.label, self.target = (np.array(x, np.int64) for x in (source, label, target))
        self._rank()

    def _first(self, rank: np.ndarray) -> np.ndarray:
        """The arc of least rank of each node."""
        order = np.lexsort((rank, self.source))
        nodes, at = np.unique(self.source[order], return_index=True)
        first = np.zeros(self.last + 4, np.int64)
        first[nodes] = order[at]
        return first

    def _rank(self) -> None:
        rank = np.unique(self.label, return_inverse=True)[1]
        # Edits of one kind lead from a node to one node alone, so the first letters already tell which arc follows.
        jump = self._first(rank)[self.target]
        self.jumps = [jump]
        while True:
            rank = np.unique(rank * (rank.max() + 1) + rank[jump], return_inverse=True)[1]
            if (self.source[jump] >= self.last).all():
                break
            jump = jump[jump]
            self.jumps.append(jump)
        self.best = self._first(rank)

    def edits(self, state: int) -> tuple[list[tuple[str, int, int]], int]:
        """([(edit, place, state after it)], state behind the last turn) from a state before the first."""
        path = np.array([self.best[state]])
        for jump in reversed(self.jumps):
            path = np.stack((path, jump[path]), axis=1).ravel()
        path = path[self.source[path] < self.last]
        steps = [(chr(c), s // 4, t % 4) for c, s, t in zip(self.label[path].tolist(), self.source[path].tolist(), self.target[path].tolist())]
        return steps, steps[-1][2] if steps else state


def edited(rows: list[tuple[str, str]], steps: list[tuple[str, int, int]], last: bool, state: int) -> list[tuple[str, str, str]]:
    """(edit, role, text) of every step, deleted turns as they were; `last`: also those behind the last turn."""
    out = []
    for edit, place, after in steps:
        if edit == "I":
            out.append((edit, _ROLE[after], ""))
        else:
            role, text = rows[place]
            out.append((edit, _ROLE[after] if edit == "R" else role, text))
    if last:
        out += [("I", _ROLE[s], "") for s in _LAST_EDITS[state]]
    return out


class Digest:
    """The hash of the turns left, as role:text joined by line feeds, and the audit; takes any number of edits."""

    def __init__(self):
        self.sha, self.audit, self.kept = hashlib.sha256(), [], 0

    def add(self, edit: str, role: str, text: str) -> None:
        self.audit.append(edit)
        if edit != "D":
            self.sha.update(("\n" * (self.kept > 0) + f"{role}:{text}").encode())
            self.kept += 1

    def result(self) -> tuple[str, int, str]:
        return "".join(self.audit), self.kept, self.sha.hexdigest()


def is_blank(text: str) -> bool:
    return not text.strip(_BLANKS)


def is_truncated(text: str) -> bool:
    return not text.rstrip(_BLANKS).endswith((".", "!", "?"))


def out_of_order(initials: list[str]) -> int:
    return sum(a + b not in _IN_ORDER for a, b in zip(initials, initials[1:]))


_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
_TURNS = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))


def repair_one(rows: list[tuple[int | None, str, str]]) -> tuple[list[int], list[tuple[str, str, str]]]:
    """(the numbers, the edits) of a whole conversation in order."""
    seen, turns, counts = set(), [], [0, 0, 0]
    for _, role, text in rows:
        if is_blank(text):
            fault = 0
        elif (role, text) in seen:
            fault = 1
        else:
            fault = 2 if is_truncated(text) else None
            seen.add((role, text))
        if fault is not None:
            counts[fault] += 1
        turns.append(Turn(role[:1], fault in (0, 1), fault == 2))
    paths = Paths(turns, _END)
    steps, state = paths.edits(_NOTHING)
    numbers = [t for t, _, _ in rows if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    edits = edited([(r, t) for _, r, t in rows], steps, True, state)
    return [gaps, *counts, out_of_order([t.initial for t in turns]), paths.costs[0][_NOTHING]], edits


def _local(id_type: pa.DataType) -> Callable:
    """Conversations inside a partition give their row; the turns of its first and last one are passed on."""
    names = ["conv", "piece", "at", "turn", "role", "text", "same", *_NUMBERS, "audit", "n_turns", "repaired_sha256", "turns"]
    types = [id_type, pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), *[pa.int64()] * 6, pa.string(), pa.int64(), pa.string(), _TURNS]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    def passed_on(conv, at: int, rows: list[tuple], piece: int) -> list[tuple]:
        return [(conv, piece, at + i, turn, role, text, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()[:16], *[None] * 10)
                for i, (turn, role, text) in enumerate(rows)]

    def done(conv, rows: list[tuple]) -> tuple:
        numbers, edits = repair_one(rows)
        digest = Digest()
        for edit in edits:
            digest.add(*edit)
        audit, kept, sha = digest.result()
        return (conv, None, None, None, None, None, None, *numbers, audit, kept, sha, [dict(zip(("edit", "role", "text"), e)) for e in edits])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        piece, started, first, conv, rows, at, out = TaskContext.get().partitionId(), False, True, None, [], 0, []
        for b in batches:
            for key, *turn in zip(*(c.to_pylist() for c in b.columns)):
                if started and key != conv:
                    out += passed_on(conv, at, rows, piece) if first else [done(conv, rows)]
                    at, rows, first = at + len(rows), [], False
                started, conv = True, key
                rows.append(tuple(turn))
                if len(out) >= 2000:
                    yield batch(out)
                    out = []
        if started:
            out += passed_on(conv, at, rows, piece)
        if out:
            yield batch(out)

    return run


def _grouped(function: Callable[[list[dict], list[dict]], list[dict]], schema: pa.Schema) -> Callable:
    """A function of the rows of one or two tables in order of (piece, at) as one of Arrow tables."""
    def order(table: pa.Table) -> list[dict]:
        return sorted(table.to_pylist(), key=lambda r: (r["piece"], r.get("at") or 0))

    def one(table: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(function(order(table), []), schema)

    def two(table: pa.Table, other: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(function(order(table), order(other)), schema)

    return one, two


def _turn(row: dict) -> Turn:
    return Turn(row["role"][:1], row["blank"] or row["repeated"], row["truncated"] and not row["blank"] and not row["repeated"])


def _measured(rows: list[dict], _: list[dict]) -> list[dict]:
    """A piece's table of least costs by state before and after it, and its counts."""
    turns = [_turn(r) for r in rows]
    table = [costs_to_come(turns, [0 if s == after else _FAR for s in range(4)])[0] for after in range(4)]
    initials = [t.initial for t in turns]
    return [{"conv": rows[0]["conv"], "piece": rows[0]["piece"], "table": [table[after][before] for before in range(4) for after in range(4)],
             "blank": sum(r["blank"] for r in rows), "duplicate": sum(r["repeated"] and not r["blank"] for r in rows),
             "truncated": sum(t.truncated for t in turns), "illegal": out_of_order(initials), "first": initials[0], "last": initials[-1]}]


def _chained(rows: list[dict], _: list[dict]) -> list[dict]:
    """For each piece the costs to come behind it; the first has the conversation's counts."""
    end, out = _END, []
    for r in reversed(rows):
        out.append({"conv": r["conv"], "piece": r["piece"], "end": end, "is_last": not out, "cost": None})
        end = [min(r["table"][4 * before + after] + end[after] for after in range(4)) for before in range(4)]
    out.reverse()
    out[0] |= {k: sum(r[k] for r in rows) for k in ("blank", "duplicate", "truncated", "illegal")} | {"cost": end[_NOTHING]}
    out[0]["illegal"] += sum(a["last"] + b["first"] not in _IN_ORDER for a, b in zip(rows, rows[1:]))
    return out


def _exits(rows: list[dict], chain: list[dict]) -> list[dict]:
    paths = Paths([_turn(r) for r in rows], chain[0]["end"])
    return [{"conv": rows[0]["conv"], "piece": rows[0]["piece"], "end": chain[0]["end"], "is_last": chain[0]["is_last"], "exits": [paths.edits(s)[1] for s in range(4)]}]


def _entries(rows: list[dict], _: list[dict]) -> list[dict]:
    state, out = _NOTHING, []
    for r in rows:
        out.append({k: r[k] for k in ("conv", "piece", "end", "is_last")} | {"entry": state})
        state = r["exits"][state]
    return out


def _walked(rows: list[dict], entry: list[dict]) -> list[dict]:
    steps, state = Paths([_turn(r) for r in rows], entry[0]["end"]).edits(entry[0]["entry"])
    edits = edited([(r["role"], r["text"]) for r in rows], steps, entry[0]["is_last"], state)
    return [{"conv": rows[0]["conv"], "piece": rows[0]["piece"], "at": i, "edit": e, "role": r, "text": t} for i, (e, r, t) in enumerate(edits)]


def _digests(id_type: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, digest = None, None

        def result() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([conv], id_type), *(pa.array([x]) for x in digest.result())], ["conv", "audit", "n_turns", "repaired_sha256"])

        for b in batches:
            for key, edit, role, text in zip(*(b.column(n).to_pylist() for n in ("conv", "edit", "role", "text"))):
                if digest is not None and key != conv:
                    yield result()
                if digest is None or key != conv:
                    conv, digest = key, Digest()
                digest.add(edit, role, text)
        if digest is not None:
            yield result()

    return run


class Repaired(NamedTuple):
    conversations: DataFrame  # (conv, gaps, blank, duplicate, truncated, illegal, cost, audit, n_turns, repaired_sha256)
    turns: DataFrame  # (conv, piece, at, edit, role, text): every edit in order, deleted turns as they were


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", piece_rows: int = 100_000,
) -> Repaired:
    """Repair every conversation of `rows`.

    Turns go by number (NULL first), then role, then text; a NULL role or text is one space.  A NULL id is an id.  A turn is
    blank (white space alone), else a duplicate (role and text seen earlier), else truncated (no mark at its end).  Ties of
    cost give the audit that is least as text.  No rows, no conversations.  `piece_rows`: about how many turns a task takes
    at once; results do not depend on it.  Duplicates across pieces are found by 128 bits of a hash.
    """
    spark = rows.sparkSession
    taken = rows.select(named(conv_col).alias("conv"), named(turn_col).cast("bigint").alias("turn"),
                        F.coalesce(named(role_col), F.lit(" ")).alias("role"), F.coalesce(named(text_col), F.lit(" ")).alias("text"))
    kind = taken.schema["conv"].dataType.simpleString()
    id_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    if id_type == pa.string() and kind != "string":
        raise TypeError(f"conversation ids of type {kind}: cast them to a number or text first")
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-taken.count() // piece_rows))
    order = [F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text", "row"]
    # The row number splits rows that are equal in all else.
    sorted_rows = taken.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(pieces, *order).sortWithinPartitions(*order)
    turns = "array<struct<edit: string, role: string, text: string>>"
    numbers = ", ".join(f"{n} bigint" for n in _NUMBERS)
    found = stored(sorted_rows.select("conv", "turn", "role", "text").mapInArrow(
        _local(id_type), f"conv {kind}, piece int, at bigint, turn bigint, role string, text string, same binary, {numbers}, audit string, n_turns bigint, repaired_sha256 string, turns {turns}"))
    columns = ["conv", *_NUMBERS, "audit", "n_turns", "repaired_sha256"]
    inner = found.filter("piece IS NULL")
    cut, cut_turns = _across(found.filter("piece IS NOT NULL").select("conv", "piece", "at", "turn", "role", "text", "same"), kind, id_type)
    placed = inner.select("conv", F.lit(0).alias("piece"), F.posexplode("turns").alias("at", "t"))
    return Repaired(
        inner.select(*columns).unionByName(cut.select(*columns)),
        placed.select("conv", "piece", F.col("at").cast("bigint").alias("at"), "t.edit", "t.role", "t.text").unionByName(cut_turns),
    )


def _across(rows: DataFrame, kind: str, id_type: pa.DataType) -> tuple[DataFrame, DataFrame]:
    """(conversations, turns) of those that may span pieces; what meets in a task is one piece, or a row for each piece."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    truncated = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    place = F.struct("piece", "at")
    again = rows.filter(~blank).groupBy("conv", "same").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    again = again.select(F.col("conv").alias("conv_"), F.col("same").alias("same_"), "first")
    marked = stored(
        rows.join(again, same_key(F.col("conv"), F.col("conv_")) & (F.col("same") == F.col("same_")), "left")
        .select("conv", "piece", "at", "turn", "role", "text", blank.alias("blank"), truncated.alias("truncated"),
                (~blank & F.coalesce(place != F.col("first"), F.lit(False))).alias("repeated")))

    def schema(*fields: tuple[str, pa.DataType]) -> tuple[pa.Schema, str]:
        names = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<bigint>", id_type: kind}
        fields = (("conv", id_type), ("piece", pa.int32()), *fields)
        return pa.schema(fields), ", ".join(f"{n} {names[t]}" for n, t in fields)

    numbers, by_piece, counts = pa.list_(pa.int64()), ("conv", "piece"), [(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal")]
    arrow, text = schema(("table", numbers), *counts, ("first", pa.string()), ("last", pa.string()))
    measured = marked.groupBy(*by_piece).applyInArrow(_grouped(_measured, arrow)[0], text)
    arrow, text = schema(("end", numbers), ("is_last", pa.bool_()), *counts, ("cost", pa.int64()))
    chain = stored(measured.groupBy("conv").applyInArrow(_grouped(_chained, arrow)[0], text))
    arrow, text = schema(("end", numbers), ("is_last", pa.bool_()), ("exits", numbers))
    exits = marked.groupBy(*by_piece).cogroup(chain.groupBy(*by_piece)).applyInArrow(_grouped(_exits, arrow)[1], text)
    arrow, text = schema(("end", numbers), ("is_last", pa.bool_()), ("entry", pa.int64()))
    entries = exits.groupBy("conv").applyInArrow(_grouped(_entries, arrow)[0], text)
    arrow, text = schema(("at", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string()))
    turns = stored(marked.groupBy(*by_piece).cogroup(entries.groupBy(*by_piece)).applyInArrow(_grouped(_walked, arrow)[1], text))
    order = ["conv", "piece", "at"]
    digests = turns.repartition("conv").sortWithinPartitions(*order).mapInArrow(
        _digests(id_type), f"conv {kind}, audit string, n_turns bigint, repaired_sha256 string")
    missing = F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")
    gaps = marked.groupBy("conv").agg(F.coalesce(missing, F.lit(0)).cast("bigint").alias("gaps"))
    out = chain.filter("cost IS NOT NULL").select(F.col("conv").alias("c"), "blank", "duplicate", "truncated", "illegal", "cost")
    out = out.join(gaps, same_key(F.col("c"), gaps["conv"])).drop("conv")
    return out.join(digests, same_key(F.col("c"), digests["conv"])).drop("c"), turns


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text): rows with faults put in, by crc32(`conv:turn`) modulo 20.

    0 drops the row, 1 empties its text, 2 takes the sentence marks out, 3 repeats it, 4 makes it the user's.  A NULL role or
    text, and a NULL id or number in the hashed text, is one space.
    """
    def shown(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit(" "))

    fault = F.crc32(F.concat(shown(named(conv_col)), F.lit(":"), shown(named(turn_col))).cast("binary")) % 20
    text = shown(named(text_col))
    faulty = rows.select(
        named(conv_col).alias("conv_id"), named(turn_col).alias("turn"), F.when(fault == 4, "user").otherwise(shown(named(role_col))).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).alias("copies"))
    return faulty.select("conv_id", "turn", "role", "text", F.explode(F.expr("array_repeat(0, copies)")).alias("copy")).drop("copy")
