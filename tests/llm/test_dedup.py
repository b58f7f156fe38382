"""Exact, line and near deduplication against brute force."""

import random
import re
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tallyline.llm import simhash
from tallyline.llm.exact_dedup import FuseFilter, exact_dedup, keep_first
from tallyline.llm.line_dedup import dedup_lines

from .conftest import sentence


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 5_000, 60_000])
def test_fuse_filter(n):
    rng = np.random.default_rng(n)
    keys = rng.integers(0, 2**64, n, dtype=np.uint64)
    made = FuseFilter.from_bytes(FuseFilter.build(np.concatenate((keys, keys))).to_bytes())
    assert made.holds(keys).all()
    others = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert made.holds(others).mean() < 0.02


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


@pytest.mark.parametrize("shard_keys", [200_000, 5])
def test_exact_dedup(docs, corpus, shard_keys):
    groups = defaultdict(list)
    for i, t in corpus:
        groups[plain(t)].append((-len(t or ""), i))
    got = {r["id"]: r for r in exact_dedup(docs, shard_keys=shard_keys).collect()}
    assert len(got) == len(corpus)
    for members in groups.values():
        for _, i in members:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (min(members)[1], len(members), i == min(members)[1])


def test_exact_dedup_sides(docs, corpus):
    """Everything in the batch, nothing in the batch: the same groups."""
    from pyspark.sql import functions as F
    want = sorted(tuple(r) for r in exact_dedup(docs).collect())
    for side in (F.lit(True), F.lit(False), F.col("doc_id") > 20):
        assert sorted(tuple(r) for r in exact_dedup(docs, in_batch=side).collect()) == want


def test_exact_dedup_odd(odd, none):
    got = [(r["id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(odd).collect()]
    assert sorted(got, key=str) == sorted([(None, None, 3, True), (5, None, 3, False), (5, None, 3, False), (None, None, 2, True), (6, None, 2, False), (5, 5, 1, True)], key=str)
    assert exact_dedup(none).count() == 0


def test_keep_first(docs, none, odd, corpus):
    kept = keep_first(docs)
    assert kept.columns == docs.columns and kept.count() == len({plain(t) for _, t in corpus})
    assert keep_first(none).count() == 0
    again = odd.unionByName(odd)
    assert keep_first(again.filter("doc_id IS NOT NULL")).count() == 3


def brute_lines(corpus, min_chars=10):
    key = lambda line: re.sub(r"[A-Z]", lambda m: m[0].lower(), line.strip(" \t\n\v\f\r"))
    holders = defaultdict(set)
    for i, t in corpus:
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in corpus:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < min_chars or len(holders[key(x)]) < 2 or i == min(holders[key(x)])]
        out[i] = ("\n".join(kept), len(lines), len(lines) - len(kept))
    return out


def test_line_dedup(docs, none, corpus):
    got = {r["id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in dedup_lines(docs).collect()}
    want = brute_lines(corpus)
    assert got == want and any(n for _, _, n in want.values())
    assert dedup_lines(none).count() == 0


def test_line_dedup_odd(odd):
    got = sorted(((r["id"], r["text"], r["n_dropped"]) for r in dedup_lines(odd).collect()), key=str)
    assert got == sorted([(None, "alpha beta gamma delta", 0), (None, "", 0), (5, "", 1), (5, "", 1), (5, "another text here now", 0), (6, "", 0)], key=str)


def test_line_threshold(spark):
    df = spark.createDataFrame([(i, "a line held by three") for i in range(3)] + [(3, "a line held by two"), (4, "a line held by two")], "doc_id long, text string")
    assert sorted((r["id"], r["n_dropped"]) for r in dedup_lines(df, min_docs=3).collect()) == [(0, 0), (1, 1), (2, 1), (3, 0), (4, 0)]


def brute_fingerprint(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(points, reach):
    label = {i: i for i, _ in points}
    changed = True
    while changed:
        changed = False
        for i, f in points:
            for j, g in points:
                if bin(f ^ g).count("1") <= reach and label[j] < label[i]:
                    label[i], changed = label[j], True
    return label


@pytest.mark.parametrize("shard_points", [4_000, 4])
def test_near_groups(docs, none, corpus, shard_points):
    points = [(i, brute_fingerprint(t)) for i, t in corpus]
    want = brute_components(points, 2)
    got = {r["id"]: (r["fp"] % 2**64, r["component"]) for r in simhash.near_groups(docs, shard_points=shard_points).collect()}
    assert got == {i: (f, want[i]) for i, f in points}
    assert simhash.near_groups(none).count() == 0
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_near_groups_odd(odd):
    got = {(r["id"], r["component"]) for r in simhash.near_groups(odd).collect()}
    assert got == {(None, 5), (None, 6), (5, 5), (6, 6)}


@pytest.mark.parametrize("kind", ["random", "ball", "chain", "few"])
def test_close_edges(spark, kind):
    """Components over many shards equal those of all pairs."""
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**64, 1500, dtype=np.uint64)
    if kind == "ball":  # thousands of points within a few bits of one another
        values[:1000] = [np.uint64(0x1234567890ABCDEF) ^ np.uint64(1 << int(a) | 1 << int(b)) for a, b in rng.integers(0, 63, (1000, 2))]
    elif kind == "chain":
        for i in range(1, 400):
            values[i] = values[i - 1] ^ np.uint64(3 << int(rng.integers(0, 62)))
    elif kind == "few":
        values = values[:3]
    values = np.unique(values)
    label = np.arange(len(values))
    near = [np.flatnonzero(np.bitwise_count(values ^ v) <= 2) for v in values]
    while True:
        new = np.array([label[i].min() for i in near])
        if (new == label).all():
            break
        label = new
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long")
    edges = simhash.close_edges(frame, shard_points=100, sample_points=800)
    assert edges.count() <= 40 * len(values)
    found = {r["node"]: r["label"] for r in simhash.components(edges).collect()}
    groups, want = defaultdict(set), defaultdict(set)
    for v, l in zip(values.view(np.int64).tolist(), label.tolist()):
        groups[found.get(v, v)].add(v)
        want[l].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


@pytest.mark.parametrize("keep", [keep_first, simhash.keep_one])
def test_an_id_of_which_one_row_goes(spark, keep):
    """(5, one) is a copy of 3 and goes although another row of 5 stays; of equal rows of an id one stays."""
    one, two, three = ("alpha beta gamma delta", "another text with quite other words in it", "a third text that nobody else has written")
    rows = [(3, one, 1), (5, one, 2), (5, two, 3), (7, three, 4), (7, three, 5), (8, None, 6), (8, "", 7), (None, "no id here at all, only words", 8)]
    got = keep(spark.createDataFrame(rows, "doc_id long, text string, row int"))
    kept = sorted(((r["doc_id"], r["text"] or "") for r in got.collect()), key=str)
    assert got.columns == ["doc_id", "text", "row"]
    assert kept == sorted([(3, one), (5, two), (7, three), (8, ""), (None, rows[-1][1])], key=str)


def test_shards_stay_small(spark, monkeypatch):
    """More leaves than a sixteenth of the sample asked for: the sample grows and no shard does."""
    rng = np.random.default_rng(4)
    values = np.unique(rng.integers(0, 2**64, 6000, dtype=np.uint64))
    frame = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp long").repartition(4)
    trees = []
    make = simhash.VantageTree.__init__
    monkeypatch.setattr(simhash.VantageTree, "__init__", lambda self, sample, leaves: trees.append((self, len(sample))) or make(self, sample, leaves))
    simhash.close_edges(frame, shard_points=50, sample_points=64).count()
    tree, sampled = trees[0]
    _, leaf, home = tree.place(values, 0)
    sizes = np.bincount(leaf[home])
    assert sampled == 16 * 120 and (sizes > 0).sum() > 100 and sizes.max() <= 5 * 50


# ---- similar shingles

def five_words(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    return {" ".join(ws[i:i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def test_keep_unlike(spark, docs, none, odd):
    """Links are exact, nearly all copies of similarity 0.8 or more of a text go, the others stay."""
    rng = random.Random(21)
    rows = []
    for family in range(60):
        base = sentence(rng, rng.randint(60, 200)).split()
        rows.append((len(rows) * 10, " ".join(base)))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(1, 8)):
                copy[rng.randrange(len(copy))] = "other"
            rows.append((len(rows) * 10, " ".join(copy)))
    rows += [(9_999_990 + i, t) for i, t in enumerate(["", None, "few words", "Few  words"])]
    sets = [five_words(t) for _, t in rows]
    like = lambda x, y: bool(x and y) and 5 * len(x & y) >= 4 * len(x | y)
    frame = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "place long, text string").repartition(5)
    frame = frame.withColumn("text", F.coalesce("text", F.lit("")))
    links = {(r["a"], r["b"]) for r in simhash.similar_links(frame).collect()}
    assert links and all(a > b and like(sets[a], sets[b]) for a, b in links)
    root = list(range(len(rows)))
    found = list(range(len(rows)))
    for labels, pairs in ((root, [(a, b) for a in range(len(rows)) for b in range(a) if like(sets[a], sets[b])]), (found, sorted(links))):
        for a, b in pairs:
            old, new = sorted((labels[a], labels[b]))[::-1]
            labels[:] = [new if v == old else v for v in labels]
    assert sum(f != i for i, f in enumerate(found)) >= 0.97 * sum(r != i for i, r in enumerate(root)) > 30
    kept = simhash.keep_unlike(spark.createDataFrame(rows, "doc_id long, text string").withColumn("place", F.lit("x")))
    assert kept.columns == ["doc_id", "text", "place"]
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted(i for n, (i, _) in enumerate(rows) if found[n] == n)
    assert simhash.keep_unlike(none).count() == 0 and simhash.keep_unlike(docs).columns == docs.columns
    assert sorted((r["doc_id"] or -1, r["text"]) for r in simhash.keep_unlike(odd.fillna("")).collect()) == [(-1, ""), (5, "alpha beta gamma delta"), (5, "another text here now"), (6, "")]


def test_pairs_without_a_first_text_are_linked(spark):
    """All pairs that share a key are settled: the links join what comparing every pair would, whatever a group's first texts are."""
    rng = random.Random(33)
    rows, near = [], []
    for _ in range(12):
        words = sentence(rng, 400).split()
        for version in range(8):  # versions differ too much from each other; each has two copies that link to it
            mine = list(words)
            for i in rng.sample(range(400), 14):
                mine[i] = f"v{version}x{i}"
            for copy in range(3):
                text = list(mine)
                for i in rng.sample(range(400), 2 * copy):
                    text[i] = f"c{copy}"
                rows.append(" ".join(text))
    rng.shuffle(rows)
    rows += rows[:3]
    sets = [five_words(t) for t in rows]
    keys = [dict(enumerate(simhash.views(np.unique(simhash.shingles(t.encode(), 5)), 12, 4))) for t in rows]
    want = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if any(keys[a][v] == keys[b][v] for v in keys[a]) and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                new, old = sorted((want[a], want[b]))
                want = [new if w == old else w for w in want]
    frame = spark.createDataFrame(list(enumerate(rows)), "place long, text string").repartition(4)
    for options in ({}, {"rounds": 0, "block_rows": 3}, {"rounds": 1, "block_rows": 2}):
        links = [tuple(r) for r in simhash.similar_links(frame, **options).collect()]
        got = list(range(len(rows)))
        for a, b in links:
            assert a > b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
            new, old = sorted((got[a], got[b]))
            got = [new if g == old else g for g in got]
        assert got == want


@pytest.mark.parametrize("block_rows", [500, 4])
def test_blocks_give_links_not_pairs(spark, block_rows):
    """Of a group whose texts are all alike the last step gives links that join it, not a row for every pair."""
    words = sentence(random.Random(5), 300).split()
    texts = [" ".join(words[:i] + ["other"] + words[i + 1:]) for i in range(30)] + [" ".join(words[:150] + sentence(random.Random(i), 150).split()) for i in range(10)]
    rows = spark.createDataFrame(list(enumerate(texts)), "place long, text string")
    members = rows.select(F.lit(0).alias("view"), F.lit(1).cast("long").alias("key"), "place", F.lit(296).cast("long").alias("size"), F.col("place").alias("label"))
    links = [tuple(r) for r in simhash._rest(rows, members, 0.8, 5, block_rows).collect()]
    blocks = -(-40 // block_rows)
    assert 29 <= len(links) <= 30 * (blocks + 1) and all(30 > a > b for a, b in links)
    assert {r["label"] for r in simhash.components(spark.createDataFrame(links, "a long, b long")).collect()} == {0}


@pytest.mark.parametrize("most", [-1, 10**6])
def test_components_in_one_task_and_by_rounds(spark, monkeypatch, most):
    monkeypatch.setattr(simhash, "LOCAL_EDGES", most)
    edges = [(i, i + 1) for i in range(1, 40)] + [(-5, 60), (60, 61), (60, 60), (70, 70), (61, -5)]
    frame = spark.createDataFrame(edges, "a long, b long")
    want = {i: 1 for i in range(1, 41)} | {-5: -5, 60: -5, 61: -5}
    got = [(r["node"], r["label"]) for r in simhash.components(frame).collect()]
    assert len(got) == len(want) and dict(got) == want
    assert simhash.components(frame.filter("a > 1000")).collect() == []
