"""SimHash near-duplicates: fingerprints, exact close pairs by vantage-point trees, and their connected groups.

Equal fingerprints are one point from the start.  A tree of vantage points, learned from a bounded sample, deals the
points into shards: the tree only decides where a point lives, so results do not depend on the sample.  Points whose
distance to a vantage point is near the splitting radius are also asked in the neighbouring shards, so that every close
pair meets in some shard.  Each shard searches with a vantage-point tree of its own and gives one edge for each point
of a local group, never the pairs of a group.  The edges are joined into groups by rounds of star contractions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import keyed_text, map_batches, named, same_key, stored, unused

_UPPER = bytes(range(65, 91))
_LOWER = bytes.maketrans(_UPPER, _UPPER.lower())
_SEED = 42  # fixed value of the contract
_LEAF = 256
# Texts whose sets of shingles a task makes at once.
_STRETCH = 1_000
# Up to this many edges (16 bytes each) are joined in one task, more by rounds over all tasks.
LOCAL_EDGES = 200_000


def shingles(text: bytes, shingle_words: int) -> np.ndarray:
    """A hash of each shingle, repeats included; of fewer words the whole sequence is one, of no words there is none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < shingle_words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), _SEED)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1)).tolist()
    ends = ends.tolist()
    digest, last = xxhash.xxh64_intdigest, shingle_words - 1
    return np.fromiter((digest(joined[a:b], _SEED) for a, b in zip(starts, ends[last:])), np.uint64, len(words) - last)


def fingerprint(text: bytes, shingle_words: int) -> int:
    """64 bits; a bit is set when more than half of the shingle hashes have it, repeats counted; no words give zero."""
    hashes = shingles(text, shingle_words)
    if not len(hashes):
        return 0
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 100_000):
        bits = np.unpackbits(hashes[at:at + 100_000].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3) -> DataFrame:
    """(id, fp): the fingerprint as a signed long with the same bits.  A NULL text counts as empty; blanks are ASCII white space."""
    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([fingerprint(t.encode(), shingle_words) for t in batch.column(1).to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["id", "fp"])

    rows = keyed_text(docs, id_col, text_col)
    return map_batches(rows, work, f"id {rows.schema['id'].dataType.simpleString()}, fp bigint")


def distances(points: np.ndarray, at: np.uint64) -> np.ndarray:
    return np.bitwise_count(points ^ at)


class VantageTree:
    """Inner nodes hold a point and a radius; points within the radius go to the near child.  Leaves are numbered."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.nodes: list[tuple[int, int, int, int]] = []  # (point, radius, near, far); a child below zero is leaf -child - 1
        self.leaves = 0
        self.root = self._grow(np.unique(sample), max(1, leaves))

    def _grow(self, sample: np.ndarray, leaves: int) -> int:
        if leaves > 1 and len(sample) >= 16:
            # Of a few candidates the one whose distances spread most leaves the fewest points near the radius.
            tried = sample[:: max(1, len(sample) // 8)][:8]
            point = max(tried, key=lambda p: float(np.var(distances(sample, p).astype(np.float64))))
            far = distances(sample, point)
            radius = int(np.median(far))
            near = far <= radius
            if 0 < near.sum() < len(sample):
                share = min(leaves - 1, max(1, round(leaves * near.mean())))
                at = len(self.nodes)
                self.nodes.append((0, 0, 0, 0))
                self.nodes[at] = (int(point), radius, self._grow(sample[near], share), self._grow(sample[~near], leaves - share))
                return at
        self.leaves += 1
        return -self.leaves

    def place(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(index of the point, leaf, home): every point once in its home leaf, and as a query in each leaf that may hold
        a point within `reach` of it.  Of a pair split by a node the near point is the one that asks."""
        out: list[tuple[np.ndarray, int, bool]] = []
        todo = [(self.root, np.arange(len(points)), True)]
        while todo:
            node, rows, home = todo.pop()
            if len(rows) == 0:
                continue
            if node < 0:
                out.append((rows, -node - 1, home))
                continue
            point, radius, near, far = self.nodes[node]
            d = distances(points[rows], np.uint64(point)).astype(np.int64)
            inside = d <= radius
            if home:
                todo += [(near, rows[inside], True), (far, rows[~inside], True), (far, rows[inside & (d + reach > radius)], False)]
            else:
                todo += [(near, rows[d - reach <= radius], False), (far, rows[d + reach > radius], False)]
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, bool)
        return (np.concatenate([r for r, _, _ in out]), np.concatenate([np.full(len(r), leaf, np.int32) for r, leaf, _ in out]),
                np.concatenate([np.full(len(r), home) for r, _, home in out]))


def close_pairs(points: np.ndarray, queries: np.ndarray, reach: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (point index, query index) at most `reach` bits apart, by a vantage-point tree over the points.

    The triangle inequality prunes: a query further than radius + reach from the vantage point cannot meet a near point.
    """
    todo = [(np.arange(len(points)), np.arange(len(queries)), False)]
    while todo:
        mine, asked, whole = todo.pop()
        if len(mine) == 0 or len(asked) == 0:
            continue
        if len(mine) <= _LEAF or whole:
            step = max(1, 4_000_000 // len(mine))
            for at in range(0, len(asked), step):
                block = asked[at:at + step]
                hit = np.bitwise_count(points[mine][:, None] ^ queries[block][None, :]) <= reach
                p, q = np.nonzero(hit)
                if len(p):
                    yield mine[p], block[q]
            continue
        tried = points[mine[:: max(1, len(mine) // 4)][:4]]
        vantage = max(tried, key=lambda v: float(np.var(distances(points[mine], v).astype(np.float64))))
        d, dq = distances(points[mine], vantage).astype(np.int64), distances(queries[asked], vantage).astype(np.int64)
        radius = int(np.median(d))
        near = d <= radius
        if near.all():
            near = d < radius
            radius -= 1
        if not near.any():  # all at one distance: nothing to prune by
            for at in range(0, len(mine), 4096):
                todo.append((mine[at:at + 4096], asked, True))
            continue
        todo += [(mine[near], asked[dq - reach <= radius], False), (mine[~near], asked[dq + reach > radius], False)]


def joined(labels: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Labels (each group's smallest position) after linking p with q."""
    while True:
        a, b = labels[p], labels[q]
        apart = a != b
        if not apart.any():
            return labels
        p, q, a, b = p[apart], q[apart], a[apart], b[apart]
        lower = np.arange(len(labels))
        np.minimum.at(lower, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = lower[lower]
            if np.array_equal(further, lower):
                break
            lower = further
        labels = lower[labels]


def local_edges(values: np.ndarray, home: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """(point, point): a star for each group of close points of one shard; at most one edge for each point."""
    labels, at_home = np.arange(len(values)), np.flatnonzero(home)
    waiting, size = [], 0
    for p, q in close_pairs(values[at_home], values, reach):
        waiting.append((at_home[p], q))
        size += len(p)
        if size > max(len(values), 1_000_000):
            labels = joined(labels, *(np.concatenate(x) for x in zip(*waiting)))
            waiting, size = [], 0
    if waiting:
        labels = joined(labels, *(np.concatenate(x) for x in zip(*waiting)))
    apart = values != values[labels]
    return values[labels[apart]], values[apart]


def close_edges(points: DataFrame, reach: int = 2, shard_points: int = 4_000, sample_points: int = 20_000) -> DataFrame:
    """(a, b): edges between distinct fingerprints `fp` whose connected groups are those of all pairs within `reach` bits.

    The tree is learned from a sample chosen by hash and every point is searched.  The sample has `sample_points`
    fingerprints, or sixteen a leaf where that is more (8 bytes for every 250th point), so that a shard stays near
    `shard_points` however many points there are.
    """
    spark = points.sparkSession
    total = points.count()
    leaves = max(1, math.ceil(total / shard_points))
    chosen = points.orderBy(F.xxhash64("fp"), "fp").limit(max(sample_points, 16 * leaves)).toPandas()["fp"].to_numpy(np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(VantageTree(chosen, leaves))

    def deal(batch: pa.RecordBatch) -> pa.RecordBatch:
        values = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
        rows, leaf, home = tree.value.place(values, reach)
        return pa.RecordBatch.from_arrays([pa.array(values[rows].view(np.int64)), pa.array(leaf), pa.array(home)], ["fp", "leaf", "home"])

    def search(shard: pd.DataFrame) -> pd.DataFrame:
        a, b = local_edges(shard["fp"].to_numpy(np.int64).view(np.uint64), shard["home"].to_numpy(bool), reach)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = map_batches(points.select("fp"), deal, "fp bigint, leaf int, home boolean")
    return dealt.groupBy("leaf").applyInPandas(search, "a bigint, b bigint").distinct()


def _joined_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of a few edges (a, b)."""
    edges = [[c.to_numpy() for c in batch.columns] for batch in batches]
    if edges:
        a, b = (np.concatenate(c) for c in zip(*edges))
        nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
        labels = joined(np.arange(len(nodes)), at[:len(a)], at[len(a):])
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[labels], pa.int64())], ["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over edges (a, b); nodes without an edge are absent.

    Up to LOCAL_EDGES different edges are joined in one task.  More alternate large-star and small-star contractions until no
    edge changes; each round is stored.
    """
    two = F.col("a") != F.col("b")
    now = stored(edges.filter(two).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if now.count() <= LOCAL_EDGES:
        return now.coalesce(1).mapInArrow(_joined_groups, "node bigint, label bigint")
    mark = (0, None)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = stored(large)
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = stored(small.unionByName(low.select("a", F.col("m").alias("b"))).filter(two).distinct())
        seen = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            break
        mark = tuple(seen)
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())


def near_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 3, reach: int = 2, shard_points: int = 4_000
) -> DataFrame:
    """(id, fp, component): for every row its fingerprint and the smallest id reachable over links of `reach` bits or fewer.

    A NULL text counts as empty; texts without words have fingerprint zero and link like any other.  NULL ids are no
    label unless nothing else is in the group.  Rows repeating an id each get their own fingerprint; an empty table
    gives no rows.
    """
    rows = stored(fingerprints(docs, id_col, text_col, shingle_words))
    points = stored(rows.groupBy("fp").agg(F.min("id").alias("least")))
    groups = components(close_edges(points, reach, shard_points))
    placed = points.join(groups, F.col("fp") == F.col("node"), "left").withColumn("group", F.coalesce("label", "fp"))
    named_groups = placed.groupBy("group").agg(F.min("least").alias("component"))
    lookup = placed.select("fp", "group").join(named_groups, "group").select("fp", "component")
    return rows.join(lookup, "fp").select("id", "fp", "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of `docs` of each near-duplicate group, the one with the smallest id; columns unchanged.

    A NULL text counts as empty; texts without words link like any other.  A NULL id stays only in a group without other
    ids, then one row of each fingerprint.  Of rows repeating an id each stays or goes by its own text, and of those in one group any one stays.  An empty
    table gives an empty one.  Only rows of ids that come several times are fingerprinted again.
    """
    groups = stored(near_groups(docs, id_col, text_col, **options)).withColumn("kept", F.col("id").eqNullSafe(F.col("component")))
    ids = groups.groupBy("id").agg(F.count(F.lit(1)).alias("rows"), F.bool_or("kept").alias("any_kept")).filter("any_kept")
    once, more = (ids.filter(F.col("rows") == 1 if single else F.col("rows") > 1).select(F.col("id").alias("_kept")) for single in (True, False))
    rows = docs.join(once, same_key(docs[id_col], once["_kept"]), "left_semi")
    if more.isEmpty():
        return rows
    row = unused("row", docs.columns)
    again = stored(docs.join(more, same_key(docs[id_col], more["_kept"]), "left_semi").withColumn(row, F.monotonically_increasing_id()))
    prints = fingerprints(again, row, text_col, options.get("shingle_words", 3)).select(F.col("id").alias("place"), "fp")
    places = again.select(named(id_col).alias("id"), F.col(row).alias("at")).join(prints, F.col("at") == F.col("place")).select("id", "at", "fp")
    # A kept id is its group's label, so its rows that stay are all of one group.
    members = groups.filter("kept").select(F.col("id").alias("kept_id"), F.col("fp").alias("kept_fp")).distinct()
    stays = places.join(members, same_key(F.col("id"), F.col("kept_id")) & (F.col("fp") == F.col("kept_fp")))
    first = stays.groupBy("kept_id", F.when(F.col("kept_id").isNull(), F.col("fp")).alias("print")).agg(F.min("at").alias("_at"))
    return rows.unionByName(again.join(first, again[row] == first["_at"], "left_semi").drop(row))


def views(hashes: np.ndarray, count: int, width: int) -> list[int]:
    """`count` keys of a set of hashes, each of the smallest ones under `width` permutations: two sets share a key with the
    probability similarity ** width."""
    factors = np.random.default_rng(_SEED).integers(0, 2**63, count * width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    least = np.full(count * width, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 4096):
        least = np.minimum(least, (hashes[at:at + 4096, None] * factors).min(axis=0))
    return [xxhash.xxh64_intdigest(key.tobytes(), _SEED) for key in least.reshape(count, width)]


def similar_links(
    rows: DataFrame, similarity: float = 0.8, shingle_words: int = 5, count: int = 12, width: int = 4, rounds: int = 4, block_rows: int = 500
) -> DataFrame:
    """(a, b): pairs of `place` of (place, text) whose sets of shingles have at least `similarity` (Jaccard), each checked on
    the whole sets.

    Texts that share a key of `views` form a group.  The links given join whatever all pairs of all groups would join: texts
    of equal sets are one from the start; in each of a few rounds a text is compared with one or two of its group that it is
    not yet joined to, so that pairs follow the texts; then every pair left of texts of one group that are not joined is
    compared, a group being met block by block.  Pairs already joined, through others too, need no comparison.  Texts
    without words link to none.
    """
    def sketch(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingles(t.encode(), shingle_words)) for t in batch.column(1).to_pylist()]
        keys = [np.array(views(h, count, width) if len(h) else [], np.uint64).view(np.int64) for h in sets]
        digests = [xxhash.xxh3_128_digest(h.tobytes()) for h in sets]
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([len(h) for h in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64()))],
            ["place", "size", "digest", "views"])

    made = stored(map_batches(rows.select("place", "text"), sketch, "place bigint, size bigint, digest binary, views array<bigint>", _STRETCH).filter("size > 0"))
    firsts = stored(made.groupBy("digest").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")))
    equal = made.select("place", "digest").join(firsts.filter("n > 1"), "digest").filter("place <> first").select(F.col("place").alias("a"), F.col("first").alias("b"))
    links = [stored(equal)]
    alone = made.join(firsts.select(F.col("first").alias("place")), "place", "left_semi")
    keyed = alone.select("place", "size", F.posexplode("views").alias("view", "key"))
    groups = keyed.groupBy("view", "key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = stored(keyed.join(groups.drop("n"), ["view", "key"]).withColumn("label", F.col("place")))
    for at in range(rounds + 1):
        sizes = members.groupBy("view", "key", "label").agg(F.count(F.lit(1)).alias("n"))
        waiting = sizes.groupBy("view", "key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("joined"))
        told = waiting.agg(F.sum("n").alias("members"), F.sum((F.col("n") * F.col("n") - F.col("joined")) / 2).alias("pairs")).first()
        if not told["pairs"]:
            break
        last = at == rounds or told["pairs"] <= told["members"]
        found = _rest(rows, members, similarity, shingle_words, block_rows) if last else _alike(rows, _some(members, similarity, at), similarity, shingle_words)
        links.append(found)
        if last:
            break
        labels = members.select("place", "label").distinct()
        one, two = (labels.select(F.col("place").alias(c), F.col("label").alias(f"_{c}")) for c in "ab")
        joined_ = components(found.join(one, "a").join(two, "b").select(F.col("_a").alias("a"), F.col("_b").alias("b")))
        moved = members.join(joined_.select(F.col("label").alias("_to"), F.col("node").alias("label")), "label", "left")
        moved = moved.select("view", "key", "place", "size", F.coalesce("_to", "label").alias("label"))
        # Groups that are joined throughout are done.
        open_ = moved.groupBy("view", "key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("view", "key")
        members = stored(moved.join(open_, ["view", "key"]))
    out = links[0]
    for more in links[1:]:
        out = out.unionByName(more)
    return out


def _pairs(met: DataFrame, similarity: float) -> DataFrame:
    """Distinct pairs (a, b) of (own, with) that are not joined and of sizes that can be as similar."""
    fits = F.least("own.size", "with.size") >= F.lit(similarity) * F.greatest("own.size", "with.size")
    pairs = met.filter((F.col("own.label") != F.col("with.label")) & fits)
    return stored(pairs.select(F.greatest("own.place", "with.place").alias("a"), F.least("own.place", "with.place").alias("b")).distinct())


def _some(members: DataFrame, similarity: float, at: int) -> DataFrame:
    """Each member of a group with two of the group, of different labels: the first by place in the first round, else by hashes."""
    own = F.struct("place", "size", "label")
    by = F.col("place") if at == 0 else F.xxhash64("label", F.lit(at))
    ends = members.groupBy("view", "key").agg(F.min_by(own, by).alias("low"), F.max_by(own, by).alias("high"))
    few = F.array("low") if at == 0 else F.array("low", "high")
    return _pairs(members.select("view", "key", own.alias("own")).join(ends, ["view", "key"]).select("own", F.explode(few).alias("with")), similarity)


def whole_sets(rows: DataFrame, places: DataFrame, shingle_words: int) -> DataFrame:
    """(place, hashes): the whole sets of shingles of the rows of (place, text) at `places`."""
    def whole(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [np.unique(shingles(t.encode(), shingle_words)).view(np.int64) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["place", "hashes"])

    asked = places.select(F.col("place").alias("asked")).distinct()
    return stored(map_batches(rows.join(asked, F.col("place") == F.col("asked"), "left_semi").select("place", "text"), whole, "place bigint, hashes array<bigint>", _STRETCH))


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values every two sets share."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    starts = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    ends = np.append(starts[1:], len(flat))
    out = np.zeros((len(sets), len(sets)), np.int32)
    shared = ends - starts > 1
    for a, b in zip(starts[shared].tolist(), ends[shared].tolist()):
        holders = owner[a:b]
        out[holders[:, None], holders] += 1
    return out


def forest(nodes: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Positions of links (p, q) that join what all of them join, at most one for each node."""
    labels, chosen = np.arange(nodes), []
    left = np.arange(len(p))
    while len(left := left[labels[p[left]] != labels[q[left]]]):
        first = left[np.unique(np.maximum(labels[p[left]], labels[q[left]]), return_index=True)[1]]
        chosen.append(first)
        labels = joined(labels, p[first], q[first])
    return np.concatenate(chosen) if chosen else left


def _rest(rows: DataFrame, members: DataFrame, similarity: float, shingle_words: int, block_rows: int) -> DataFrame:
    """Links (a, b) that join what all pairs of a group do that are not joined yet.

    Every two blocks of a large group meet in a task of their own with their whole sets, so that no pair is a row, no set moves
    once for each pair, and no task holds more of a group.
    """
    groups = members.groupBy("view", "key").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("blocks"))
    dealt = members.join(groups, ["view", "key"]).withColumn("block", F.pmod(F.xxhash64("place"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "view", "key", F.least("block", "to").alias("one"), F.greatest("block", "to").alias("two"), "place", "label")
    met = met.join(whole_sets(rows, members, shingle_words), "place")

    def compare(block: pd.DataFrame) -> pd.DataFrame:
        place, label = block["place"].to_numpy(np.int64), block["label"].to_numpy(np.int64)
        both, size = shared_counts(list(block["hashes"])), block["hashes"].map(len).to_numpy(np.int64)
        like = (both >= similarity * (size[:, None] + size - both)) & (label[:, None] != label) & (place[:, None] > place)
        p, q = np.nonzero(like)
        at = forest(len(place), p, q)
        return pd.DataFrame({"a": place[p[at]], "b": place[q[at]]})

    return stored(met.groupBy("view", "key", "one", "two").applyInPandas(compare, "a bigint, b bigint").distinct())


def _alike(rows: DataFrame, pairs: DataFrame, similarity: float, shingle_words: int) -> DataFrame:
    """The pairs (a, b) of `place` whose whole sets are as similar."""
    sets = whole_sets(rows, pairs.select(F.explode(F.array("a", "b")).alias("place")), shingle_words)
    one, two = (sets.select(F.col("place").alias(c), F.col("hashes").alias(f"{c}_set")) for c in "ab")
    both = F.size(F.array_intersect("a_set", "b_set"))
    return stored(pairs.join(one, "a").join(two, "b").filter(both >= F.lit(similarity) * (F.size("a_set") + F.size("b_set") - both)).select("a", "b"))


def keep_unlike(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of `docs` of each group linked by `similar_links`, the one with the smallest id; columns unchanged.

    A NULL text counts as empty and stays, as do texts without words.  A NULL id counts as larger than any.  Rows repeating
    an id are rows of their own; of equal ids in one group any one stays.  An empty table gives an empty one.
    """
    place = unused("place", docs.columns)
    rows = stored(docs.withColumn(place, F.monotonically_increasing_id()))
    texts = rows.select(F.col(place).alias("place"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    groups = stored(components(similar_links(texts, **options)))
    ids = rows.select(F.col(place).alias("node"), named(id_col).alias("id")).join(groups, "node")
    first = ids.groupBy("label").agg(F.min(F.struct(F.col("id").isNull(), "id", "node")).alias("first"))
    gone = groups.join(first, "label").filter("node <> first.node").select(F.col("node").alias("_gone"))
    return rows.join(gone, rows[place] == gone["_gone"], "left_anti").drop(place)
