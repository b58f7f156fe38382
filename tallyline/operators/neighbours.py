"""Mutual information from nearest neighbours, exact at any size.

Distances are the larger of the two coordinate gaps.  Coordinates are read as whole multiples of 2^-30 standard deviations,
so that distances and counts are exact.  Points are dealt to the leaves of a tree of boxes: a leaf finds each point's k
nearest within itself, and a point whose ball leaves its box asks the other boxes that the ball meets.  A leaf's points lie
in small cells and only the cells that a ball meets are compared, so the work grows with the points.  The numbers of points
nearer than that along each axis alone come from one running count over values and bounds.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.ordered import arrange, finish, running
from ..session import stored, tasks_for

_UNIT = float(1 << 30)
_FAR = 1 << 62


def digamma(n: Column) -> Column:
    """For whole numbers from 1 on, to some 1e-10."""
    z = n + 8.0
    series = F.ln(z) - 0.5 / z - 1.0 / (12.0 * z * z) + 1.0 / (120.0 * F.pow(z, F.lit(4.0))) - 1.0 / (252.0 * F.pow(z, F.lit(6.0)))
    for i in range(8):
        series = series - 1.0 / (n + float(i))
    return series


class Boxes:
    """A tree of boxes over the plane, split at medians of a sample; leaves hold about equal shares of the sample."""

    def __init__(self, sample: np.ndarray, leaves: int):
        self.axis, self.cut, self.low, self.high = [], [], [], []
        self.leaf, self.bounds = [], []
        self._grow(sample, max(1, leaves), np.array([-_FAR, -_FAR, _FAR, _FAR]))
        self.axis, self.cut, self.low, self.high, self.leaf = (np.array(x, np.int64) for x in (self.axis, self.cut, self.low, self.high, self.leaf))
        self.bounds = np.array(self.bounds, np.int64)  # x from, y from, x to, y to of a leaf; the upper ends are outside

    def _grow(self, sample: np.ndarray, leaves: int, box: np.ndarray) -> int:
        node = len(self.axis)
        for column in (self.axis, self.cut, self.low, self.high, self.leaf):
            column.append(-1)
        if leaves > 1 and len(sample) > 1:
            axis = int(np.argmax(np.ptp(sample.astype(float), axis=0)))
            values = sample[:, axis]
            cut = int(np.partition(values, len(values) // 2)[len(values) // 2])
            below = values < cut
            if not below.any() and (values > cut).any():  # half of the values or more are the least one
                cut = int(values[values > cut].min())
                below = values < cut
            if below.any():
                left, right = box.copy(), box.copy()
                left[2 + axis] = right[axis] = cut
                self.axis[node], self.cut[node] = axis, cut
                share = min(max(round(leaves * np.count_nonzero(below) / len(values)), 1), leaves - 1)
                self.low[node] = self._grow(sample[below], share, left)
                self.high[node] = self._grow(sample[~below], leaves - share, right)
                return node
        self.leaf[node] = len(self.bounds)
        self.bounds.append(box)
        return node

    def meets(self, x: np.ndarray, y: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the point, leaf) of every box that a point's square of half width `reach` meets."""
        at, rows, leaves = [(0, np.arange(len(x)))], [], []
        centre = (x, y)
        while at:
            node, who = at.pop()
            if not len(who):
                continue
            if self.leaf[node] >= 0:
                rows.append(who)
                leaves.append(np.full(len(who), self.leaf[node]))
                continue
            value = centre[self.axis[node]][who]
            at.append((self.low[node], who[value - reach[who] < self.cut[node]]))
            at.append((self.high[node], who[value + reach[who] >= self.cut[node]]))
        return np.concatenate(rows), np.concatenate(leaves)


def _compare(x: np.ndarray, y: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(distances, places) of up to k + 1 of the points (x, y) nearest to each of (of_x, of_y), nearest first."""
    most = min(k + 1, len(x))
    step = max(1, 4_000_000 // max(1, len(x)))
    distances, places = [], []
    for at in range(0, len(of_x), step):
        gaps = np.maximum(np.abs(of_x[at:at + step, None] - x[None, :]), np.abs(of_y[at:at + step, None] - y[None, :]))
        near = np.argpartition(gaps, most - 1, axis=1)[:, :most]
        d = np.take_along_axis(gaps, near, 1)
        order = np.argsort(d, axis=1, kind="stable")
        distances.append(np.take_along_axis(d, order, 1))
        places.append(np.take_along_axis(near, order, 1))
    return np.concatenate(distances), np.concatenate(places)


class Cells:
    """The points of a leaf in cells of some `size` points."""

    def __init__(self, x: np.ndarray, y: np.ndarray, size: int = 48):
        self.x, self.y = x, y
        self.tree = Boxes(np.column_stack((x, y)), -(-len(x) // size))
        rows, cell = self.tree.meets(x, y, np.zeros(len(x), np.int64))
        order = np.argsort(cell, kind="stable")
        self.members = np.split(rows[order], np.searchsorted(cell[order], np.arange(1, len(self.tree.bounds))))

    def nearest(self, of_x: np.ndarray, of_y: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, places) of the k + 1 points nearest to each of (of_x, of_y), nearest first, of those in cells within `reach`.

        Where there are fewer the distance is _FAR.
        """
        who, cell = self.tree.meets(of_x, of_y, reach)
        order = np.argsort(cell, kind="stable")
        asked = np.split(who[order], np.searchsorted(cell[order], np.arange(1, len(self.members))))
        found = []
        for mine, at in zip(self.members, asked):
            if len(mine) and len(at):
                d, near = _compare(self.x[mine], self.y[mine], of_x[at], of_y[at], k)
                found.append((np.repeat(at, d.shape[1]), d.ravel(), mine[near].ravel()))
        distances, places = np.full((len(of_x), k + 1), _FAR), np.zeros((len(of_x), k + 1), np.int64)
        if found:
            who, d, place = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((d, who))
            who, d, place = who[order], d[order], place[order]
            rank = np.arange(len(who)) - np.searchsorted(who, who)
            kept = rank <= k
            distances[who[kept], rank[kept]], places[who[kept], rank[kept]] = d[kept], place[kept]
        return distances, places

    def first_reach(self, w: np.ndarray, k: int) -> np.ndarray:
        """The distance at which each point reaches k others within its own cell."""
        r = np.full(len(self.x), _FAR)
        for mine in self.members:
            if len(mine):
                d, near = _compare(self.x[mine], self.y[mine], self.x[mine], self.y[mine], k)
                r[mine] = _kth(d, np.where(near == np.arange(len(mine))[:, None], 0, w[mine][near]), w[mine] - 1, k)
        return r

    def leave(self, r: np.ndarray) -> np.ndarray:
        """Whether a point's ball leaves its cell."""
        out = np.ones(len(r), bool)
        for mine, box in zip(self.members, self.tree.bounds):
            out[mine] = ~_holds(box, self.x[mine], self.y[mine], r[mine])
        return out


def _holds(box: np.ndarray, x: np.ndarray, y: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Whether the ball of each point lies in the box."""
    return (r < _FAR) & (x - r >= box[0]) & (y - r >= box[1]) & (x + r < box[2]) & (y + r < box[3])


def _kth(d: np.ndarray, w: np.ndarray, own: np.ndarray, k: int) -> np.ndarray:
    """The distance at which k others are reached; `own` points lie at the point itself besides it."""
    reached = own[:, None] + np.cumsum(w, axis=1) >= k
    first = np.argmax(reached, axis=1)
    found = np.where(reached.any(axis=1), np.take_along_axis(d, first[:, None], 1)[:, 0], _FAR)
    return np.where(own >= k, 0, found)


def kth_distances(points: DataFrame, k: int = 3, leaf_points: int = 4_000) -> DataFrame:
    """(pair, x, y, w, r): distance to the k-th nearest other point of the pair, of every distinct point; w points lie there."""
    spark = points.sparkSession
    points = stored(points)
    sizes = {r["pair"]: r["n"] for r in points.groupBy("pair").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per pair
    total = sum(sizes.values())
    wanted = {p: -(-n // leaf_points) for p, n in sizes.items()}
    # Sixteen sampled points a leaf: the sample is a 250th of the points, the tree a row for each 4,000.
    share = max(1, int(leaf_points / 16)) if total > 16 * leaf_points else 1
    sample = points.filter(F.pmod(F.xxhash64("pair", "x", "y"), F.lit(share)) == 0).select("pair", "x", "y").toPandas()
    trees = {p: Boxes(sample.loc[sample["pair"] == p, ["x", "y"]].to_numpy(np.int64), wanted[p]) for p in sizes}
    sent = spark.sparkContext.broadcast(trees)

    def place(batches):
        for b in batches:
            for pair, part in b.groupby("pair"):
                x, y = part["x"].to_numpy(), part["y"].to_numpy()
                rows, leaf = sent.value[pair].meets(x, y, np.zeros(len(x), np.int64))
                yield part.iloc[rows].assign(leaf=leaf)

    def within(part: pd.DataFrame) -> pd.DataFrame:
        x, y, w = (part[c].to_numpy(np.int64) for c in ("x", "y", "w"))
        box = sent.value[part["pair"].iloc[0]].bounds[part["leaf"].iloc[0]]
        cells = Cells(x, y)
        r = cells.first_reach(w, k)
        open_ = np.flatnonzero(cells.leave(r) | ~_holds(box, x, y, r))
        d, near = cells.nearest(x[open_], y[open_], np.minimum(r[open_], 1 << 61), k)
        weights = np.where((near == open_[:, None]) | (d == _FAR), 0, w[near])
        r[open_] = _kth(d, weights, w[open_] - 1, k)
        inside = _holds(box, x, y, r)
        lists = {"d": np.full(len(x), None), "dw": np.full(len(x), None)}  # told of points that ask other boxes alone
        for i in np.flatnonzero(~inside[open_]).tolist():
            lists["d"][open_[i]], lists["dw"][open_[i]] = d[i], weights[i]
        return part.assign(r=r, inside=inside, **lists)

    def ask(batches):
        for b in batches:
            for pair, part in b.groupby("pair"):
                x, y, r = (part[c].to_numpy(np.int64) for c in ("x", "y", "r"))
                rows, leaf = sent.value[pair].meets(x, y, np.minimum(r, 1 << 61))
                asked = part.iloc[rows].assign(home=part["leaf"].to_numpy()[rows], leaf=leaf, r=np.minimum(r, 1 << 61)[rows])
                yield asked.loc[asked["home"] != asked["leaf"], ["pair", "leaf", "x", "y", "w", "r"]]

    def answer(questions: pd.DataFrame, part: pd.DataFrame) -> pd.DataFrame:
        if not len(questions) or not len(part):
            return questions.iloc[:0][["pair", "x", "y", "w"]].assign(d=pd.Series([], dtype=object), dw=pd.Series([], dtype=object))
        px, py, w = (part[c].to_numpy(np.int64) for c in ("x", "y", "w"))
        d, near = Cells(px, py).nearest(*(questions[c].to_numpy(np.int64) for c in ("x", "y", "r")), k)
        weights, met = np.where(d == _FAR, 0, w[near]), d[:, 0] < _FAR
        return questions.loc[met, ["pair", "x", "y", "w"]].assign(d=list(d[met]), dw=list(weights[met]))

    placed = stored(points.select("pair", "x", "y", "w").mapInPandas(place, "pair int, x bigint, y bigint, w bigint, leaf int"))
    lists = "d array<bigint>, dw array<bigint>"
    tasks = tasks_for(spark, total)  # by bytes a few tasks would hold them all
    dealt = placed.repartition(tasks, "pair", "leaf")
    local = stored(dealt.groupBy("pair", "leaf").applyInPandas(within, f"pair int, x bigint, y bigint, w bigint, leaf int, r bigint, inside boolean, {lists}"))
    open_points = local.filter("NOT inside")
    questions = open_points.select("pair", "leaf", "x", "y", "w", "r").mapInPandas(ask, "pair int, leaf int, x bigint, y bigint, w bigint, r bigint")
    answers = questions.repartition(tasks, "pair", "leaf").groupBy("pair", "leaf").cogroup(dealt.groupBy("pair", "leaf")).applyInPandas(answer, f"pair int, x bigint, y bigint, w bigint, {lists}")
    columns = ["pair", "x", "y", "w", F.arrays_zip("d", "dw").alias("near")]
    # A ball meets few boxes, and each gives at most k + 1 distances.
    both = open_points.select(*columns).unionByName(answers.select(*columns)).groupBy("pair", "x", "y", "w").agg(F.array_sort(F.flatten(F.collect_list("near"))).alias("near"))
    start = F.struct((F.col("w") - 1).alias("n"), F.when(F.col("w") > k, F.lit(0)).cast("long").alias("r"))
    counted = F.aggregate("near", start, lambda s, v: F.struct((s["n"] + v["dw"]).alias("n"), F.when(s["r"].isNotNull(), s["r"]).when(s["n"] + v["dw"] >= k, v["d"]).alias("r")))
    return local.filter("inside").select("pair", "x", "y", "w", "r").unionByName(both.select("pair", "x", "y", "w", counted["r"].cast("long").alias("r")))


def knn_mutual_information(df: DataFrame, variables: Sequence[str], *, k: int = 3, min_rows: int = 50, leaf_points: int = 4_000) -> DataFrame:
    """(var_x, var_y, mi, n) in nats over complete rows, at least 0; no rows if there are fewer than `min_rows`.

    Each variable is divided by its standard deviation; constant ones have no row.  No noise is added: points at the same
    place are neighbours at distance 0, and a point whose k-th neighbour lies there counts the values equal to its own.
    """
    rows = stored(df.select(*[F.col(v).cast("double").alias(v) for v in variables]).dropna())
    scale = rows.agg(F.count(F.lit(1)).alias("n"), *[F.stddev_pop(v).alias(v) for v in variables]).first()
    names = [v for v in variables if scale[v]]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1:]]
    spark = df.sparkSession
    if scale["n"] < max(min_rows, k + 1) or not pairs:
        return spark.createDataFrame([], "var_x string, var_y string, mi double, n bigint")
    whole = rows.select(*[F.rint(F.col(v) / scale[v] * _UNIT).cast("long").alias(v) for v in names])
    cells = whole.select(F.explode(F.array(*[F.struct(F.lit(i).alias("pair"), F.col(a).alias("x"), F.col(b).alias("y")) for i, (a, b) in enumerate(pairs)])).alias("c")).select("c.*")
    known = stored(kth_distances(cells.groupBy("pair", "x", "y").agg(F.count(F.lit(1)).alias("w")), k, leaf_points))
    place = {v: i for i, v in enumerate(names)}
    values = whole.unpivot([], names, "name", "at").withColumn("axis", F.create_map(*[c for v, i in place.items() for c in (F.lit(v), F.lit(i))])[F.col("name")])
    counts = values.groupBy("axis", "at").agg(F.count(F.lit(1)).alias("weight"))
    axes = F.array(*[F.struct(F.lit(place[a]).alias("x"), F.lit(place[b]).alias("y")) for a, b in pairs])[F.col("pair")]
    reach = F.greatest(F.col("r") - 1, F.lit(0))

    def bound(side: str, sign: int) -> Column:
        end = F.col(side) + reach if sign > 0 else F.col(side) - reach - 1
        return F.struct(axes[side].alias("axis"), F.lit(side).alias("side"), end.alias("at"), F.lit(sign).alias("sign"))

    bounds = known.select("pair", "x", "y", "w", F.explode(F.array(*[bound(s, g) for s in "xy" for g in (1, -1)])).alias("b")).select("pair", "x", "y", "w", "b.*")
    # Values come before bounds at the same place, so that a bound counts what is at or below it.
    both = counts.select("axis", "at", "weight", F.lit(0).alias("sign"), F.lit(0).alias("pair"), F.lit(0).cast("long").alias("x"), F.lit(0).cast("long").alias("y"), F.lit(0).cast("long").alias("w"), F.lit("").alias("side")).unionByName(
        bounds.withColumn("weight", F.lit(0).cast("long")))
    order = [F.col("at").asc(), F.abs("sign").asc(), F.col("pair").asc(), F.col("x").asc(), F.col("y").asc(), F.col("side").asc(), F.col("sign").asc()]
    ran = finish(running(arrange(both, ["axis"], order), {"upto": ("sum", F.col("weight"))}))
    inside = ran.filter("sign <> 0").groupBy("pair", "x", "y", "w", "side").agg(F.sum(F.col("upto") * F.col("sign")).alias("count"))
    sums = inside.groupBy("pair").agg(F.sum(F.col("w") * digamma(F.col("count").cast("double"))).alias("s"))
    n = F.lit(float(scale["n"]))
    mi = F.greatest(digamma(n) + digamma(F.lit(float(k))) - F.col("s") / n, F.lit(0.0))
    names_of = F.array(*[F.struct(F.lit(a).alias("var_x"), F.lit(b).alias("var_y")) for a, b in pairs])[F.col("pair")]
    return sums.select(names_of["var_x"].alias("var_x"), names_of["var_y"].alias("var_y"), mi.alias("mi"), F.lit(scale["n"]).cast("long").alias("n"))
