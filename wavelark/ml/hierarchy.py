"""Exact Ward clustering by rounds of reciprocal nearest neighbours.

Ward's cost of a merged cluster to any other is never below the costs of its
parts, so two clusters that are each other's nearest stay so whatever else is
merged.  All such pairs are therefore merged at once, round by round; sorted by
height the merges are those of the one-by-one rule.  Equal costs are ordered by
a hash of the pair, which leaves many pairs to merge in a round even where all
distances are equal.

The first round compares all clusters tile by tile (one row per cluster and tile,
never pairs; each two clusters meet once), which is quadratic in their number.  As
no merged cluster comes nearer than its parts were, only merged clusters and those
whose nearest was merged meet all others in later rounds.  ``clusters.micro_cluster_ward`` is the
form for tables too large for that.  Identical rows are one weighted row.  The
last ``finish`` clusters are merged on the driver in the same way.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.ml.dbscan import connected_components
from wavelark.ml.tiles import GROUPS, LARGEST, SIDE, matrix
from wavelark.session import materialise

#: Rows of a tile whose candidates are ranked together.
STRIP = 256
#: Odd multiplier that spreads the hash of a pair.
SPREAD = np.uint64(0x9E3779B97F4A7C15)
MERGE = "step int, left string, right string, size long, cost double, height double"


class _Best:
    """The cheapest partner of each row so far."""

    def __init__(self, n: int):
        self.cost, self.tie, self.at = np.full(n, np.inf), np.zeros(n, dtype=np.int64), np.full(n, -1)

    def update(self, row: np.ndarray, partner: np.ndarray, cost: np.ndarray, tie: np.ndarray) -> None:
        order = np.lexsort((tie, cost, row))
        order = order[np.unique(row[order], return_index=True)[1]]
        row, partner, cost, tie = row[order], partner[order], cost[order], tie[order]
        won = (cost < self.cost[row]) | ((cost == self.cost[row]) & (tie < self.tie[row])) | (self.at[row] < 0)
        row = row[won]
        self.cost[row], self.tie[row], self.at[row] = cost[won], tie[won], partner[won]


def nearest(a: pd.DataFrame, b: pd.DataFrame | None = None, side: int = SIDE) -> pd.DataFrame:
    """(id, other, cost, tie): for every row of both tables the cheapest row of the other one to merge with.

    Both hold id, h, n, centre; without ``b`` the rows of ``a`` meet each other.
    Each pair is met once, for both of its rows.  Costs found by the fast formula
    in single precision choose candidates (in double precision once single leaves
    too many); these are ranked by differences, which give both partners the same
    number.
    """
    alone = b is None
    b = a if alone else b
    if len(a) == 0 or len(b) == 0:
        return pd.DataFrame({"id": [], "other": [], "cost": [], "tie": []})
    mine = matrix(a["centre"])
    other = mine if alone else matrix(b["centre"])
    hash_a, hash_b = a["h"].to_numpy().view(np.uint64), b["h"].to_numpy().view(np.uint64)
    n, m = a["n"].to_numpy(dtype=float), b["n"].to_numpy(dtype=float)
    middle = other.mean(axis=0)
    x, y = mine - middle, other - middle
    square_x, square_y = (x**2).sum(axis=1), (y**2).sum(axis=1)
    x = np.column_stack([-2 * x, square_x, np.ones(len(x))])
    y = np.column_stack([y, np.ones(len(y)), square_y]).T.copy()
    largest = max(square_x.max(), square_y.max())
    kind = np.float32 if 1e-20 < largest < 1e20 and max(n.max(), m.max()) < 1e15 else np.float64
    best_a = _Best(len(a))
    best_b = best_a if alone else _Best(len(b))

    def candidates(rows: slice, columns: slice, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """Pairs among which are all that may be the cheapest yet of a row or a column."""
        size, other_size = n[rows], m[columns]
        shape = len(size), len(other_size)
        paid, inverse = (room[: shape[0] * shape[1]].reshape(shape) for room in rooms[kind])
        cost = np.matmul(factor[kind][0][rows], factor[kind][1][:, columns], out=paid)
        if size.min() == size.max() and other_size.min() == other_size.max():
            cost *= kind(size[0] * other_size[0] / (size[0] + other_size[0]))
        else:
            cost /= np.add.outer((1 / size).astype(kind), (1 / other_size).astype(kind), out=inverse)
        if alone and rows.stop > columns.start:  # a pair is met once
            cost[np.arange(rows.start, rows.stop)[:, None] >= np.arange(columns.start, columns.stop)] = np.inf
        # One product gives all squared distances, each off by at most so much; a weight is at most the row's own size.
        eps = np.finfo(kind).eps
        off = 8 * eps * (x.shape[1] + 4)
        found = []
        for axis, best, squares, most, sizes in (
            (1, best_a.cost[rows], square_x[rows], square_y[columns].max(), size),
            (0, best_b.cost[columns], square_y[columns], square_x[rows].max(), other_size),
        ):
            least = cost.min(axis=axis).astype(float)
            error = off * (squares + most) * sizes
            limit = np.minimum(best, least + error)
            limit += error + 32 * eps * np.abs(np.where(np.isfinite(limit), limit, 0))
            line = np.flatnonzero((least <= limit) & np.isfinite(least))
            limit = limit[line].astype(kind)
            if axis:
                r, c = np.nonzero(cost[line] <= limit[:, None])
                found.append((line[r], c))
            else:
                r, c = np.nonzero(cost[:, line] <= limit)
                found.append((r, line[c]))
        return tuple(np.concatenate(part) for part in zip(*found, strict=True))

    factor = {k: (x.astype(k), y.astype(k)) for k in {kind, np.float64}}
    rooms = {k: np.empty((2, min(STRIP, len(a)) * min(side, len(b))), dtype=k) for k in factor}
    for start in range(0, len(b), side):
        columns = slice(start, min(start + side, len(b)))
        for at in range(0, len(a), STRIP):
            rows = slice(at, min(at + STRIP, len(a)))
            if alone and columns.stop <= at + 1:
                continue
            row, column = candidates(rows, columns, kind)
            if kind is np.float32 and len(row) > 1000 + 4 * (STRIP + side):
                kind = np.float64
                row, column = candidates(rows, columns, kind)
            row, column = row + at, column + start
            gap = np.concatenate([
                ((mine[row[i : i + 65536]] - other[column[i : i + 65536]]) ** 2).sum(axis=1)
                for i in range(0, len(row), 65536)
            ]) if len(row) else np.zeros(0)
            cost = gap * (n[row] * m[column] / (n[row] + m[column]))
            tie = (((hash_a[row] ^ hash_b[column]) * SPREAD) >> np.uint64(1)).astype(np.int64)
            best_a.update(row, column, cost, tie)
            best_b.update(column, row, cost, tie)
    found = []
    for best, own, their in [(best_a, a, b), (best_b, b, a)][: 1 if alone else 2]:
        met = np.flatnonzero(best.at >= 0)
        found.append(pd.DataFrame({
            "id": own["id"].to_numpy()[met], "other": their["id"].to_numpy()[best.at[met]], "cost": best.cost[met], "tie": best.tie[met],
        }))
    return pd.concat(found, ignore_index=True)


def _nearest(state: DataFrame, count: int, side: int) -> DataFrame:
    """``nearest`` over all clusters: every two parts of the table meet in one tile, a part with itself in another."""
    parts = max(1, min(-(-count // side), int((2 * GROUPS) ** 0.5)), -(-count // LARGEST))
    rows = state.select("id", F.xxhash64("id").alias("h"), "n", "centre")
    part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(parts)).cast("int")
    a = rows.withColumn("_l", part).withColumn("_r", F.explode(F.sequence("_l", F.lit(parts - 1))))
    b = rows.withColumn("_r", part).withColumn("_l", F.explode(F.when(F.col("_r") > 0, F.sequence(F.lit(0), F.col("_r") - 1))))
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # own identity, as both sides share a table

    def meet(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return nearest(a, None if key[0] == key[1] else b, side)

    tiles = a.groupBy("_l", "_r").cogroup(b.groupBy("_l", "_r"))
    return tiles.applyInPandas(meet, "id string, other string, cost double, tie long")


def _cross(fresh: DataFrame, rest: DataFrame, n: int, m: int, side: int) -> DataFrame:
    """``nearest`` between the clusters of two tables."""
    extent = max(side, min(LARGEST, int((n * m / GROUPS) ** 0.5)))
    parts = {"_l": -(-n // extent), "_r": -(-m // extent)}

    def dealt(rows: DataFrame, own: str, other: str) -> DataFrame:
        part = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(parts[own])).cast("int")
        copies = F.explode(F.sequence(F.lit(0), F.lit(parts[other] - 1)))
        rows = rows.select("id", F.xxhash64("id").alias("h"), "n", "centre", part.alias(own), copies.alias(other))
        return rows.select(*[F.col(c).alias(c) for c in rows.columns])  # own identity, as both sides share a table

    tiles = dealt(fresh, "_l", "_r").groupBy("_l", "_r").cogroup(dealt(rest, "_r", "_l").groupBy("_l", "_r"))
    return tiles.applyInPandas(lambda a, b: nearest(a, b, side), "id string, other string, cost double, tie long")


def _near(state: DataFrame, known: DataFrame | None, n: int, m: int, side: int) -> DataFrame:
    """The nearest cluster ``p`` of each: the ``n`` fresh ones meet all, the ``m`` others keep theirs unless a fresh one is nearer."""
    found = _nearest(state.filter("fresh"), n, side)
    if m:
        found = found.unionByName(_cross(state.filter("fresh"), state.filter("not fresh"), n, m, side))
    best = found.select("id", F.struct("cost", "tie", F.least("id", "other"), F.greatest("id", "other")).alias("p"))
    if m:
        best = best.unionByName(known.join(state.filter("not fresh").select("id"), "id", "left_semi"))
    return best.groupBy("id").agg(F.min("p").alias("p"))


def _round(state: DataFrame, best: DataFrame) -> DataFrame:
    """The clusters after merging all reciprocal pairs; ``right`` and ``cost`` tell what was merged.

    ``fresh`` are the merged clusters and those whose nearest was merged.
    """
    pairs = best.groupBy(F.col("p.col3").alias("left"), F.col("p.col4").alias("other")).agg(
        F.count(F.lit(1)).alias("sides"), F.min("p.cost").alias("cost")
    ).filter("sides = 2")
    target = pairs.select(F.explode(F.array("left", "other")).alias("id"), "left", F.col("cost").alias("paid"))
    rows = state.select("id", "n", "centre", "height").join(target, "id", "left")
    what = F.struct("n", "centre")
    merged = rows.groupBy(F.coalesce("left", "id").alias("id")).agg(
        F.min_by(what, "id").alias("a"), F.max_by(what, "id").alias("b"), F.max("id").alias("last"),
        F.max("height").alias("height"), F.max("paid").alias("cost"),
    )
    n = F.col("a.n") + F.col("b.n")
    both = F.zip_with("a.centre", "b.centre", lambda x, y: (F.col("a.n") * x + F.col("b.n") * y) / n)
    pair = F.col("cost").isNotNull()
    partner = F.when(F.col("p.col3") == F.col("id"), F.col("p.col4")).otherwise(F.col("p.col3"))
    lost = best.select("id", partner.alias("gone")).join(target.select(F.col("id").alias("gone")), "gone", "left_semi")
    merged = merged.join(lost.select("id", F.lit(True).alias("lost")), "id", "left")
    return merged.select(
        "id", F.when(pair, n).otherwise(F.col("a.n")).alias("n"), F.when(pair, both).otherwise(F.col("a.centre")).alias("centre"),
        F.when(pair, F.greatest("height", "cost")).otherwise(F.col("height")).alias("height"),
        F.when(pair, F.col("last")).alias("right"), "cost", (pair | F.col("lost").isNotNull()).alias("fresh"),
    )


def _finished(rows: pd.DataFrame, step: int) -> list[tuple]:
    """The remaining merges of at most ``finish`` clusters, in the same rounds."""
    merges = []
    while len(rows) > 1:
        best = nearest(rows).set_index("id")
        at = rows.set_index("id")
        pairs = [(i, o, c) for i, o, c in zip(best.index, best["other"], best["cost"], strict=True) if i < o and best.at[o, "other"] == i]
        if not pairs:
            raise RuntimeError("no two clusters are nearest to each other: two ids share their hash")
        for i, o, cost in pairs:
            n, m = int(at.at[i, "n"]), int(at.at[o, "n"])
            height = max(cost, at.at[i, "height"], at.at[o, "height"])
            at.at[i, "centre"] = (n * np.asarray(at.at[i, "centre"]) + m * np.asarray(at.at[o, "centre"])) / (n + m)
            at.at[i, "n"], at.at[i, "height"] = n + m, height
            merges.append((step, i, o, n + m, float(cost), float(height)))
        rows = at.drop(index=[o for _, o, _ in pairs]).reset_index()
        step += 1
    return merges


def _distinct(df: DataFrame) -> DataFrame:
    return df.groupBy("features").agg(F.min("recording_id").alias("id"), F.count(F.lit(1)).alias("n"))


def _merges(points: DataFrame, finish: int, side: int) -> DataFrame:
    spark = points.sparkSession
    state = materialise(points.select("id", "n", F.col("features").alias("centre"), F.lit(0.0).alias("height"), F.lit(True).alias("fresh")))
    left, step, done, near = state.count(), 1, [], None
    fresh = left
    while left > max(finish, 1):
        near = materialise(_near(state, near, fresh, left - fresh, side))
        state = materialise(_round(state, near))
        done.append(state.filter("right is not null").select(
            F.lit(step).alias("step"), F.col("id").alias("left"), "right", F.col("n").alias("size"), "cost", "height"
        ))
        before, step = left, step + 1
        left, fresh = state.agg(F.count(F.lit(1)), F.count_if("fresh")).first()
        if left == before:
            raise RuntimeError("no two clusters are nearest to each other: two ids share their hash")
    rest = state.select("id", F.xxhash64("id").alias("h"), "n", "centre", "height").toPandas()
    done.append(spark.createDataFrame(_finished(rest, step), MERGE))
    return reduce(DataFrame.unionByName, done)


def ward_merges(df: DataFrame, finish: int = 2048, side: int = SIDE) -> DataFrame:
    """The merge table of ``df`` (recording_id, features): step, left, right, size, cost, height.

    A cluster is named by its smallest id, so every id but the smallest of all is
    ``right`` once.  ``cost`` is the growth of the sum of squares, ``height`` the
    greatest cost on the way.  Order by (height, step) to replay the one-by-one
    rule.  Copies of a row come first, at step 0 and cost 0, with the size
    of their group.  Ids must be unique; a table of one row or none merges nothing.
    """
    points = materialise(_distinct(df))
    copies = df.join(points, "features").filter("recording_id <> id").select(
        F.lit(0).alias("step"), F.col("id").alias("left"), F.col("recording_id").alias("right"),
        F.col("n").alias("size"), F.lit(0.0).alias("cost"), F.lit(0.0).alias("height"),
    )
    return copies.unionByName(_merges(points, finish, side))


def ward_clusters(df: DataFrame, k: int, finish: int = 2048, side: int = SIDE) -> DataFrame:
    """Add ``cluster`` (0 to k - 1, numbered by smallest id): Ward's partition into ``k`` clusters.

    Identical rows are never parted, so fewer distinct rows than ``k`` give as many clusters as they are.
    """
    points = materialise(_distinct(df))
    merges = materialise(_merges(points, finish, side))
    last = merges.orderBy(F.desc("height"), F.desc("step"), F.desc("left")).limit(k - 1).select("right")
    kept = merges.join(last, "right", "left_anti").select(F.col("right").alias("a"), F.col("left").alias("b"))
    roots = materialise(connected_components(kept, points.select("id")))
    names = sorted(r["root"] for r in roots.select("root").distinct().collect())  # k at most
    number = F.array_position(F.array(*map(F.lit, names)), F.col("root")) - 1 if names else F.lit(None)
    numbered = roots.select("id", number.cast("int").alias("cluster"))
    return df.join(points.join(numbered, "id").select("features", "cluster"), "features")
