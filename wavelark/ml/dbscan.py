"""Density clustering without materialising pairs.

Points meet only inside cells of a grid laid over the two features with the
largest spread; a feature difference never exceeds the distance, so all
neighbours of a point are in its cell or the eight around it.  Tiles return
counts, spanning edges and labels, one row per point, however dense a cell is.
Identical points are one row with a weight from the start.

Points meet the table share by share, the first share ``PROBE`` points and each
further one ``GROWTH`` times as many.  A point that has found enough neighbours
is a core whatever follows, and cores already linked to the first large cluster
need no more edges: any edge that joins another cluster has an end outside of
it.  So dense data are compared with few shares, and only rare points with all.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.ml.tiles import compare, matrix, pair_distances, squares_with_error
from wavelark.operators.ordered import running
from wavelark.session import materialise


#: Points of the first share; growth of the shares; open points that may meet all that is left at once, in ``PROBE``.
PROBE, GROWTH, FEW = 4096, 16, 1


def widest(df: DataFrame, n: int = 2) -> list[int]:
    """Positions of the features with the largest variance."""
    summary = Summarizer.variance(array_to_vector("features"))
    spread = df.agg(vector_to_array(summary).alias("v")).first()["v"]
    return [int(i) for i in np.argsort(spread)[::-1][:n]]


def _cell(coordinates: list[Column]) -> Column:
    return F.concat_ws(",", *[c.cast("string") for c in coordinates])


def _home(points: DataFrame, axes: list[int], eps: float) -> DataFrame:
    grid = [F.floor(F.col("features")[i] / eps) for i in axes]
    return points.withColumn("cell", _cell(grid))


def _visiting(points: DataFrame, axes: list[int], eps: float) -> DataFrame:
    """Every point in its own and all adjacent cells."""
    shifts = [[]]
    for _ in axes:
        shifts = [s + [d] for s in shifts for d in (-1, 0, 1)]
    cells = [
        _cell([F.floor(F.col("features")[i] / eps) + d for i, d in zip(axes, shift)]) for shift in shifts
    ]
    return points.withColumn("cell", F.explode(F.array(*cells)))


def _close(a: pd.DataFrame, b: pd.DataFrame, eps: float) -> np.ndarray:
    """Whether rows are within ``eps``; pairs the fast formula can't decide are measured by differences."""
    x, y = matrix(a["features"]), matrix(b["features"])
    square, error = squares_with_error(x, y)
    error = error[:, None] + 4 * np.finfo(float).eps * eps**2
    near = square < eps**2 - error
    rows, columns = np.nonzero(~near & (square <= eps**2 + error))
    near[rows, columns] = pair_distances(x, y, rows, columns) <= eps
    return near


def _components(close: np.ndarray) -> np.ndarray:
    """Component number of every left and right row of a bipartite graph."""
    n, m = close.shape
    label = np.full(n + m, -1)
    current = 0
    for start in range(n):
        if label[start] >= 0 or not close[start].any():
            continue
        rows, columns = np.zeros(n, bool), np.zeros(m, bool)
        rows[start] = True
        fresh = rows.copy()
        while fresh.any():
            met = close[fresh].any(axis=0) & ~columns
            columns |= met
            fresh = close[:, met].any(axis=1) & ~rows
            rows |= fresh
        label[:n][rows] = current
        label[n:][columns] = current
        current += 1
    return label


def _spanning(edges: pd.DataFrame) -> pd.DataFrame:
    """One edge from each name to the least of its component, in place of many."""
    if len(edges) == 0:
        return edges
    names, place = np.unique(np.concatenate([edges["a"], edges["b"]]).astype(str), return_inverse=True)
    a, b = place.reshape(2, -1)
    least = np.arange(len(names))
    while True:
        before = least.copy()
        low = np.minimum(least[a], least[b])
        for end in (a, b):
            np.minimum.at(least, least[end], low)
            np.minimum.at(least, end, low)
        least = least[least]
        if (least == before).all():
            break
    moved = least != np.arange(len(names))
    return pd.DataFrame({"a": names[moved].astype(object), "b": names[least[moved]].astype(object)})


def connected_components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Smallest node id of every node's component (columns id, root).

    Alternating star contraction (Kiveris et al., "Connected components in
    MapReduce and beyond", 2014) written with minima and joins: rounds grow with
    the logarithm of the longest chain.  Each round is written to the shared
    folder, so plans stay short and a lost executor costs one round.
    """
    def contract(pairs: DataFrame, small: bool) -> DataFrame:
        both = pairs.select("a", "b")
        if not small:
            both = both.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:
            both = both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        linked = both.join(least, "a")
        if small:  # smaller neighbours and the node itself point to the smallest
            moved = linked.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
        else:  # larger neighbours point to the smallest
            moved = linked.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.filter(F.col("a") != F.col("b")).distinct()

    current = materialise(edges.filter(F.col("a") != F.col("b")).distinct())
    signature = None
    while True:
        current = materialise(contract(contract(current, False), True))
        row = current.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")
        ).first()
        if (row["n"], row["h"]) == signature:
            break
        signature = (row["n"], row["h"])
    return nodes.select("id").join(current.select(F.col("a").alias("id"), F.col("b").alias("root")), "id", "left").select(
        "id", F.coalesce("root", "id").alias("root")
    )


def _shares(n: int) -> tuple[Column, int]:
    """The share of each of ``n`` points, by a hash of its id, and how many shares there are."""
    size, ends = PROBE / max(n, 1), []
    while size < 0.25:
        ends.append(size)
        size *= GROWTH
    place = F.pmod(F.xxhash64(F.lit("share"), "recording_id"), F.lit(1 << 30)) / (1 << 30)
    share = sum([(place >= end).cast("int") for end in ends], F.lit(0))
    return share, len(ends) + 1


def dbscan(df: DataFrame, eps: float = 0.5, min_samples: int = 5) -> DataFrame:
    """Cluster per row, -1 for noise.

    A point is a core when at least ``min_samples`` rows, itself included, lie
    within ``eps``.  Clusters are numbered by their smallest core id; a border
    point joins the lowest-numbered cluster in reach.
    """
    points = materialise(
        df.groupBy("features").agg(
            F.min("recording_id").alias("recording_id"), F.count(F.lit(1)).alias("weight")
        )
    )
    axes = widest(points)
    share, shares = _shares(points.count())

    def weigh(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"recording_id": [], "n": []})
        near = _close(a, b, eps) @ b["weight"].to_numpy(dtype=np.int64)
        return pd.DataFrame({"recording_id": a["recording_id"], "n": near})

    at, known = 0, []
    open_ = points.select("recording_id", F.lit(0).cast("long").alias("n")).distinct()
    while True:
        asked = points.join(open_.select("recording_id"), "recording_id")
        end = at + 1 if at == 0 or open_.count() > FEW * PROBE else shares
        counts = compare(
            _home(asked, axes, eps), _visiting(points.filter(share.between(at, end - 1)), axes, eps), weigh,
            "recording_id string, n long", merge=lambda found: found.groupby("recording_id", as_index=False)["n"].sum(),
        ).groupBy("recording_id").agg(F.sum("n").alias("more"))
        counted = open_.join(counts, "recording_id", "left")
        counted = materialise(counted.select("recording_id", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n")))
        known.append(counted if end == shares else counted.filter(F.col("n") >= min_samples))
        open_, at = counted.filter(F.col("n") < min_samples), end
        if at == shares or open_.isEmpty():
            break
    counts = reduce(DataFrame.unionByName, known)
    flagged = materialise(points.join(counts, "recording_id").withColumn("core", F.col("n") >= min_samples))
    cores = flagged.filter("core").select("recording_id", "features")

    def span(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"a": [], "b": []})
        label = _components(_close(a, b, eps))
        names = np.concatenate([a["recording_id"].to_numpy(), b["recording_id"].to_numpy()])
        part = pd.DataFrame({"a": names, "c": label})
        part = part[part["c"] >= 0].drop_duplicates()
        part["b"] = part.groupby("c")["a"].transform("min")
        return part.loc[part["a"] != part["b"], ["a", "b"]]

    names, at, left, asked = cores.select(F.col("recording_id").alias("id")), 0, None, cores
    edges, largest = None, None
    while True:
        end = shares if left is not None and left <= FEW * PROBE else at + 1
        met = _visiting(cores.filter(share.between(at, end - 1)), axes, eps)
        found = compare(_home(asked, axes, eps), met, span, "a string, b string", merge=_spanning)
        roots = materialise(connected_components(found if edges is None else edges.unionByName(found), names))
        at = end
        if largest is None:
            first = roots.groupBy("root").count().orderBy(F.desc("count"), "root").first()
            largest = first and first["root"]
        own = roots.filter(F.col("id") == largest).first()
        outside = roots.filter(F.col("root") != (own and own["root"]))
        left = outside.select("id").distinct().count()
        if at == shares or left == 0:
            break
        edges = roots.select(F.col("id").alias("a"), F.col("root").alias("b"))
        asked = cores.join(outside.select(F.col("id").alias("recording_id")).distinct(), "recording_id")
    firsts = roots.select("root").distinct()
    # Range partitions of the roots are buckets whatever the ids look like; written, as their borders are sampled.
    ranged = materialise(firsts.repartitionByRange("root").withColumn("_part", F.spark_partition_id()))
    numbered = running(ranged, [], F.col("_part"), ["root"], {"cluster": F.lit(1).cast("long")}).drop("_part")
    labelled = roots.join(numbered, "root").select(F.col("id").alias("recording_id"), "cluster")
    labelled = materialise(labelled)
    core_points = cores.join(labelled, "recording_id")
    others = flagged.filter(~F.col("core")).select("recording_id", "features")

    def attach(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame({"recording_id": [], "cluster": []})
        near = np.where(_close(a, b, eps), b["cluster"].to_numpy()[None, :], np.iinfo(np.int64).max).min(axis=1)
        found = near < np.iinfo(np.int64).max
        return pd.DataFrame({"recording_id": a["recording_id"][found], "cluster": near[found]})

    borders = compare(
        _home(others, axes, eps), _visiting(core_points, axes, eps), attach, "recording_id string, cluster long",
        merge=lambda found: found.groupby("recording_id", as_index=False)["cluster"].min(),
    ).groupBy("recording_id").agg(F.min("cluster").alias("cluster"))
    assigned = labelled.unionByName(borders).join(flagged.select("recording_id", "features", "core"), "recording_id", "right")
    by_value = assigned.select(
        "features", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"), "core"
    )
    return df.join(by_value, "features")
