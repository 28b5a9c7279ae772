"""Exact nearest neighbours as a partitioned join.

Rows are assigned to the nearest of a few pivots.  From the radius of each test
cell and the training distances nearest to each pivot follows an upper bound on
the distance of the k-th neighbour; by the triangle inequality a training row
only has to visit the test cells it can reach within that bound (Lu et al.,
"Efficient processing of k nearest neighbor joins using MapReduce", 2012).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelark.ml.tiles import compare, exact_distances, matrix, pair_distances, squares_with_error
from wavelark.operators.ordered import top_k
from wavelark.session import materialise

# Pivots grow with the square root of the training rows between these.
PIVOTS, MOST_PIVOTS = 64, 1024
#: Cells a training row may visit on average; beyond that the pivots don't separate and all rows share one cell.
VISITS = 16


def choose_pivots(train: DataFrame, n: int = PIVOTS, seed: int = 42) -> np.ndarray:
    """A few training rows picked by hash; at most ``n`` vectors reach the driver."""
    rows = train.orderBy(F.xxhash64("recording_id", F.lit(seed)), "recording_id").limit(n)
    return np.array([r["features"] for r in rows.select("features").collect()], dtype=float)


def with_pivot(df: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Add the nearest pivot and the distance to it."""

    @F.pandas_udf("pivot int, to_pivot double")
    def nearest(features: pd.Series) -> pd.DataFrame:
        d = exact_distances(matrix(features), pivots)
        best = d.argmin(axis=1)
        return pd.DataFrame({"pivot": best, "to_pivot": d[np.arange(len(d)), best]})

    return df.withColumn("_p", nearest("features")).select("*", "_p.*").drop("_p")


def neighbours(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` nearest training rows of every test row, ranked from 1.

    Both tables: recording_id, features; ``train`` also class_name.  Ties are
    broken by the training id.
    """
    # Read several times and dear to make: written once.
    train = materialise(train.select("recording_id", "class_name", "features"))
    pivots = choose_pivots(train, int(min(MOST_PIVOTS, max(PIVOTS, train.count() ** 0.5))))
    near_train = materialise(with_pivot(train, pivots))
    near_test = materialise(with_pivot(test.select("recording_id", "features"), pivots))

    # Bounds: at most k distances per pivot and one radius per test cell.
    closest = top_k(near_train, ["pivot"], ["to_pivot", "recording_id"], k, "recording_id")
    seen = [(r["pivot"], r["to_pivot"]) for r in closest.select("pivot", "to_pivot").collect()]
    radii = {r["pivot"]: r["r"] for r in near_test.groupBy("pivot").agg(F.max("to_pivot").alias("r")).collect()}
    between = exact_distances(pivots, pivots)
    at, off = np.array([j for j, _ in seen], dtype=int), np.array([d for _, d in seen])
    nearest = min(k, len(seen)) - 1
    reach = [
        radii[i] + np.partition(radii[i] + between[i, at] + off, nearest)[nearest] if i in radii and len(seen) else -1.0
        for i in range(len(pivots))
    ]
    # A little slack keeps rounding from excluding a neighbour on the border.
    limits = np.array([x * (1 + 1e-9) + 1e-9 if x >= 0 else -1.0 for x in reach])

    @F.pandas_udf("array<int>")
    def reached(features: pd.Series) -> pd.Series:
        within = exact_distances(matrix(features), pivots) <= limits
        return pd.Series([np.flatnonzero(row).astype(np.int32) for row in within])

    rows = near_train.select("recording_id", "class_name", "features")
    visits, n = near_train.agg(F.sum(F.size(reached("features"))), F.count(F.lit(1))).first()
    apart = (visits or 0) <= VISITS * n
    right = rows.withColumn("cell", F.explode(reached("features")) if apart else F.lit(0))
    left = near_test.select("recording_id", "features", (F.col("pivot") if apart else F.lit(0)).alias("cell"))

    def closest_in_tile(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        names = ["recording_id", "neighbour", "class_name", "distance"]
        if len(a) == 0 or len(b) == 0:
            return pd.DataFrame(columns=names)
        b = b.sort_values("recording_id", ignore_index=True)
        x, y = matrix(a["features"]), matrix(b["features"])
        square, error = squares_with_error(x, y)
        last = min(k, len(b)) - 1
        limit = np.partition(square, last, axis=1)[:, last] + 2 * error
        # All that could be among the k; their distances by differences decide, ties by id.
        rows, columns = np.nonzero(square <= limit[:, None])
        d = pair_distances(x, y, rows, columns)
        order = np.lexsort((columns, d, rows))
        rows, columns, d = rows[order], columns[order], d[order]
        kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        rows, columns, d = rows[kept], columns[kept], d[kept]
        ids, other = a["recording_id"].to_numpy(), b["recording_id"].to_numpy()
        return pd.DataFrame(dict(zip(names, (ids[rows], other[columns], b["class_name"].to_numpy()[columns], d))))

    def closest(found: pd.DataFrame) -> pd.DataFrame:
        return found.sort_values(["recording_id", "distance", "neighbour"]).groupby("recording_id", sort=False).head(k)

    found = compare(
        left, right, closest_in_tile, "recording_id string, neighbour string, class_name string, distance double", merge=closest
    )
    order = Window.partitionBy("recording_id").orderBy("distance", "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def knn_votes(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """Share of neighbours per class: (recording_id, class_name, p)."""
    return neighbours(train, test, k).groupBy("recording_id", "class_name").agg(
        (F.count(F.lit(1)) / k).alias("p")
    )


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """Majority class of the nearest rows; ties go to the smaller name."""
    from wavelark.ml.vote import best_class

    return best_class(knn_votes(train, test, k))
