"""Silhouettes under Euclidean distance.

The mean distance from a row to a cluster has no closed form, but its count,
mean and mean square bound it: by Jensen's inequality it is at least the
distance to the cluster's mean, and at most the root of the mean squared
distance.  A cluster whose lower bound exceeds another's upper bound can't be
the nearest one, so only the rest, and the row's own cluster, are summed, tile
by tile, never as pairs.

Rows meet clusters in tiles too, so neither needs to fit the driver.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.ml.tiles import compare, distances, matrix
from wavelark.session import materialise


def _moments(rows: DataFrame) -> DataFrame:
    """(cluster, n, mean, spread): spread is the mean squared distance from the mean."""
    summary = Summarizer.metrics("mean", "count", "variance").summary(array_to_vector("features"))
    spread = F.aggregate(vector_to_array("s.variance"), F.lit(0.0), lambda a, x: a + x)
    return rows.groupBy("cluster").agg(summary.alias("s")).select(
        "cluster", F.col("s.count").alias("n"), vector_to_array("s.mean").alias("mean"),
        # The summary divides by n - 1.
        (spread * (F.col("s.count") - 1) / F.col("s.count")).alias("spread"),
    )


def nearest_candidates(rows: DataFrame, moments: DataFrame) -> DataFrame:
    """(_id, cluster): clusters that may be a row's nearest other one.

    ``rows``: _id, cluster, features.
    """

    def bounds(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"_id": [], "upper": [], "found": []})
        apart = distances(matrix(left["features"]), matrix(right["mean"]))
        other = left["cluster"].to_numpy()[:, None] != right["cluster"].to_numpy()[None, :]
        upper = np.where(other, np.sqrt(apart**2 + right["spread"].to_numpy()[None, :]), np.inf).min(axis=1)
        near = other & (apart <= upper[:, None] * (1 + 1e-9) + 1e-9)
        names = right["cluster"].to_numpy()
        found = [[{"cluster": int(names[j]), "lower": float(apart[i, j])} for j in np.flatnonzero(near[i])] for i in range(len(near))]
        return pd.DataFrame({"_id": left["_id"].to_numpy(), "upper": upper, "found": found})

    met = compare(
        rows.withColumn("cell", F.lit(0)), moments.withColumn("cell", F.lit(0)).withColumn("_id", F.col("cluster").cast("long")),
        bounds, "_id long, upper double, found array<struct<cluster:int,lower:double>>", key="_id",
    )
    best = met.groupBy("_id").agg(F.min("upper").alias("upper"), F.flatten(F.collect_list("found")).alias("found"))
    one = best.select("_id", "upper", F.explode("found").alias("c"))
    return one.filter(F.col("c.lower") <= F.col("upper") * (1 + 1e-9) + 1e-9).select("_id", F.col("c.cluster").alias("cluster"))


def _sums(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if left.empty or right.empty:
        return pd.DataFrame({"_id": [], "cluster": [], "total": []})
    a, b = matrix(left["features"]), matrix(right["features"])
    middle = b.mean(axis=0)
    total = np.zeros(len(a))
    for at in range(0, len(b), 512):
        total += distances(a - middle, b[at : at + 512] - middle).sum(axis=1)
    return pd.DataFrame({"_id": left["_id"], "cluster": left["cell"].astype("int32"), "total": total})


def silhouette_euclidean(df: DataFrame) -> DataFrame:
    """``df`` (features, cluster int) with ``silhouette``.

    A row alone in its cluster gets 0, and so does every row of a single
    cluster.  The noise label counts as a cluster.
    """
    placed = materialise(df.withColumn("_id", F.monotonically_increasing_id()))
    rows = placed.select("_id", F.col("cluster").cast("int").alias("cluster"), "features")
    moments = materialise(_moments(rows))
    wanted = nearest_candidates(rows, moments).unionByName(rows.select("_id", "cluster"))
    asked = rows.select("_id", "features").join(wanted.withColumnRenamed("cluster", "cell"), "_id")
    members = rows.select("_id", F.col("cluster").alias("cell"), "features")
    sums = compare(asked, members, _sums, "_id long, cluster int, total double", key="_id")
    total = sums.groupBy("_id", "cluster").agg(F.sum("total").alias("total"))
    sized = total.join(moments.select("cluster", "n"), "cluster")
    own = rows.select("_id", F.col("cluster").alias("_own"))
    inside = F.max(F.when(F.col("cluster") == F.col("_own"), F.col("total") / F.greatest(F.col("n") - 1, F.lit(1))))
    outside = F.min(F.when(F.col("cluster") != F.col("_own"), F.col("total") / F.col("n")))
    alone = F.max(F.when(F.col("cluster") == F.col("_own"), F.col("n"))) == 1
    means = sized.join(own, "_id").groupBy("_id").agg(inside.alias("_a"), outside.alias("_b"), alone.alias("_alone"))
    top = F.greatest("_a", "_b")
    value = F.when(~F.col("_alone") & (top > 0), (F.col("_b") - F.col("_a")) / top)
    scored = placed.join(means, "_id").withColumn("silhouette", F.coalesce(value, F.lit(0.0)))
    return scored.drop("_id", "_a", "_b", "_alone")
