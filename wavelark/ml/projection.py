"""PCA, discriminant projection and feature importance."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wavelark.ml.tiles import matrix


def pca(df: DataFrame, k: int) -> tuple[DataFrame, list[float], list[list[float]]]:
    """Projected rows, explained variance and components."""
    data = df.withColumn("_vector", array_to_vector("features"))
    model = PCA(k=k, inputCol="_vector", outputCol="_projected").fit(data)
    rows = model.transform(data).withColumn("projected", vector_to_array("_projected")).drop("_vector", "_projected")
    return rows, [float(v) for v in model.explainedVariance], np.array(model.pc.toArray()).T.tolist()


def lda(df: DataFrame, k: int) -> tuple[DataFrame, list[list[float]]]:
    """Project onto the directions that separate classes best.

    Counts and means per class and one product matrix of all rows are added up
    on the executors, the matrix row by row; the driver solves one eigenproblem
    of the size of the feature vector.
    """

    def partial(batches):
        products = None
        for batch in batches:
            x = matrix(batch["features"])
            products = x.T @ x if products is None else products + x.T @ x
            for name, part in batch.groupby("class_name"):
                own = matrix(part["features"])
                yield pd.DataFrame({"class_name": [name], "i": [-1], "n": [len(own)], "v": [own.sum(axis=0)]})
        if products is not None:
            i = np.arange(len(products))
            yield pd.DataFrame({"class_name": None, "i": i, "n": 0, "v": list(products)})

    known = df.filter(F.col("class_name").isNotNull()).select("class_name", "features")
    sums = known.mapInPandas(partial, "class_name string, i int, n long, v array<double>")
    long = sums.select("class_name", "i", "n", F.posexplode("v").alias("pos", "v"))
    added = long.groupBy("class_name", "i", "pos").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    table = added.groupBy("class_name", "i").agg(
        F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("v"), F.max("n").alias("n")
    ).collect()  # a mean per class and a row per feature
    classes = sorted((r for r in table if r.i < 0), key=lambda r: r.class_name)
    n = np.array([r.n for r in classes], dtype=float)
    values = np.array([[e["v"] for e in r.v] for r in classes])
    products = np.array([[e["v"] for e in r.v] for r in sorted((r for r in table if r.i >= 0), key=lambda r: r.i)])
    dim = len(products)
    means = values / n[:, None]
    within = products - (means * n[:, None]).T @ means
    within = (within + within.T) / 2
    middle = values.sum(axis=0) / n.sum()
    apart = means - middle
    between = (apart * n[:, None]).T @ apart
    ridge = within + np.eye(dim) * 1e-9 * max(np.trace(within) / dim, 1e-12)
    root = np.linalg.inv(np.linalg.cholesky(ridge))
    power, directions = np.linalg.eigh(root @ between @ root.T)
    axes = root.T @ directions[:, np.argsort(power)[::-1][: min(k, len(classes) - 1)]]

    @F.pandas_udf("array<double>")
    def project(features: pd.Series) -> pd.Series:
        return pd.Series(list((matrix(features) - middle) @ axes))

    return df.withColumn("projected", project("features")), axes.T.tolist()


def feature_importance(spark, model) -> DataFrame:
    """Importance of every feature of a tree model, ranked."""
    values = [(i, float(v)) for i, v in enumerate(model.featureImportances.toArray())]
    rows = spark.createDataFrame(values, "feature int, importance double")  # one row per feature
    return rows.withColumn("rank", F.rank().over(Window.orderBy(F.desc("importance"))))
