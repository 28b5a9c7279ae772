"""What iterative fits ask of the cluster."""

import numpy as np
import pandas as pd
from pyspark.ml.classification import LinearSVC
from pyspark.ml.clustering import KMeans

from wavelark.functions import stft
from wavelark.ml import classify as C
from wavelark.ml import clusters as K
from wavelark.operators import filters as X

SCHEMA = "recording_id string, class_name string, features array<double>"


def table(spark, n=240):
    rng = np.random.default_rng(3)
    return spark.createDataFrame([(f"r{i}", f"c{i % 2}", (rng.normal(size=4) + 4 * (i % 2)).tolist()) for i in range(n)], SCHEMA)


def test_machines_read_as_many_parts_as_run_at_once(spark, monkeypatch):
    seen, plain = [], LinearSVC._fit
    monkeypatch.setattr(LinearSVC, "_fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), plain(self, df))[1])
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        C.train(table(spark), "linear_svm")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert seen and max(seen) <= spark.sparkContext.defaultParallelism


def test_restarts_of_kmeans_move_together(spark, monkeypatch):
    steps, plain = [], KMeans._fit
    monkeypatch.setattr(KMeans, "_fit", lambda self, df: (steps.append(self.getMaxIter()), plain(self, df))[1])
    df = table(spark)
    centres = K.kmeans_centres(df, 3, restarts=3)
    assert steps == [0, 0, 0]
    x = np.array([r.features for r in df.collect()])
    own = ((x[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
    assert np.allclose(centres, [x[own == i].mean(axis=0) for i in range(3)], atol=1e-3)


def test_spectra_of_blocks_together(monkeypatch):
    monkeypatch.setattr(X, "STACKED", 200, raising=False)
    rng = np.random.default_rng(4)
    samples = pd.Series([rng.normal(size=16 + 7 * 4) for _ in range(9)])
    block, total = pd.Series([0, 1, 2] * 3), pd.Series([70] * 3 + [20] * 3 + [95] * 3)
    parts = list(X._stacked(samples, block, total, 16, 4))
    assert len(parts) > 1
    spectra, count = np.concatenate([s for s, _ in parts]), np.concatenate([c for _, c in parts])
    wanted = [stft.transform(x, 16, 4)[: max(0, n // 4 + 1 - b * 8)] for x, b, n in zip(samples, block, total)]
    assert count.tolist() == [len(w) for w in wanted] and np.allclose(spectra, np.concatenate(wanted))
