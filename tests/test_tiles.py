"""Copies of rows that tile joins shuffle."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from wavelark.ml import dbscan, knn, tiles

SCHEMA = "recording_id string, class_name string, features array<double>"


def table(spark, x):
    return spark.createDataFrame([(f"r{i:04d}", "c", row.tolist()) for i, row in enumerate(x)], SCHEMA)


def recorded(monkeypatch):
    made, plain = [], tiles._sides

    def sides(*args):
        out = plain(*args)
        made.append(out.count())
        return out

    monkeypatch.setattr(tiles, "_sides", sides)
    return made


def test_copies_stay_bounded_and_blocks_merge(spark, monkeypatch):
    monkeypatch.setattr(tiles, "GROUPS", 4, raising=False)
    made = recorded(monkeypatch)
    rows = spark.range(200).select(F.col("id").cast("string").alias("recording_id"), F.lit(0).alias("cell"))

    def count(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        assert len(a) <= 20 and len(b) <= 20
        return pd.DataFrame({"recording_id": a["recording_id"], "n": len(b)})

    def merge(found):
        return found.groupby("recording_id", as_index=False)["n"].sum()

    out = tiles.compare(rows, rows, count, "recording_id string, n long", side=20, merge=merge).collect()
    assert made == [400, 400] and len(out) == 400  # two tiles a side, one row of results in each
    total = pd.DataFrame(out, columns=["id", "n"]).groupby("id")["n"].sum()
    assert len(total) == 200 and (total == 200).all()


def test_rows_the_pivots_do_not_separate_visit_one_cell(spark, monkeypatch):
    monkeypatch.setattr(knn, "VISITS", 2, raising=False)
    made = recorded(monkeypatch)
    x = np.random.default_rng(0).normal(size=(300, 48))
    found = knn.neighbours(table(spark, x), table(spark, x[:20] + 0.1), 3).collect()
    assert made == [20, 300]
    d = np.linalg.norm(x[:20, None] + 0.1 - x[None], axis=2)
    best = {(f"r{i:04d}", k + 1): f"r{j:04d}" for i in range(20) for k, j in enumerate(np.argsort(d[i])[:3])}
    assert {(r.recording_id, r["rank"]): r.neighbour for r in found} == best


def test_spanning_edges_keep_components():
    rng = np.random.default_rng(1)
    edges = pd.DataFrame({"a": rng.integers(0, 60, 45).astype(str), "b": rng.integers(0, 60, 45).astype(str)}, dtype=object)

    def roots(pairs: pd.DataFrame) -> dict[str, str]:
        root = {n: n for n in {*edges["a"], *edges["b"]}}
        for _ in range(len(root)):
            for a, b in zip(pairs["a"], pairs["b"], strict=True):
                root[a] = root[b] = min(root[a], root[b])
        return root

    whole, fewer = roots(edges), dbscan._spanning(edges)
    assert roots(fewer) == whole and len(fewer) == len(whole) - len(set(whole.values()))
