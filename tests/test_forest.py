"""Forests grown below the nodes of many rows."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.classification import RandomForestClassifier

from wavelark.ml import classify as C
from wavelark.ml import forest
from wavelark.ml import metrics


def test_weights_are_poisson():
    keys = np.random.default_rng(0).integers(-(2**62), 2**62, 20_000)
    for tree in (0, 7):
        w = forest.weights(keys, tree, 42)
        assert abs(w.mean() - 1) < 0.03 and abs(w.var() - 1) < 0.06
    assert (forest.weights(keys, 0, 42) != forest.weights(keys, 1, 42)).mean() > 0.5


def test_a_tree_by_definition():
    """All features tried: the first split is the best one, and leaves are pure or can't be cut."""
    rng = np.random.default_rng(1)
    codes, label = rng.integers(0, 6, (200, 3)).astype(np.uint8), rng.integers(0, 3, 200)
    weight = rng.integers(1, 4, 200).astype(float)
    tree = forest.grow(codes, label, weight, 3, 30, 3, rng)

    def gini(at):
        p = np.bincount(label[at], weight[at], 3) / weight[at].sum()
        return 1 - (p**2).sum()

    def gain(f, c):
        low = codes[:, f] <= c
        share = weight[low].sum() / weight.sum()
        return gini(np.full(200, True)) - share * gini(low) - (1 - share) * gini(~low) if 0 < share < 1 else -1

    best = max(gain(f, c) for f in range(3) for c in range(6))
    assert abs(tree["gain"][0] - best) < 1e-9 and abs(gain(tree["feature"][0], tree["cut"][0]) - best) < 1e-9
    place = forest._route(tree, codes)
    for leaf in np.unique(place):
        at = place == leaf
        assert np.allclose(tree["counts"][leaf], np.bincount(label[at], weight[at], 3)) and tree["raw"][leaf] == at.sum()
        own = {tuple(r) for r in codes[at]}
        assert len(set(label[at])) == 1 or len(own) == 1 or gain_below(codes[at], label[at], weight[at]) <= 1e-12


def gain_below(codes, label, weight):
    def squares(at):
        return (np.bincount(label[at], weight[at], 3) ** 2).sum() / weight[at].sum()

    whole = squares(np.full(len(label), True))
    lows = [codes[:, f] <= c for f in range(3) for c in range(6)]
    return max([(squares(x) + squares(~x) - whole) / weight.sum() for x in lows if x.any() and not x.all()], default=0.0)


@pytest.mark.parametrize("local", [40, 10_000])
def test_no_level_wise_fit_of_many_rows(spark, monkeypatch, local):
    """Above SMALL rows Spark's level-wise fit sees the stub alone; the forest predicts and counts as it should."""
    monkeypatch.setattr(forest, "LOCAL", local)
    monkeypatch.setattr(C, "SMALL", 100, raising=False)
    fitted, plain = [], RandomForestClassifier._fit
    monkeypatch.setattr(RandomForestClassifier, "_fit", lambda self, df: (fitted.append(df.count()), plain(self, df))[1])
    rng = np.random.default_rng(2)
    rows = [(f"r{i // 2}", f"c{i % 3}", (rng.normal(size=9) + 3 * (i % 3)).tolist()) for i in range(300)]
    df = spark.createDataFrame(rows, "recording_id string, class_name string, features array<double>")
    model, predicted = C.train(df)
    assert fitted == [3]
    assert metrics.accuracy(predicted).first().accuracy > 0.9
    trees = model.pipeline.stages[-1].trees
    assert len(trees) == 100
    assert all(t.depth > 0 for t in trees)
    assert abs(sum(model.pipeline.stages[-1].featureImportances.toArray()) - 1) < 1e-6


def test_no_node_reaches_the_driver(spark, monkeypatch, tmp_path):
    """Fitting, predicting, ranking features, saving and loading never load Spark's model, and agree with it."""
    monkeypatch.setattr(forest, "LOCAL", 40)
    monkeypatch.setattr(C, "SMALL", 100)
    monkeypatch.setattr(forest, "BLOCK", 7)
    loaded, plain = [], forest.RandomForestClassificationModel.load
    monkeypatch.setattr(forest.RandomForestClassificationModel, "load", lambda path: (loaded.append(path), plain(path))[1])
    rng = np.random.default_rng(3)
    rows = [(f"r{i // 2}", f"c{i % 3}", (rng.normal(size=5) + (i % 3)).tolist()) for i in range(300)]
    rows += rows[:40]  # copies with their ids
    df = spark.createDataFrame(rows, "recording_id string, class_name string, features array<double>")
    model, predicted = C.train(df)
    model.save(str(tmp_path / "m"))
    again = C.Classifier.load(spark, str(tmp_path / "m"))
    key = lambda found: sorted((r.recording_id, r.features, r.prediction, r.confidence, tuple(r.probabilities.items())) for r in found.collect())
    got, importance = key(predicted), model.pipeline.stages[-1].featureImportances.toArray()
    whole = df.select("recording_id", "class_name", "features")
    assert key(again.classify(whole)) == key(model.classify(whole))
    assert not loaded
    native = model.pipeline.stages[-1].native()
    same = C.Classifier(PipelineModel([*model.pipeline.stages[:-1], native]), model.labels)
    assert key(same.classify(whole)) == key(model.classify(whole)) and len(key(model.classify(whole))) == 340
    assert key(same.classify(predicted.select("recording_id", "class_name", "features"))) == got
    assert np.allclose(native.featureImportances.toArray(), importance, rtol=1e-12)
