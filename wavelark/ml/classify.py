"""Train, apply, save and load classifiers."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import ElementwiseProduct, StandardScaler, StringIndexer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.ml import metrics as M
from wavelark.ml.forest import SMALL, fit_forest
from wavelark.ml.knn import knn_classify, knn_votes
from wavelark.ml.scale import Scaler, fit_scaler
from wavelark.ml.tiles import matrix
from wavelark.ml.vote import best_class, soft_vote
from wavelark.operators.dataset import train_test
from wavelark.session import materialise


@dataclass
class Classifier:
    """A fitted pipeline with what is needed to feed and read it."""

    pipeline: PipelineModel
    labels: list[str]
    kernel: dict | None = None  # random Fourier features: seed, gamma, width, mean, std

    def probabilities(self, df: DataFrame) -> DataFrame:
        """Add ``probabilities``, a map from class to probability."""
        data = _vectors(df, self.kernel)
        names = F.array(*[F.lit(x) for x in self.labels])
        rows = self.pipeline.transform(data)
        kept = [c for c in df.columns if c != "probabilities"]
        return rows.select(
            *kept, F.map_from_arrays(names, vector_to_array("probability")).alias("probabilities")
        )

    def classify(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``confidence``."""
        rows = self.probabilities(df)
        best = F.array_min(
            F.transform(
                F.map_entries("probabilities"),
                lambda e: F.struct((-e["value"]).alias("rank"), e["key"].alias("name"), e["value"].alias("p")),
            )
        )
        return rows.withColumn("_best", best).withColumns(
            {"prediction": F.col("_best.name"), "confidence": F.col("_best.p")}
        ).drop("_best")

    def save(self, path: str) -> None:
        self.pipeline.write().overwrite().save(f"{path}/pipeline")
        spark = SparkSession.getActiveSession()
        text = json.dumps({"labels": self.labels, "kernel": self.kernel})
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Classifier":
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        return cls(PipelineModel.load(f"{path}/pipeline"), about["labels"], about["kernel"])


def _vectors(df: DataFrame, kernel: dict | None = None) -> DataFrame:
    """Add the model's input; random Fourier features stand in for an RBF kernel."""
    if kernel is None:
        return df.withColumn("vector", array_to_vector("features"))
    mean, std = np.array(kernel["mean"]), np.array(kernel["std"])
    rng = np.random.default_rng(kernel["seed"])
    project = rng.normal(scale=np.sqrt(2 * kernel["gamma"]), size=(len(mean), kernel["width"]))
    shift = rng.uniform(0, 2 * np.pi, kernel["width"])
    scale = np.sqrt(2.0 / kernel["width"])

    @F.pandas_udf("array<double>")
    def expand(features: pd.Series) -> pd.Series:
        x = (matrix(features) - mean) / np.where(std > 0, std, 1.0)
        return pd.Series(list(scale * np.cos(x @ project + shift)))

    return df.withColumn("vector", array_to_vector(expand("features")))


@dataclass
class Ensemble:
    """Soft vote of fitted classifiers and a k-nearest-neighbour vote."""

    members: list[Classifier]
    neighbours: DataFrame  # training rows, scaled
    scaler: Scaler | None
    k: int = 5

    def votes(self, df: DataFrame) -> DataFrame:
        """Mean probability per recording and class: (recording_id, class_name, p)."""
        rows = df.select("recording_id", "features")
        models = [
            m.probabilities(rows).select("recording_id", F.explode("probabilities").alias("class_name", "p"))
            for m in self.members
        ]
        near = rows if self.scaler is None else self.scaler.transform(rows)
        return soft_vote([*models, knn_votes(self.neighbours, near, self.k)])

    def classify(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` and ``confidence``."""
        return df.join(best_class(self.votes(df)), "recording_id")


def train_ensemble(
    df: DataFrame, test_split: float = 0.2, normalize: bool = True, seed: int = 42, k: int = 5, max_depth: int = 30,
    kinds: tuple[str, ...] = ("svm", "random_forest"),
) -> tuple[Ensemble, DataFrame]:
    """Fits an RBF machine and a forest on one split and adds the neighbour vote.

    Returns the ensemble and the predicted test rows.
    """
    members = [train(df, kind, test_split, normalize, seed, max_depth)[0] for kind in kinds]
    split = train_test(df, test=test_split, seed=seed)
    fit_on, held_out = (split.filter(F.col("split") == part).drop("split") for part in ("train", "test"))
    scaler = fit_scaler(fit_on) if normalize else None
    near = fit_on if scaler is None else scaler.transform(fit_on)
    model = Ensemble(members, materialise(near.select("recording_id", "class_name", "features")), scaler, k)
    return model, model.classify(held_out)


def train(
    df: DataFrame, model_type: str = "random_forest", test_split: float = 0.2, normalize: bool = True, seed: int = 42,
    max_depth: int = 30,
) -> tuple[Classifier, DataFrame]:
    """Fit on a stratified part; returns the model and the predicted test rows.

    ``model_type``: random_forest, svm (RBF, approximated), linear_svm; for the
    ensemble see ``train_ensemble``.
    Trees grow to ``max_depth``, by default the deepest there is.
    k-nearest neighbours needs no fitting, see ``evaluate_knn``.
    """
    split = train_test(df, test=test_split, seed=seed)
    fit_on, held_out = (split.filter(F.col("split") == part).drop("split") for part in ("train", "test"))
    kernel = None
    if model_type == "svm":
        scaler = fit_scaler(fit_on)
        used = sum(s > 0 for s in scaler.std) or 1
        kernel = {"seed": seed, "gamma": 1.0 / used, "width": 512, **asdict(scaler)}
        if not normalize:
            kernel |= {"mean": [0.0] * len(scaler.mean), "std": [1.0] * len(scaler.std)}
    data = _vectors(fit_on, kernel)
    stages = [StringIndexer(inputCol="class_name", outputCol="label", stringOrderType="alphabetAsc", handleInvalid="error")]
    column = "vector"
    n = fit_on.count()
    if normalize and kernel is None:
        width = fit_on.select(F.size("features").alias("d")).first()["d"]
        # The scaler divides by the sample deviation; the factor makes it the population's.
        factor = (n / (n - 1)) ** 0.5 if n > 1 else 1.0
        stages += [
            StandardScaler(inputCol="vector", outputCol="scaled", withMean=True, withStd=True),
            ElementwiseProduct(inputCol="scaled", outputCol="ready", scalingVec=Vectors.dense([factor] * width)),
        ]
        column = "ready"
    if model_type == "random_forest":
        stages.append(RandomForestClassifier(featuresCol=column, numTrees=100, maxDepth=max_depth, seed=seed))
    elif model_type in ("svm", "linear_svm"):
        # A penalty of 1/n is the usual C = 1.
        machine = LinearSVC(featuresCol=column, maxIter=100, tol=1e-3, regParam=1.0 / max(n, 1))
        margins = OneVsRest(classifier=machine, featuresCol=column, parallelism=8)
        # Probabilities come from a logistic fit on the margins.
        calibrate = LogisticRegression(
            featuresCol="rawPrediction", rawPredictionCol="calibrated", predictionCol="calibrated_class",
            maxIter=50, regParam=1e-3,
        )
        stages += [margins, calibrate]
    else:
        raise ValueError(f"unknown model type {model_type!r}")
    deep = model_type == "random_forest" and n > SMALL
    data = data.select("class_name", "vector", *["recording_id"] * deep)
    if model_type != "random_forest":
        # Read by every iteration, each of whose tasks reports to the driver: as many parts as run at once.
        data = data.coalesce(max(1, df.sparkSession.sparkContext.defaultParallelism))
    data = data.persist()
    try:
        labels_first = Pipeline(stages=stages[:1]).fit(data)
        labels = list(labels_first.stages[0].labels)
        labelled = labels_first.transform(data)
        if deep and len(labels) > 1:
            before = Pipeline(stages=stages[1:-1]).fit(labelled)
            forest = fit_forest(before.transform(labelled), stages[-1], len(labels))
            fitted = PipelineModel([*before.stages, forest])
        else:
            fitted = Pipeline(stages=stages[1:]).fit(labelled)
    finally:
        data.unpersist()
    model = Classifier(fitted, labels, kernel)
    return model, model.classify(held_out)


def evaluate_knn(df: DataFrame, k: int = 5, test_split: float = 0.2, normalize: bool = True, seed: int = 42) -> DataFrame:
    """Predicted test rows of a k-nearest-neighbour vote."""
    split = train_test(df, test=test_split, seed=seed)
    fit_on, held_out = (split.filter(F.col("split") == part).drop("split") for part in ("train", "test"))
    if normalize:
        scaler = fit_scaler(fit_on)
        fit_on, held_out = scaler.transform(fit_on), scaler.transform(held_out)
    votes = knn_classify(fit_on, held_out, k)
    return held_out.select("recording_id", "class_name").join(votes, "recording_id")


def report(predicted: DataFrame) -> dict[str, DataFrame]:
    """Accuracy, per-class report, averages and confusion counts."""
    per_class = M.class_report(predicted)
    return {
        "accuracy": M.accuracy(predicted),
        "classes": per_class,
        "averages": M.average_report(per_class),
        "confusion": M.confusion(predicted),
    }
