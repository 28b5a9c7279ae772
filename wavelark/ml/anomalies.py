"""Isolation forest and one-class SVM."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.ml.scale import Scaler, fit_scaler
from wavelark.ml.tiles import matrix
from wavelark.operators.ordered import exact_quantile, top_k
from wavelark.session import materialise

NODES = "tree int, node int, feature int, cut double, size int"


def _expected_depth(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a tree of ``n`` points."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 2)
    long = 2 * (np.log(np.maximum(safe - 1, 1)) + np.euler_gamma) - 2 * (safe - 1) / safe
    return np.where(n <= 1, 0.0, np.where(n == 2, 1.0, long))


def fit_isolation_forest(df: DataFrame, trees: int = 200, sample: int = 256, seed: int = 42) -> pd.DataFrame:
    """Nodes of all trees (at most ``trees * 2 * sample`` rows).

    A hash decides which trees see a row, so that each tree is offered about
    twice its sample; the rows with the smallest hashes are used.  Trees are
    grown on the executors, one bounded group each.
    """
    n = max(df.count(), 1)
    chance = min(1.0, 2.0 * sample / n)
    limit = int(chance * (2**62))
    draw = lambda t: F.shiftrightunsigned(F.xxhash64("recording_id", t, F.lit(seed)), 2)
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) <= limit)
    offered = df.select("recording_id", "features", F.explode(chosen).alias("tree")).withColumn(
        "_draw", draw(F.col("tree"))
    )
    used = top_k(offered, ["tree"], ["_draw", "recording_id"], sample, "recording_id")

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("recording_id")
        x = matrix(pdf["features"])
        tree = int(pdf["tree"].iloc[0])
        rng = np.random.default_rng([seed, tree])
        height = int(np.ceil(np.log2(max(len(x), 2))))
        out, todo = [], [(1, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            low, high = x[rows].min(axis=0), x[rows].max(axis=0)
            open_features = np.flatnonzero(high > low)
            if len(rows) <= 1 or depth >= height or len(open_features) == 0:
                out.append((tree, node, -1, 0.0, len(rows)))
                continue
            f = int(rng.choice(open_features))
            cut = float(rng.uniform(low[f], high[f]))
            out.append((tree, node, f, cut, len(rows)))
            left = x[rows, f] < cut
            todo += [(2 * node, rows[left], depth + 1), (2 * node + 1, rows[~left], depth + 1)]
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "size"])

    forest = used.groupBy("tree").applyInPandas(grow, NODES)
    return forest.toPandas()  # bounded: trees × 2 × sample nodes


def isolation_scores(df: DataFrame, forest: pd.DataFrame, sample: int = 256) -> DataFrame:
    """Add ``raw_score`` in (-1, 0); nearer to 0 is more normal."""
    plans = []
    for _, nodes in forest.groupby("tree"):
        top = int(nodes["node"].max()) + 1
        feature, cut, size = np.full(top, -1), np.zeros(top), np.zeros(top)
        at = nodes["node"].to_numpy()
        feature[at], cut[at], size[at] = nodes["feature"], nodes["cut"], nodes["size"]
        plans.append((feature, cut, size))
    usual = float(_expected_depth(min(sample, max(p[2].max() for p in plans))))

    @F.pandas_udf("double")
    def score(features: pd.Series) -> pd.Series:
        x = matrix(features)
        line = np.arange(len(x))
        total = np.zeros(len(x))
        for feature, cut, size in plans:
            node = np.ones(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[line, np.maximum(f, 0)] >= cut[node]
                node = np.where(inner, 2 * node + right, node)
            total += np.floor(np.log2(node)) + _expected_depth(size[node])
        return pd.Series(-(2.0 ** (-total / len(plans) / max(usual, 1e-12))))

    return df.withColumn("raw_score", score("features"))


def label_scores(scored: DataFrame, contamination: float = 0.1, threshold: float | None = None) -> DataFrame:
    """Add ``score`` (0 at the cut, higher is normal) and ``label`` (-1 anomaly).

    The cut is ``threshold`` if given, else the exact ``contamination`` quantile.
    """
    if threshold is None:
        cut = exact_quantile(scored, [], "raw_score", contamination, "cut").first()["cut"]
    else:
        cut = threshold
    score = F.col("raw_score") - F.lit(float(cut))
    return scored.withColumn("score", score).withColumn("label", F.when(F.col("score") < 0, -1).otherwise(1))


#: How far ranks of an approximate percentile of accuracy 10,000 may be off, doubled.
RANK_ERROR = 2e-4


def fit_one_class_svm(
    df: DataFrame, nu: float = 0.1, gamma: float | None = None, width: int = 256, iters: int = 300, seed: int = 42,
    tolerance: float = 1e-3,
) -> dict:
    """Approximate RBF one-class SVM on random Fourier features.

    The solution is the shortest weighted mean of rows in which no row weighs more
    than 1 / (``nu`` × rows).  Conditional gradient: a step finds the ``nu`` share of
    rows with the lowest scores, whose mean is a corner of the allowed set, and
    moves to the shortest mean of all corners found so far, by away steps on the
    driver.  Executors add up two times ``width`` numbers per step; nothing larger
    reaches the driver, where the corners are ``iters`` at most.

    Any cut gives a lower bound of the lowest corner's score, so the duality gap is
    certain even where the percentile isn't exact.  The fit ends when the gap is
    at most ``tolerance`` of the squared length of the weights; ``gap`` in the model
    tells how far it came if ``iters`` steps didn't suffice.  The rows are
    written once.  ``gamma=None`` means 1 / (features × variance).
    """
    df = materialise(df.select("features"))
    if gamma is None:
        size = F.size("features")
        total = F.aggregate("features", F.lit(0.0), lambda a, x: a + x)
        square = F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x)
        row = df.agg(F.sum(size).alias("n"), F.sum(total).alias("s"), F.sum(square).alias("q")).first()
        spread = row["q"] / row["n"] - (row["s"] / row["n"]) ** 2
        dim = df.select(size.alias("d")).first()["d"]
        gamma = 1.0 / (dim * spread) if spread > 0 else 1.0
    else:
        dim = df.select(F.size("features").alias("d")).first()["d"]
    rng = np.random.default_rng(seed)
    model = {
        "project": rng.normal(scale=np.sqrt(2 * gamma), size=(dim, width)),
        "shift": rng.uniform(0, 2 * np.pi, width),
        "weights": np.zeros(width),
        "rho": 0.0,
        "gap": np.inf,
    }
    share = nu * df.count()
    corners, parts = np.zeros((0, width)), np.zeros(0)
    for step in range(iters + 1):
        margins = df.select(_margin(model)("features").alias("m"))
        if len(corners):
            ends = [max(nu - RANK_ERROR, 0.0), min(nu + RANK_ERROR, 1.0)]
            low, high = margins.agg(F.percentile_approx("m", ends, 10000).alias("r")).first()["r"]
        else:
            low = high = 0.0  # all scores are
        below, near = _score_sums(df, model, low, high)
        corner = (below[:-1] + near[:-1] * ((share - below[-1]) / max(near[-1], 1.0))) / share
        w = model["weights"]
        bounds = [
            cut - (count * cut - w @ total) / share
            for cut, count, total in ((low, below[-1], below[:-1]), (high, below[-1] + near[-1], below[:-1] + near[:-1]))
        ]
        if len(corners):
            model["gap"] = float(max(w @ w - max(bounds), 0.0) / max(w @ w, 1e-300))
            if model["gap"] <= tolerance or step == iters:
                break
        corners, parts = np.vstack([corners, corner]), np.append(parts, 0.0 if len(corners) else 1.0)
        parts = _shortest_mean(corners, parts, tolerance / 10)
        corners, parts = corners[parts > 0], parts[parts > 0]
        model["weights"] = parts @ corners
    model["rho"] = float(exact_quantile(margins, [], "m", nu, "r").first()["r"])
    return model


def _score_sums(df: DataFrame, model: dict, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the mapped rows, then their count) with scores below ``low``, and from there to ``high``."""
    frozen, width = dict(model), len(model["shift"])

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, width + 1))
        for batch in batches:
            z = _fourier(matrix(batch["features"]), frozen)
            score = z @ frozen["weights"]
            for side, taken in enumerate((score < low, (score >= low) & (score <= high))):
                total[side] += np.append(z[taken].sum(axis=0), taken.sum())
        yield pd.DataFrame({"pos": np.arange(total.size), "value": total.ravel()})

    rows = df.mapInPandas(partial, "pos int, value double")
    sums = {r["pos"]: r["v"] for r in rows.groupBy("pos").agg(F.sum("value").alias("v")).collect()}
    both = np.array([sums.get(i, 0.0) for i in range(2 * (width + 1))]).reshape(2, width + 1)
    return both[0], both[1]


def _shortest_mean(corners: np.ndarray, parts: np.ndarray, tolerance: float, steps: int = 20000) -> np.ndarray:
    """Parts (sum 1, none negative) of the shortest mean of the corners: steps from the worst corner to the best."""
    gram = corners @ corners.T
    parts = parts.copy()
    scores = gram @ parts
    for _ in range(steps):
        best = int(scores.argmin())
        worst = int(np.where(parts > 0, scores, -np.inf).argmax())
        length = parts @ scores
        if scores[worst] - scores[best] <= tolerance * max(length, 1e-300):
            break
        curve = gram[best, best] + gram[worst, worst] - 2 * gram[best, worst]
        move = min((scores[worst] - scores[best]) / curve, parts[worst]) if curve > 0 else parts[worst]
        parts[worst] = 0.0 if move == parts[worst] else parts[worst] - move
        parts[best] += move
        scores = scores + move * (gram[:, best] - gram[:, worst])
    return parts / parts.sum()


def _fourier(x: np.ndarray, model: dict) -> np.ndarray:
    return np.sqrt(2.0 / len(model["shift"])) * np.cos(x @ model["project"] + model["shift"])


def _margin(model: dict):
    frozen = dict(model)

    @F.pandas_udf("double")
    def margin(features: pd.Series) -> pd.Series:
        return pd.Series(_fourier(matrix(features), frozen) @ frozen["weights"])

    return margin


def one_class_scores(df: DataFrame, model: dict) -> DataFrame:
    """Add ``score`` (negative outside the learnt region) and ``label``."""
    scored = df.withColumn("score", _margin(model)("features") - F.lit(model["rho"]))
    return scored.withColumn("label", F.when(F.col("score") < 0, -1).otherwise(1))


def detect_anomalies(
    df: DataFrame, method: str = "isolation_forest", contamination: float = 0.1, threshold: float | None = None
) -> DataFrame:
    """Standardise, fit and score in one go; an unknown method is an error."""
    return fit_anomalies(df, method, contamination, threshold).score(df)


@dataclass
class AnomalyModel:
    """A fitted detector with its scaler; scores rows it has not seen."""

    method: str
    scaler: Scaler
    fitted: dict
    cut: float

    def score(self, df: DataFrame) -> DataFrame:
        """Add ``score`` (0 at the cut, higher is normal) and ``label`` (-1 anomaly); features are scaled."""
        data = self.scaler.transform(df)
        if self.method == "isolation_forest":
            return label_scores(isolation_scores(data, pd.DataFrame(self.fitted)), threshold=self.cut)
        return one_class_scores(data, {k: np.asarray(v) if isinstance(v, list) else v for k, v in self.fitted.items()})

    def save(self, path: str) -> None:
        text = json.dumps({"method": self.method, "scaler": asdict(self.scaler), "fitted": self.fitted, "cut": self.cut})
        spark = SparkSession.getActiveSession()
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "AnomalyModel":
        about = json.loads(spark.read.text(path).first()["value"])
        return cls(about["method"], Scaler(**about["scaler"]), about["fitted"], about["cut"])


def fit_anomalies(
    df: DataFrame, method: str = "isolation_forest", contamination: float = 0.1, threshold: float | None = None
) -> AnomalyModel:
    """Scaler and detector fitted on ``df``; the cut is ``threshold`` or the ``contamination`` quantile."""
    scaler = fit_scaler(df)
    data = scaler.transform(df)
    if method == "isolation_forest":
        nodes = fit_isolation_forest(data)
        cut = threshold
        if cut is None:
            cut = exact_quantile(isolation_scores(data, nodes), [], "raw_score", contamination, "cut").first()["cut"]
        return AnomalyModel(method, scaler, nodes.to_dict("list"), float(cut))
    if method == "one_class_svm":
        machine = fit_one_class_svm(data, nu=contamination)
        fitted = {k: v.tolist() if isinstance(v, np.ndarray) else float(v) for k, v in machine.items()}
        return AnomalyModel(method, scaler, fitted, 0.0)
    raise ValueError(f"unknown method {method!r}")


def anomaly_stats(scored: DataFrame) -> DataFrame:
    bad = F.count_if(F.col("label") == -1)
    return scored.agg(
        F.count(F.lit(1)).alias("total_samples"),
        bad.alias("anomaly_count"),
        (bad / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("anomaly_ratio"),
        F.avg("score").alias("mean_score"),
        F.min("score").alias("min_score"),
    )
