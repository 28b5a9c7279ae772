"""Deep random forests: big nodes level by level, the rest of each tree where its rows meet.

A level-wise fit sums dense histograms of every open node over all partitions,
which is out of proportion once a node holds a few rows.  Here only nodes of
more than ``LOCAL`` rows are split from summed histograms; the rows of each
smaller node are sent to one group, packed as bins of a byte, and its subtree is
grown there.  Bootstrap weights are hashes of row and tree, so no bag is stored.
Splits follow Spark's rules: Gini gain above zero, the square root of the
features at each node, at most ``BINS`` bins of a feature, thresholds half way
between values.

The grown nodes stay a table, one row per subtree: a deep forest has about as
many nodes as trees times rows, which no driver holds.  ``Forest`` sends the
rows to predict to their subtrees in the same way and sums the trees' votes.
"""

from __future__ import annotations

import json
import math
import uuid
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.ml import Model
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector, Vectors
from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.session import materialise, shared_folder

#: Rows up to which Spark's own fit takes few passes; rows of a node whose subtree one group grows; bins of a feature.
SMALL, LOCAL, BINS = 1000, 1 << 16, 32
#: Nodes whose histograms are held together.
CHUNK = 256
#: Chances of a Poisson weight (mean 1) of at most 0, 1, ...
CHANCES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
GOLDEN = 0x9E3779B97F4A7C15
#: Rows of a block that are sent to a subtree together, and numbers that the votes on a block may be.
BLOCK, VOTES = 256, 1 << 22
#: A subtree: its nodes as bytes (``_form``) and what its splits add to the importance of each feature.
SUBTREE = "tree int, root int, nodes binary, gains array<double>"
NODE = "tree int, root int, id int, feature int, threshold double, left int, right int, gain double, raw long, counts array<double>"


def weights(keys: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the bag of ``tree``."""
    z = keys.view(np.uint64) + np.uint64(GOLDEN * (seed * 1_000_003 + tree + 1) % (1 << 64))
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    z ^= z >> np.uint64(31)
    return np.searchsorted(CHANCES, (z >> np.uint64(11)).astype(float) / (1 << 53), side="right")


def cuts(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Thresholds per position: between all values of a feature that has few, else between its quantiles, over all rows."""
    at = [F.col("x")[i] for i in range(width)]
    shares = [i / (BINS - 1) for i in range(BINS)]
    row = rows.agg(
        F.array(*[F.percentile_approx(x, shares, 10_000) for x in at]).alias("q"),
        F.array(*[F.approx_count_distinct(x) for x in at]).alias("n"),
    ).first()
    few = [i for i in range(width) if row["n"][i] <= 2 * BINS]
    values = [np.unique(q) for q in row["q"]]
    if few:
        sets = rows.agg(*[F.collect_set(at[i]).alias(f"s{i}") for i in few]).first()
        values = [np.unique(sets[f"s{i}"]) if i in few and len(sets[f"s{i}"]) <= BINS else v for i, v in enumerate(values)]
    return [(v[1:] + v[:-1]) / 2 for v in values]


def _best(codes, label, weight, local, counts, feats):
    """(feature, cut, gain, counts on the left) of each node; ``local`` numbers the rows' nodes."""
    nodes, classes = counts.shape
    line, total = np.arange(nodes), counts.sum(axis=1)
    best, feature, cut = np.full(nodes, -np.inf), np.full(nodes, -1), np.zeros(nodes, dtype=np.int64)
    left = np.zeros_like(counts)
    rows = np.arange(len(local))
    for slot in range(feats.shape[1]):
        bins = codes[rows, feats[local, slot]].astype(np.int64)
        below = np.bincount((local * BINS + bins) * classes + label, weight, nodes * BINS * classes)
        below = below.reshape(nodes, BINS, classes).cumsum(axis=1)[:, :-1]
        score, place, chosen = _score(below, counts)
        better = score > best
        best[better], feature[better], cut[better] = score[better], feats[line, slot][better], place[better]
        left[better] = chosen[better]
    return feature, cut, best / total - ((counts / total[:, None]) ** 2).sum(axis=1), left


def _score(below: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best sum of squared counts over sizes of both sides, its cut and the counts on its left."""
    above = counts[:, None] - below
    n, m = below.sum(axis=2), above.sum(axis=2)
    score = np.einsum("abc,abc->ab", below, below) / np.maximum(n, 1) + np.einsum("abc,abc->ab", above, above) / np.maximum(m, 1)
    score[(n == 0) | (m == 0)] = -np.inf
    place = score.argmax(axis=1)
    line = np.arange(len(counts))
    return score[line, place], place, below[line, place]


def grow(codes: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int, depth: int, picked: int, rng) -> dict[str, np.ndarray]:
    """Nodes of the tree of these rows, numbered level by level; ``feature`` is -1 at leaves."""
    width = codes.shape[1]
    counts = np.bincount(label, weight, classes)[None, :]
    ids, made = np.zeros(1, dtype=np.int64), 1
    where = np.zeros(len(label), dtype=np.int64)
    levels = []
    for level in range(depth + 1):
        found = {
            "feature": np.full(len(ids), -1), "cut": np.zeros(len(ids), dtype=np.int64), "gain": np.full(len(ids), -1.0),
            "left": np.full(len(ids), -1), "right": np.full(len(ids), -1), "counts": counts,
            "raw": np.bincount(where, minlength=len(ids)),
        }
        levels.append(found)
        open_ = (counts.max(axis=1) < counts.sum(axis=1)) & (level < depth)
        kept = np.flatnonzero(open_[where])
        order = kept[np.argsort(where[kept], kind="stable")]
        codes, label, weight = codes[order], label[order], weight[order]
        nodes = np.flatnonzero(open_)
        where = np.searchsorted(nodes, where[order])
        starts = np.searchsorted(where, np.arange(len(nodes) + 1))
        below = np.zeros((len(nodes), classes))
        for a in range(0, len(nodes), CHUNK):
            b = min(a + CHUNK, len(nodes))
            part = slice(starts[a], starts[b])
            feats = rng.random((b - a, width)).argpartition(picked - 1, axis=1)[:, :picked] if picked < width else np.tile(np.arange(width), (b - a, 1))
            feature, cut, gain, below[a:b] = _best(codes[part], label[part], weight[part], where[part] - a, counts[nodes[a:b]], feats)
            split = gain > 1e-12
            at = nodes[a:b][split]
            found["feature"][at], found["cut"][at], found["gain"][at] = feature[split], cut[split], gain[split]
        split = found["feature"][nodes] >= 0
        if not split.any():
            break
        at = nodes[split]
        found["left"][at] = made + 2 * np.arange(len(at))
        found["right"][at] = found["left"][at] + 1
        made += 2 * len(at)
        moving = split[where]
        codes, label, weight, where = codes[moving], label[moving], weight[moving], where[moving]
        node = nodes[where]
        right = codes[np.arange(len(node)), found["feature"][node]] > found["cut"][node]
        where = 2 * (np.cumsum(split) - 1)[where] + right
        own = below[split]
        counts = np.stack([own, counts[at] - own], axis=1).reshape(-1, classes)
        ids = np.arange(len(counts))
    return {k: np.concatenate([level[k] for level in levels]) for k in levels[0]}


def _route(top: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """The node of a tree's grown top that each row ends in."""
    node = np.zeros(len(codes), dtype=np.int64)
    moving = np.arange(len(codes))
    while len(moving := moving[top["feature"][node[moving]] >= 0]):
        at = node[moving]
        low = codes[moving, top["feature"][at]] <= top["cut"][at]
        node[moving] = np.where(low, top["left"][at], top["right"][at])
    return node


def _read(batch: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    codes = np.frombuffer(b"".join(batch["codes"]), dtype=np.uint8).reshape(-1, width)
    return batch["key"].to_numpy(dtype=np.int64), codes, batch["label"].to_numpy(dtype=np.int64)


def _split_level(rows: DataFrame, tops: list[dict], wanted: list[list[int]], classes: int, width: int, picked: int, seed: int) -> list:
    """Best splits of the ``wanted`` nodes of each tree from histograms summed over all rows."""

    def features(tree: int, node: int) -> np.ndarray:
        return np.random.default_rng([seed, tree, node, 1]).permutation(width)[:picked]

    def partial(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            keys, codes, label = _read(batch, width)
            for tree, nodes in enumerate(wanted):
                if not nodes:
                    continue
                weight = weights(keys, tree, seed)
                place = _route(tops[tree], codes)
                for node in nodes:
                    at = np.flatnonzero((place == node) & (weight > 0))
                    cells = codes[at][:, features(tree, node)].astype(np.int64) + BINS * np.arange(picked)
                    cells = (cells * classes + label[at, None]).ravel()
                    size = picked * BINS * classes
                    found = np.stack([np.bincount(cells, w, size) for w in (np.repeat(weight[at], picked), None)])
                    sums[tree, node] = sums.get((tree, node), 0) + found
        yield pd.DataFrame({
            "tree": [t for t, _ in sums], "node": [n for _, n in sums], "sums": [s.astype("<f8").tobytes() for s in sums.values()],
        })

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        tree, node = int(part["tree"].iloc[0]), int(part["node"].iloc[0])
        whole, raw = sum(np.frombuffer(s, dtype="<f8") for s in part["sums"]).reshape(2, picked, BINS, classes)
        counts = whole[0].sum(axis=0)
        below = whole.cumsum(axis=1)[:, :-1]
        score, place, left = _score(below, np.tile(counts, (picked, 1)))
        slot = int(score.argmax())
        gain = float(score[slot] / counts.sum() - ((counts / counts.sum()) ** 2).sum())
        low = int(raw[slot, : place[slot] + 1].sum())
        return pd.DataFrame({
            "tree": [tree], "node": [node], "feature": [int(features(tree, node)[slot])], "cut": [int(place[slot])], "gain": [gain],
            "counts": [counts], "lower": [left[slot]], "n": [int(raw[slot].sum())], "n_lower": [low],
        })

    schema = "tree int, node int, feature int, cut int, gain double, counts array<double>, lower array<double>, n long, n_lower long"
    return rows.mapInPandas(partial, "tree int, node int, sums binary").groupBy("tree", "node").applyInPandas(choose, schema).collect()


def _tops(rows: DataFrame, n: int, trees: int, depth: int, classes: int, width: int, picked: int, seed: int) -> list[dict]:
    """The upper part of each tree, down to nodes of ``LOCAL`` rows; ``done`` marks its leaves."""
    names = ("feature", "cut", "left", "right", "level", "done", "gain", "n")
    tops = [{k: np.array([v]) for k, v in zip(names, (-1, 0, -1, -1, 0, False, -1.0, n), strict=True)} | {"counts": [None]} for _ in range(trees)]
    wanted = [[0] if n > LOCAL and depth else [] for _ in range(trees)]
    while any(wanted):
        found = _split_level(rows, tops, wanted, classes, width, picked, seed)
        wanted = [[] for _ in range(trees)]
        for r in found:
            top, at = tops[r.tree], r.node
            top["counts"][at], top["n"][at] = np.array(r.counts), r.n
            if not r.gain > 1e-12:
                top["done"][at] = True
                continue
            made, lower = len(top["feature"]), np.array(r.lower)
            for k, v in (("feature", r.feature), ("cut", r.cut), ("left", made), ("right", made + 1), ("gain", r.gain)):
                top[k][at] = v
            for own, size in ((lower, r.n_lower), (np.array(r.counts) - lower, r.n - r.n_lower)):
                level = int(top["level"][at]) + 1
                leaf = level == depth or own.max() == own.sum()
                for k, v in zip(names, (-1, 0, -1, -1, level, leaf, -1.0, size), strict=True):
                    top[k] = np.append(top[k], v)
                top["counts"].append(own)
                if not leaf and size > LOCAL:
                    wanted[r.tree].append(len(top["feature"]) - 1)
    return tops


def _form(classes: int) -> np.dtype:
    """A node in the bytes of a subtree; its right child is the one after its left."""
    return np.dtype([("feature", "<i4"), ("cut", "u1"), ("left", "<i4"), ("gain", "<f8"), ("raw", "<i4"), ("counts", "<i4", (classes,))])


def _packed(found: dict, classes: int) -> bytes:
    nodes = np.zeros(len(found["feature"]), dtype=_form(classes))
    for k in nodes.dtype.names:
        nodes[k] = found[k]
    return nodes.tobytes()


def _unpacked(nodes: bytes, classes: int) -> dict[str, np.ndarray]:
    found = np.frombuffer(nodes, dtype=_form(classes))
    out = {k: np.ascontiguousarray(found[k]) for k in found.dtype.names}
    return out | {"right": np.where(out["left"] >= 0, out["left"] + 1, -1)}


def _gains(found: dict, width: int) -> np.ndarray:
    """Gain times rows of the splits by each feature."""
    inner = np.asarray(found["feature"]) >= 0
    total = np.array([np.sum(c) for c in found["counts"]])[inner] if len(inner) else np.zeros(0)
    return np.bincount(np.asarray(found["feature"])[inner], np.asarray(found["gain"])[inner] * total, width)


def _coded(column: Column, edges: list[np.ndarray]) -> Column:
    """Bins of an array column, a byte each."""

    @F.pandas_udf("binary")
    def coded(x: pd.Series) -> pd.Series:
        values = np.stack(x.to_list())
        codes = np.stack([np.searchsorted(e, v, side="left") for e, v in zip(edges, values.T, strict=True)], axis=1)
        return pd.Series([row.tobytes() for row in codes.astype(np.uint8)])

    return coded(column)


class Forest(Model, MLWritable, MLReadable):
    """A fitted forest whose nodes stay in a table: columns and votes as Spark's own model has them.

    ``folder`` holds the subtrees and a Spark model of single leaves, whose
    metadata ``native`` needs; ``tops`` and ``edges`` are small.
    """

    def __init__(self, folder: str, column: str, classes: int, edges: list[np.ndarray], tops: list[dict]):
        super().__init__()
        self.folder, self.column, self.classes, self.edges, self.tops = folder, column, classes, edges, tops

    @property
    def numClasses(self) -> int:  # noqa: N802
        return self.classes

    @property
    def numFeatures(self) -> int:  # noqa: N802
        return len(self.edges)

    @property
    def getNumTrees(self) -> int:  # noqa: N802
        return len(self.tops)

    @property
    def trees(self) -> list:
        """Spark's trees, whole on the driver."""
        return self.native().trees

    @property
    def featureImportances(self) -> DenseVector:  # noqa: N802
        """Each tree's shares of gain times rows, summed: the subtrees' sums meet per tree, no node reaches the driver."""
        width = len(self.edges)

        def add(part: pd.DataFrame) -> pd.DataFrame:
            total = np.stack(part.sort_values("root")["gains"].to_list()).sum(axis=0)
            return pd.DataFrame({"tree": [int(part["tree"].iloc[0])], "gains": [total]})

        below = self._subtrees().select("tree", "root", "gains").groupBy("tree").applyInPandas(add, "tree int, gains array<double>")
        found = {r.tree: np.array(r.gains) for r in below.collect()}  # one row per tree
        total = np.zeros(width)
        for tree, top in enumerate(self.tops):
            own = found.get(tree, 0) + _gains({**top, "counts": [c if c is not None else 0 for c in top["counts"]]}, width)
            if own.sum() > 0:
                total += own / own.sum()
        return Vectors.dense(total / total.sum() if total.sum() > 0 else total)

    def native(self) -> RandomForestClassificationModel:
        """Spark's model of these nodes; it lives whole on the driver."""
        return _model(self.folder, self._nodes())

    def _subtrees(self) -> DataFrame:
        return SparkSession.getActiveSession().read.schema(SUBTREE).parquet(f"{self.folder}/subtrees")

    def _nodes(self) -> DataFrame:
        """All nodes as rows, numbered within their trees."""
        classes, edges, names = self.classes, self.edges, [f.split()[0] for f in NODE.split(", ")]
        spark, form = SparkSession.getActiveSession(), _form(classes)
        below = self._subtrees()
        sizes = {(r.tree, r.root): r.n // form.itemsize for r in below.select("tree", "root", F.length("nodes").alias("n")).collect()}
        base, above = [], []
        for tree, top in enumerate(self.tops):
            made = len(top["feature"])
            for root in range(made):
                if top["feature"][root] >= 0 or top["done"][root]:
                    f, c = int(top["feature"][root]), int(top["cut"][root])
                    above.append((
                        tree, root, root, f, float(edges[f][c]) if f >= 0 else 0.0, int(top["left"][root]), int(top["right"][root]),
                        float(top["gain"][root]), int(top["n"][root]), [float(v) for v in top["counts"][root]],
                    ))
                elif (tree, root) in sizes:
                    base.append((tree, root, made - 1))
                    made += sizes[tree, root] - 1

        def spread(batches):
            for batch in batches:
                for tree, root, base, nodes in batch[["tree", "root", "base", "nodes"]].itertuples(index=False):
                    found = _unpacked(nodes, classes)
                    line = np.arange(len(found["feature"]))
                    moved = {k: np.where(found[k] >= 0, found[k] + base, -1) for k in ("left", "right")}
                    threshold = [float(edges[f][c]) if f >= 0 else 0.0 for f, c in zip(found["feature"], found["cut"], strict=True)]
                    yield pd.DataFrame({
                        "tree": tree, "root": root, "id": np.where(line == 0, root, line + base), "feature": found["feature"],
                        "threshold": threshold, **moved, "gain": found["gain"], "raw": found["raw"], "counts": list(found["counts"].astype(float)),
                    })[names]

        placed = below.join(F.broadcast(spark.createDataFrame(base, "tree int, root int, base int")), ["tree", "root"])
        return placed.mapInPandas(spread, NODE).unionByName(spark.createDataFrame(above, NODE))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        if dataset.isStreaming:  # groups of a stream can't wait for each other
            return self.native().transform(dataset)
        coded = dataset.withColumn("_codes", _coded(vector_to_array(self.column), self.edges))
        rows = coded.join(self._votes(coded.select(F.col("_codes").alias("codes"))), F.col("_codes") == F.col("codes"))
        total = F.aggregate("votes", F.lit(0.0), lambda a, x: a + x)
        return rows.select(
            *[dataset[c] for c in dataset.columns], array_to_vector("votes").alias("rawPrediction"),
            array_to_vector(F.transform("votes", lambda x: x / total)).alias("probability"),
            (F.array_position("votes", F.array_max("votes")) - 1).cast("double").alias("prediction"),
        )

    def _votes(self, rows: DataFrame) -> DataFrame:
        """The trees' votes on each distinct value of ``codes``."""
        tops, classes, width = self.tops, self.classes, len(self.edges)
        size = max(1, min(BLOCK, VOTES // (len(tops) * classes)))

        def dealt(batches):
            block = TaskContext.get().partitionId() << 32
            for batch in batches:
                codes = np.frombuffer(b"".join(batch["codes"]), dtype=np.uint8).reshape(-1, width)
                out = []
                for at in range(0, len(codes), size):
                    part, block = codes[at : at + size], block + 1
                    for tree, top in enumerate(tops):
                        place = _route(top, part)
                        for root in np.unique(place):
                            own = np.flatnonzero(place == root)
                            out.append((tree, int(root), block, own.astype("<u2").tobytes() + part[own].tobytes()))
                yield pd.DataFrame(out, columns=["tree", "root", "block", "body"])

        def walk(batches):
            """The votes of one subtree after the other; block 0 is the subtree itself."""
            nodes = None
            for batch in batches:
                out = []
                for (tree, _), some in groupby(batch[["tree", "root", "block", "body"]].itertuples(index=False), key=lambda r: (r.tree, r.root)):
                    some = list(some)
                    if some[0].block == 0:
                        nodes = _unpacked(some.pop(0).body, classes)
                    if not some:
                        continue
                    n = [len(r.body) // (width + 2) for r in some]
                    codes = [np.frombuffer(r.body, dtype=np.uint8, offset=2 * k).reshape(k, width) for r, k in zip(some, n, strict=True)]
                    counts = nodes["counts"][_route(nodes, np.concatenate(codes))].astype(float)
                    share = np.split(counts / counts.sum(axis=1, keepdims=True), np.cumsum(n)[:-1])
                    for r, k, x, p in zip(some, n, codes, share, strict=True):
                        out.append((r.block, tree, r.body[: 2 * k], p.tobytes(), x.tobytes() if tree == 0 else None))
                yield pd.DataFrame(out, columns=["block", "tree", "place", "share", "codes"])

        def add(part: pd.DataFrame) -> pd.DataFrame:
            n = sum(map(len, part["place"])) // (2 * len(tops))
            votes, codes = np.zeros((n, classes)), np.zeros((n, width), dtype=np.uint8)
            for r in part.sort_values("tree").itertuples(index=False):
                own = np.frombuffer(r.place, dtype="<u2")
                votes[own] += np.frombuffer(r.share).reshape(-1, classes)
                if r.tree == 0:
                    codes[own] = np.frombuffer(r.codes, dtype=np.uint8).reshape(-1, width)
            return pd.DataFrame({"codes": [x.tobytes() for x in codes], "votes": list(votes)})

        spark = rows.sparkSession
        leaves = [
            (t, int(root), 0, _packed({k: [v] for k, v in (("feature", -1), ("cut", 0), ("left", -1), ("gain", -1.0), ("raw", top["n"][root]), ("counts", top["counts"][root]))}, classes))
            for t, top in enumerate(tops) for root in np.flatnonzero(top["done"])
        ]
        shape = "tree int, root int, block long, body binary"
        below = self._subtrees().select("tree", "root", F.lit(0).cast("long").alias("block"), F.col("nodes").alias("body"))
        # Sorted, so that a task that runs again makes the same blocks.
        blocks = rows.distinct().sortWithinPartitions("codes").mapInPandas(dealt, shape)
        met = below.unionByName(spark.createDataFrame(leaves, shape)).unionByName(blocks)
        met = met.repartition(len(tops), "tree", "root").sortWithinPartitions("tree", "root", "block")
        walked = met.mapInPandas(walk, "block long, tree int, place binary, share binary, codes binary")
        return walked.groupBy("block").applyInPandas(add, "codes binary, votes array<double>")

    def write(self) -> MLWriter:
        return ForestWriter(self)

    @classmethod
    def read(cls) -> MLReader:
        return ForestReader()


def _copy(spark: SparkSession, old: str, new: str) -> None:
    spark.read.schema(SUBTREE).parquet(f"{old}/subtrees").write.parquet(f"{new}/subtrees")
    spark.read.text(f"{old}/stub/metadata").coalesce(1).write.text(f"{new}/stub/metadata")
    for part in ("treesMetadata", "data"):
        spark.read.parquet(f"{old}/stub/{part}").write.parquet(f"{new}/stub/{part}")


class ForestWriter(MLWriter):
    def __init__(self, forest: Forest):
        super().__init__()
        self.forest = forest

    def saveImpl(self, path: str) -> None:  # noqa: N802
        spark, forest = self.sparkSession, self.forest
        DefaultParamsWriter.saveMetadata(forest, path, spark)
        tops = [{k: [None if x is None else np.asarray(x).tolist() for x in v] for k, v in top.items()} for top in forest.tops]
        about = {"column": forest.column, "classes": forest.classes, "edges": [e.tolist() for e in forest.edges], "tops": tops}
        spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.text(f"{path}/about")
        _copy(spark, forest.folder, path)


class ForestReader(MLReader):
    def load(self, path: str) -> Forest:
        spark = self.sparkSession
        about = json.loads(spark.read.text(f"{path}/about").first()["value"])
        tops = [
            {k: [None if x is None else np.array(x) for x in v] if k == "counts" else np.array(v) for k, v in top.items()}
            for top in about["tops"]
        ]
        folder = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
        _copy(spark, path, folder)  # what lies at ``path`` may be overwritten
        forest = Forest(folder, about["column"], about["classes"], [np.array(e, dtype=float) for e in about["edges"]], tops)
        return forest._resetUid(DefaultParamsReader.loadMetadata(path, spark)["uid"])


def _model(folder: str, nodes: DataFrame) -> RandomForestClassificationModel:
    """Spark's model of these nodes: the files of a model of single leaves, with its tree data replaced."""
    spark = nodes.sparkSession
    to = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    spark.read.text(f"{folder}/stub/metadata").coalesce(1).write.text(f"{to}/metadata")
    spark.read.parquet(f"{folder}/stub/treesMetadata").write.parquet(f"{to}/treesMetadata")
    form = spark.read.parquet(f"{folder}/stub/data").schema
    total = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x)
    squares = F.aggregate("counts", F.lit(0.0), lambda a, x: a + x * x)
    inner = F.col("feature") >= 0
    split = F.struct(
        F.col("feature").alias("featureIndex"),
        F.when(inner, F.array("threshold")).otherwise(F.array().cast("array<double>")).alias("leftCategoriesOrThreshold"),
        F.lit(-1).alias("numCategories"),
    )
    data = F.struct(
        "id", (F.array_position("counts", F.array_max("counts")) - 1).cast("double").alias("prediction"),
        (1 - squares / (total * total)).alias("impurity"), F.col("counts").alias("impurityStats"), F.col("raw").alias("rawCount"),
        "gain", F.col("left").alias("leftChild"), F.col("right").alias("rightChild"), split.alias("split"),
    )
    nodes.select(F.col("tree").alias("treeID"), data.cast(form["nodeData"].dataType).alias("nodeData")).write.parquet(f"{to}/data")
    return RandomForestClassificationModel.load(to)


def fit_forest(data: DataFrame, estimator: RandomForestClassifier, classes: int) -> Forest:
    """``estimator`` fitted on ``data`` (recording_id, label and its features column)."""
    spark, column = data.sparkSession, estimator.getFeaturesCol()
    rows = data.select("recording_id", F.col("label").cast("int").alias("label"), vector_to_array(column).alias("x"))
    rows = materialise(rows)
    n, trees, depth, seed = rows.count(), estimator.getNumTrees(), estimator.getMaxDepth(), estimator.getSeed()
    width = len(rows.first()["x"])
    edges = cuts(rows, width)
    picked = math.ceil(math.sqrt(width))
    # Repeated rows are rows: each gets a number of its own.
    key = F.xxhash64("recording_id", "label", "codes", F.monotonically_increasing_id())
    rows = rows.select("recording_id", "label", _coded(F.col("x"), edges).alias("codes"))
    rows = materialise(rows.select(key.alias("key"), "label", "codes"))
    tops = _tops(rows, n, trees, depth, classes, width, picked, seed)

    def dealt(batches):
        for batch in batches:
            keys, codes, label = _read(batch, width)
            out = []
            for tree, top in enumerate(tops):
                weight = weights(keys, tree, seed)
                place = np.where(weight > 0, _route(top, codes), -1)
                for node in np.unique(place[place >= 0]):
                    if not top["done"][node]:
                        at = place == node
                        block = np.column_stack([codes[at], weight[at], label[at] & 255, label[at] >> 8]).astype(np.uint8)
                        out.append((tree, int(node), block.tobytes()))
            yield pd.DataFrame(out, columns=["tree", "root", "block"])

    def finish(part: pd.DataFrame) -> pd.DataFrame:
        tree, root = int(part["tree"].iloc[0]), int(part["root"].iloc[0])
        block = np.frombuffer(b"".join(sorted(part["block"])), dtype=np.uint8).reshape(-1, width + 3)
        label = block[:, -2].astype(np.int64) | block[:, -1].astype(np.int64) << 8
        left = depth - int(tops[tree]["level"][root])
        rng = np.random.default_rng([seed, tree, root])
        found = grow(block[:, :width], label, block[:, width].astype(float), classes, left, picked, rng)
        return pd.DataFrame({"tree": [tree], "root": [root], "nodes": [_packed(found, classes)], "gains": [_gains(found, width)]})

    folder = f"{shared_folder(spark)}/forest-{uuid.uuid4().hex}"
    packed = rows.mapInPandas(dealt, "tree int, root int, block binary")
    packed.repartition(trees, "tree", "root").groupBy("tree", "root").applyInPandas(finish, SUBTREE).write.parquet(f"{folder}/subtrees")
    stub = spark.createDataFrame([(float(i), Vectors.dense([0.0] * width)) for i in range(classes)], ["label", column])
    estimator.fit(stub).write().save(f"{folder}/stub")
    return Forest(folder, column, classes, edges, tops)
