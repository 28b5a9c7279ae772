"""Embedding whitening by mixed-precision refinement.

Every component c becomes the whole number x = floor(64 c) + 1000000.  One pass
adds the x of each dimension exactly, a second one the centred products; both
add a batch at a time and leave one partial result per task, added per row of
the matrix.  The driver holds one covariance matrix, whatever the number of
vectors: its eigenvectors are found in float32 and corrected in extended
precision by Ogita-Aishima steps, which consist of matrix products.
Eigenvalues closer than the step can tell apart form a cluster; each cluster's
small matrix is solved by itself before the steps go on.  A third pass projects,
a fourth and fifth measure the covariance of what it wrote.

Defined results: rows whose vector is null, empty, or holds null or non-finite
components are dropped; so are vectors whose length isn't the most frequent one
(of equally frequent ones, the longest); x saturates at plus and minus 2^52; a
direction without variance (its eigenvalue within rounding of zero) is no
component, so that a single vector or equal vectors give no rows; a null id is
an id; repeated rows are rows; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.llm.tables import written

STEP, SHIFT, LIMIT = 64, 1_000_000, 1 << 52
COMPONENTS = 32
#: Most correction steps; each about squares the error.
STEPS = 16

RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _finite(vector: Column) -> Column:
    wild = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~wild, F.lit(False))


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, x): the vectors that take part, as whole numbers."""
    doubles = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("vec_id"), doubles.alias("c")).filter(_finite(F.col("c")))
    limit = F.lit(float(LIMIT))

    def whole(c: Column) -> Column:
        return F.floor(F.greatest(F.least(c * STEP, limit), -limit)).cast("long") + SHIFT

    return rows.select("vec_id", F.transform("c", whole).alias("x"))


def matrix(column) -> np.ndarray:
    """Rows of an Arrow list column whose lists are equally long."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def summed(rows: DataFrame, column: str, part: Callable[[np.ndarray], np.ndarray], whole: bool = False) -> np.ndarray:
    """Sum of ``part(batch)``, a matrix, over all batches of a list column.

    A task adds up its batches and leaves one row per matrix row; those are
    added per matrix row in the order of the tasks.  Whole numbers stay exact.
    """
    import pyarrow as pa

    kind, zero = ("decimal(38,0)", 0) if whole else ("double", 0.0)

    def run(batches):
        from pyspark import TaskContext

        total = None
        for batch in batches:
            if batch.num_rows:
                made = part(matrix(batch.column(0)))
                total = made if total is None else total + made
        if total is not None:
            task = TaskContext.get().partitionId()
            values = pa.array([[str(int(v)) for v in r] if whole else r.tolist() for r in total])
            n = len(total)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(n, dtype=np.int32)), pa.array(np.full(n, task, dtype=np.int32)), values],
                names=["i", "task", "parts"],
            )

    partial = rows.select(column).mapInArrow(run, f"i int, task int, parts array<{'string' if whole else 'double'}>")
    ordered = F.sort_array(F.collect_list(F.struct("task", F.col("parts").cast(f"array<{kind}>").alias("parts"))))
    start = F.transform(F.col("all")[0]["parts"], lambda _: F.lit(zero).cast(kind))

    def plus(total: Column, one: Column) -> Column:
        return F.zip_with(total, one["parts"], lambda a, b: (a + b).cast(kind))

    total = partial.groupBy("i").agg(ordered.alias("all")).select("i", F.aggregate("all", start, plus).alias("total"))
    found = sorted(total.collect(), key=lambda r: r.i)
    return np.array([r.total for r in found], dtype=object if whole else np.float64)


def _exact_sums(x: np.ndarray) -> np.ndarray:
    small = len(x) * max(abs(int(x.min())), abs(int(x.max()))) < 1 << 62
    return (x if small else x.astype(object)).sum(axis=0).astype(object)[None, :]


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a @ b


def _clusters(values: np.ndarray, width: float) -> list[np.ndarray]:
    """Places of neighbouring eigenvalues not further apart than ``width``."""
    order = np.argsort(-values, kind="stable")
    cuts = np.flatnonzero(-np.diff(values[order]) > width) + 1
    return np.split(order, cuts)


def _corrected(a: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, float]:
    """One Ogita-Aishima step: (eigenvalues, new vectors, size of the correction, width of a cluster)."""
    r = np.eye(len(a), dtype=a.dtype) - _product(x.T, x)
    s = _product(x.T, _product(a, x))
    r, s = (r + r.T) / 2, (s + s.T) / 2
    values = np.diag(s) / (1 - np.diag(r))
    off = s - np.diag(values)
    size = np.linalg.norm(a.astype(float), 2)
    width = float(2 * (np.linalg.norm(off.astype(float)) + size * np.linalg.norm(r.astype(float))))
    # Below this distance the quotients' own rounding would spoil the vectors.
    width = max(width, float(np.sqrt(np.finfo(a.dtype).eps)) * size)
    apart = values[None, :] - values[:, None]
    far = np.abs(apart) > width
    e = np.where(far, (s + values[None, :] * r) / np.where(far, apart, 1), r / 2)
    return values, x + _product(x, e), float(np.abs(e).max()), width


def eigenvectors(covariance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of a symmetric matrix, by falling eigenvalue."""
    scale = np.abs(covariance).max()
    if not scale > 0:
        return np.zeros(len(covariance)), np.eye(len(covariance))
    a = (covariance / scale).astype(np.longdouble)
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.longdouble)
    last = np.inf
    for _ in range(STEPS):
        values, x, size, width = _corrected(a, x)
        for places in _clusters(values, width):
            if len(places) > 1:
                # The spread of a cluster is all its vectors still mix: solved about its middle.
                part, middle = x[:, places], values[places].mean()
                inner = _product(part.T, _product(a, part) - middle * part)
                turn = np.linalg.eigh(((inner + inner.T) / 2).astype(np.float64))[1]
                x[:, places] = _product(part, turn.astype(np.longdouble))
        if size < 1e-17 or (size < 1e-12 and size >= last):
            break
        last = size
    x /= np.sqrt((x * x).sum(axis=0))
    values = (x * _product(a, x)).sum(axis=0)
    order = np.argsort(-values, kind="stable")
    return (values[order] * scale).astype(np.float64), x[:, order].astype(np.float64)


@dataclass
class Whitening:
    """Fitted on ``n`` vectors: exact sums per dimension, components as columns, their eigenvalues and shares."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n; the numerator n x - S is exact wherever 64 bits hold it."""
        return _centred(x, self.n, self.sums)

    def project(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)


def _shifted(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """n x - S, in 64 bits where they suffice, otherwise as Python's whole numbers."""
    least, most = int(x.min()), int(x.max())
    room = n * max(abs(least), abs(most)) + max(abs(int(s)) for s in sums)
    return x * n - sums.astype(np.int64) if room < 1 << 62 else x.astype(object) * n - sums


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    shifted = _shifted(x, n, sums)
    return (shifted / n).astype(np.float64)


def _deviation(x: np.ndarray, n: int, sums: np.ndarray) -> list[int]:
    shifted = _shifted(x, n, sums)
    most = max(abs(int(shifted.min())), abs(int(shifted.max())))
    if most * most * x.shape[1] >= 1 << 62:
        shifted = shifted.astype(object)
    return [int(v) for v in (shifted * shifted).sum(axis=1)]


def usable(numbers: DataFrame) -> tuple[DataFrame, int, int]:
    """(vectors of the most frequent length, their number, their length)."""
    sizes = numbers.groupBy(F.size("x").alias("dim")).agg(F.count("*").alias("n"))
    found = sizes.orderBy(F.desc("n"), F.desc("dim")).first()
    if found is None:
        return numbers, 0, 0
    return numbers.filter(F.size("x") == found.dim), found.n, found.dim


def fit(numbers: DataFrame, n: int, components: int = COMPONENTS) -> Whitening | None:
    """The whitening of vectors of one length; None without a direction of variance."""
    sums = summed(numbers, "x", _exact_sums, whole=True)[0]
    sums = np.array([int(s) for s in sums], dtype=object)

    def products(x: np.ndarray) -> np.ndarray:
        centred = _centred(x, n, sums)
        return centred.T @ centred

    covariance = summed(numbers, "x", products) / n
    values, vectors = eigenvectors((covariance + covariance.T) / 2)
    floor = len(values) * np.finfo(float).eps * max(values[0], 0)
    kept = int(min(components, np.count_nonzero(values > max(floor, 0))))
    if not kept:
        return None
    return Whitening(n, sums, vectors[:, :kept], values[:kept], values[:kept] / np.trace(covariance))


def _projected(numbers: DataFrame, model: Whitening) -> DataFrame:
    """(vec_id, deviation, w): exact deviation and whitened components."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            x = matrix(batch.column(1))
            w = model.project(x)
            offsets = np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]
            deviation = pa.array(_deviation(x, model.n, model.sums), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), deviation, pa.ListArray.from_arrays(offsets, pa.array(w.ravel()))],
                names=["vec_id", "deviation", "w"],
            )

    kind = numbers.schema["vec_id"].dataType.simpleString()
    return numbers.select("vec_id", "x").mapInArrow(run, f"vec_id {kind}, deviation long, w array<double>")


def identity_error(projected: DataFrame, n: int) -> float:
    """Largest entry of the covariance of ``w`` minus the identity."""
    mean = summed(projected, "w", lambda w: w.sum(axis=0)[None, :])[0] / n

    def products(w: np.ndarray) -> np.ndarray:
        return (w - mean).T @ (w - mean)

    covariance = summed(projected, "w", products) / n
    return float(np.abs(covariance - np.eye(len(covariance))).max())


def whiten(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per vector and component: (vec_id, component, n, deviation, whitened, explained, identity_error)."""
    numbers, n, _ = usable(written(whole_numbers(vectors, id_col, vector_col)))
    model = fit(numbers, n, components) if n else None
    if model is None:
        empty = numbers.filter(F.lit(False)).select("vec_id")
        names = [(c.split()[0], c.split()[1]) for c in RESULT.split(", ")[1:]]
        return empty.select("vec_id", *[F.lit(None).cast(kind).alias(name) for name, kind in names])
    projected = written(_projected(numbers, model))
    error = identity_error(projected, n)
    shares = F.array(*[F.lit(float(v)) for v in model.explained])
    return projected.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened")).select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("place")].alias("explained"), F.lit(error).alias("identity_error"),
    )
