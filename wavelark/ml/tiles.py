"""Compare two tables tile by tile inside matching cells.

Every cell is cut into tiles of bounded size on both sides, so a cell holding a
third of the data becomes many tasks.  Tiles grow with the work until there are
about ``GROUPS`` of them, up to ``LARGEST`` rows a side, so that the copies of a
row that are shuffled don't grow with the table; a tile is then compared block by
block.  A tile function sees the rows of both sides as arrays and returns per-row
results, never pairs.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a side of a block compared at once; tiles aimed at; rows a side of the largest tile.
SIDE, GROUPS, LARGEST = 4096, 128, 1 << 17


def _sides(df: DataFrame, counts: DataFrame, other: DataFrame, mine: str, theirs: str, key: str) -> DataFrame:
    """Add this side's tile number and copy the row to each tile of the other side."""
    rows = df.join(counts, "cell").join(other, "cell")
    part = F.pmod(F.xxhash64(key, F.lit(7)), F.col(f"_n_{mine}")).cast("int")
    return (
        rows.withColumn(f"_{mine}", part)
        .withColumn(f"_{theirs}", F.explode(F.sequence(F.lit(0), F.col(f"_n_{theirs}").cast("int") - 1)))
        .drop(f"_n_{mine}", f"_n_{theirs}")
    )


def compare(
    left: DataFrame, right: DataFrame, run: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str,
    key: str = "recording_id", side: int = SIDE, *, merge: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
) -> DataFrame:
    """Apply ``run(left_rows, right_rows)`` to every block of every tile of every shared cell.

    Both tables have a ``cell``.  ``run`` must return a frame matching
    ``schema``; results of several blocks are combined by the caller.  ``merge``
    may combine those of some left rows within a tile beforehand.
    """

    def sizes(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("cell").agg(F.count(F.lit(1)).alias(f"_n_{name}"))

    def parts(counted: DataFrame, name: str) -> DataFrame:
        return counted.withColumn(f"_n_{name}", F.ceil(F.col(f"_n_{name}") / extent).cast("long"))

    in_left, in_right = sizes(left, "l"), sizes(right, "r")
    pairs = in_left.join(in_right, "cell").agg(F.sum(F.col("_n_l").cast("double") * F.col("_n_r")).alias("n")).first()["n"]
    extent = int(max(side, min(LARGEST, ((pairs or 0) / GROUPS) ** 0.5)))
    in_left, in_right = parts(in_left, "l"), parts(in_right, "r")
    a = _sides(left, in_left, in_right, "l", "r", key)
    b = _sides(right, in_right, in_left, "r", "l", key)
    b = b.select(*[F.col(c).alias(c) for c in b.columns])  # own identity, should both sides share a table
    keys = ["cell", "_l", "_r"]

    def blocks(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if len(a) <= side and len(b) <= side:
            return run(a, b)
        cut = lambda df: [df.iloc[at : at + side].reset_index(drop=True) for at in range(0, len(df), side)] or [df]
        found, right_blocks = [], cut(b)
        for x in cut(a):
            own = pd.concat([run(x, y) for y in right_blocks], ignore_index=True)
            found.append(own if merge is None else merge(own))
        return pd.concat(found, ignore_index=True)

    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInPandas(blocks, schema)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances between the rows of two matrices."""
    square = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0.0))


def exact_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, a row of ``b`` at a time: no cancellation."""
    return np.stack([np.sqrt(((a - row) ** 2).sum(axis=1)) for row in b], axis=1)


def squares_with_error(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances by the fast formula, and for each row of ``a`` how far off they may be.

    Both matrices are moved to the middle of ``b`` first, which keeps the terms
    that cancel small.
    """
    middle = b.mean(axis=0)
    a, b = a - middle, b - middle
    one, other = (a**2).sum(axis=1), (b**2).sum(axis=1)
    error = 8 * np.finfo(float).eps * (a.shape[1] + 4) * (one + other.max(initial=0.0))
    return one[:, None] + other[None, :] - 2 * (a @ b.T), error


def pair_distances(a: np.ndarray, b: np.ndarray, rows: np.ndarray, columns: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Distances of the given pairs by differences, some pairs at a time."""
    out = np.empty(len(rows))
    for at in range(0, len(rows), step):
        part = slice(at, at + step)
        out[part] = np.sqrt(((a[rows[part]] - b[columns[part]]) ** 2).sum(axis=1))
    return out


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list()).astype(np.float64)
