"""Embedding near-dedup with an inverted multi-index.

Equal vectors of a label are one class.  Each half of the unit vectors has its
own codebook, so pairs of codes form a product grid; every class is indexed in
the cell of its two nearest codes.  A query walks the grid in the order of its
distance to the cells (multi-sequence traversal over the two sorted code
lists) and stops ``margin`` behind the nearest one.  The margin is the least
with which calibration pairs, sample vectors and random ones at exactly the
threshold from them, are found from either side with the target recall; pairs
above the threshold are found more often.  Found cells are compared in double
precision.

Codebooks and margin come from at most ``SAMPLE`` classes, those with the
smallest hash; every class is indexed.  The number of codes follows the number
of classes.

Cells are cut into tiles of about ``TILE`` index and query rows, so that no
task holds a whole cell.  A tile gives one row per vector with links: how many,
and one vector it is connected to; pairs are never rows.

Defined results: a vector that is null, empty, zero, or holds null or
non-finite components, or has no label, links with nothing, stays and is its own
component; vectors of different lengths don't link; equal vectors of a label
link; repeated rows are vectors of their own; a null id is a component's id only
if it has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavelark.llm.components import components
from wavelark.llm.tables import written

COSINE, RECALL = 0.93, 0.995
#: Classes that codebooks and margin are fitted on; most codes of a half.
SAMPLE, CODES = 16_384, 512
ROUNDS, SEED = 12, 7
TILE = 1024


def _distances(part: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Squared distances of rows to codes."""
    return np.maximum((part**2).sum(1)[:, None] - 2 * part @ codes.T + (codes**2).sum(1), 0)


def _codebook(part: np.ndarray, n: int, rng: np.random.Generator) -> np.ndarray:
    """Lloyd's k-means; empty codes keep their place."""
    codes = part[rng.choice(len(part), min(n, len(part)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = _distances(part, codes).argmin(1)
        total = np.zeros_like(codes)
        np.add.at(total, near, part)
        count = np.bincount(near, minlength=len(codes))
        codes[count > 0] = total[count > 0] / count[count > 0, None]
    return codes


class Grid:
    """Codebooks of both halves and the margin, for vectors of one length."""

    def __init__(self, first: np.ndarray, second: np.ndarray, margin: float):
        self.first, self.second, self.margin = first, second, margin

    def halves(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        half = unit.shape[1] // 2
        return _distances(unit[:, :half], self.first), _distances(unit[:, half:], self.second)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        one, other = self.halves(unit)
        return one.argmin(1) * len(self.second) + other.argmin(1)

    def visited(self, unit: np.ndarray) -> list[list[int]]:
        """Cells of each row in the order of the traversal."""
        return [self._walk(a, b) for a, b in zip(*self.halves(unit), strict=True)]

    def _walk(self, one: np.ndarray, other: np.ndarray) -> list[int]:
        order, across = np.argsort(one, kind="stable"), np.argsort(other, kind="stable")
        one, other = one[order], other[across]
        stop = one[0] + other[0] + self.margin
        heap, found = [(one[0] + other[0], 0, 0)], []
        while heap and heap[0][0] <= stop:
            _, i, j = heapq.heappop(heap)
            found.append(int(order[i]) * len(self.second) + int(across[j]))
            if j + 1 < len(other):
                heapq.heappush(heap, (one[i] + other[j + 1], i, j + 1))
            if j == 0 and i + 1 < len(one):
                heapq.heappush(heap, (one[i + 1] + other[0], i + 1, 0))
        return found


def fit_grid(unit: np.ndarray, codes: int, cosine: float = COSINE, recall: float = RECALL) -> Grid:
    """Codebooks and margin from sample rows of unit length."""
    rng = np.random.default_rng(SEED)
    half = unit.shape[1] // 2
    grid = Grid(_codebook(unit[:, :half], codes, rng), _codebook(unit[:, half:], codes, rng), 0.0)
    pick = unit[rng.choice(len(unit), min(len(unit), 4096), replace=False)]
    away = rng.normal(size=pick.shape)
    away -= (away * pick).sum(1, keepdims=True) * pick
    length = np.linalg.norm(away, axis=1, keepdims=True)
    near = cosine * pick + np.sqrt(1 - cosine**2) * away / np.maximum(length, 1e-300)
    mine, theirs = grid.halves(pick), grid.halves(near)

    def behind(d, to):
        return sum(a[np.arange(len(a)), b.argmin(1)] - a.min(1) for a, b in zip(d, to, strict=True))

    needed = np.minimum(behind(mine, theirs), behind(theirs, mine))
    grid.margin = float(np.quantile(needed, recall, method="higher"))
    return grid


def _usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link with another."""
    wild = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(vector, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & vector.isNotNull() & ~wild & some, F.lit(False))


def _matrix(column) -> np.ndarray:
    """Rows of a list column whose lists are equally long."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _unit(rows: np.ndarray) -> np.ndarray:
    """Rows divided by their length, after their largest value, so that no square under- or overflows."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _grids(classes: DataFrame, cosine: float, recall: float) -> dict[int, Grid]:
    """A grid for each vector length in the sample."""
    n = classes.count()
    codes = int(min(CODES, max(4, n**0.5 / 6)))
    sample = classes.select("dim", "vector").orderBy(F.xxhash64("vector")).limit(SAMPLE).toArrow().combine_chunks()
    grids = {}
    for dim in sample.column("dim").unique().to_pylist():
        rows = sample.filter([d == dim for d in sample.column("dim").to_pylist()]).column("vector").combine_chunks()
        grids[dim] = fit_grid(_unit(_matrix(rows)), codes, cosine, recall)
    return grids


def _located(classes: DataFrame, grids: dict[int, Grid]) -> DataFrame:
    """Classes with their cell and the cells they visit; lengths outside the sample have one cell."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            dims = np.asarray(batch.column(batch.schema.get_field_index("dim")))
            vectors = batch.column(batch.schema.get_field_index("vector"))
            cell, visited = np.zeros(len(dims), dtype=np.int32), [[0]] * len(dims)
            for dim in np.unique(dims):
                if int(dim) in grids:
                    at = np.flatnonzero(dims == dim)
                    unit = _unit(_matrix(vectors.take(pa.array(at))))
                    cell[at] = grids[int(dim)].cells(unit)
                    for i, cells in zip(at, grids[int(dim)].visited(unit), strict=True):
                        visited[i] = cells
            arrays = [*batch.columns, pa.array(cell), pa.array(visited, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, "cell", "visited"])

    return classes.mapInArrow(run, StructType([*classes.schema, *StructType.fromDDL("cell int, visited array<int>")]))


KEY = ["label", "dim", "cell"]


def _tiles(located: DataFrame) -> DataFrame:
    """Index and query rows of every tile."""
    sides = located.select(*KEY, F.lit(1).alias("own"), F.lit(0).alias("asks")).union(
        located.select("label", "dim", F.explode("visited"), F.lit(0), F.lit(1))
    )
    sizes = (
        sides.groupBy(*KEY).agg(F.sum("own").alias("own"), F.sum("asks").alias("asks"))
        .filter("own > 0 and asks > 0")
        .select(*KEY, F.ceil(F.col("own") / TILE).alias("rows"), F.ceil(F.col("asks") / TILE).alias("columns"))
    )
    row, column = (F.pmod(F.xxhash64("cid"), F.col(c)) for c in ("rows", "columns"))
    every = lambda c: F.explode(F.sequence(F.lit(0).cast("long"), F.col(c) - 1))
    body = ("cid", "n", "vector", "home", "visited")
    index = located.withColumn("home", F.col("cell")).join(sizes, KEY)
    asked = located.select(
        "label", "dim", F.col("cell").alias("home"), "cid", "n", "vector", F.array().cast("array<int>").alias("seen"),
        F.explode("visited").alias("cell"),
    ).withColumnRenamed("seen", "visited").join(sizes, KEY)
    return index.select(*KEY, row.alias("r"), every("columns").alias("c"), F.lit(True).alias("own"), *body).union(
        asked.select(*KEY, every("rows").alias("r"), column.alias("c"), F.lit(False).alias("own"), *body)
    )


def _connected(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least query row connected to each query and index row through hits."""
    far = hit.shape[0]
    rows = np.arange(far)
    while True:
        columns = np.where(hit, rows[:, None], far).min(axis=0)
        new = np.minimum(rows, np.where(hit, columns[None, :], far).min(axis=1))
        if (new == rows).all():
            return rows, columns
        rows = new


def _compare(cosine: float):
    def run(table):
        import pyarrow as pa

        own = np.asarray(table.column("own"))
        cid, n, home = (np.asarray(table.column(c)) for c in ("cid", "n", "home"))
        vectors = table.column("vector").combine_chunks()
        unit = _unit(_matrix(vectors))
        x, q = np.flatnonzero(own), np.flatnonzero(~own)
        hit = (unit[q] @ unit[x].T >= cosine) & (cid[q][:, None] != cid[x][None, :])
        # An index row that visits the query's own cell counts the pair there.
        homes, place = np.unique(home[q], return_inverse=True)
        visits = np.zeros((len(x), len(homes)), dtype=bool)
        seen = table.column("visited").combine_chunks().take(pa.array(x))
        flat, owner = np.asarray(seen.flatten()), np.repeat(np.arange(len(x)), np.diff(np.asarray(seen.offsets)))
        if len(homes) and len(flat):
            spot = np.minimum(np.searchsorted(homes, flat), len(homes) - 1)
            known = homes[spot] == flat
            visits[owner[known], spot[known]] = True
        once = hit & ~visits[:, place].T
        links = np.concatenate([hit @ n[x], n[q] @ once])
        rows, columns = _connected(hit) if hit.any() else (np.arange(len(q)), np.full(len(x), len(q)))
        lead = np.concatenate([cid[q][rows], cid[q][np.minimum(columns, len(q) - 1)] if len(q) else cid[x]])
        ids, linked = np.concatenate([cid[q], cid[x]]), np.concatenate([hit.any(axis=1), hit.any(axis=0)])
        out = {"cid": ids[linked], "links": links[linked].astype(np.int64), "lead": lead[linked]}
        return pa.table({k: pa.array(v) for k, v in out.items()})

    return run


def class_links(classes: DataFrame, cosine: float = COSINE, recall: float = RECALL) -> DataFrame:
    """(cid, links, lead): links found in one tile and a class connected through them.

    ``classes``: cid, label, dim, vector (array of double), n (vectors in the class).
    """
    located = written(_located(classes, _grids(classes, cosine, recall)))
    tiles = _tiles(located)
    return tiles.groupBy(*KEY, "r", "c").applyInArrow(_compare(cosine), "cid long, links long, lead long")


def embedding_dedup(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    cosine: float = COSINE, recall: float = RECALL,
) -> DataFrame:
    """One row per vector: (vec_id, n_links, component_id, kept)."""
    base = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("vector")
    )
    usable = _usable(F.col("vector"), F.col("label"))
    groups = base.filter(usable).groupBy("label", "vector").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    classes = written(
        groups.withColumn("dim", F.size("vector")).withColumn("cid", F.monotonically_increasing_id())
    )
    found = written(class_links(classes.select("cid", "label", "dim", "vector", "n"), cosine, recall))
    links = found.groupBy("cid").agg(F.sum("links").alias("links"))
    edges = found.filter("cid <> lead").select(F.greatest("cid", "lead").alias("a"), F.least("cid", "lead").alias("b"))
    parts = components(edges).withColumnRenamed("node", "cid")
    named = classes.join(parts, "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    first = named.groupBy("component").agg(F.min("least").alias("component_id"))
    marks = named.join(first, "component").join(links, "cid", "left").select(
        "label", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id",
        F.lit(True).alias("linked"),
    )
    joined = base.withColumn("usable", usable).join(marks.withColumn("usable", F.col("linked")), ["usable", "label", "vector"], "left")
    component = F.when(F.col("linked"), F.col("component_id")).otherwise(F.col("id"))
    return joined.select(
        F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
