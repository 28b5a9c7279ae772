"""Prefix scans over sorted range partitions.

Rows are sorted once, by range partitions of (keys, order): one exchange.  Each
task folds its rows key by key as they come and writes them with what the rows
before them in the task amount to.  A key may reach over any number of
partitions, but only the first key of a partition can have begun in an earlier
one; so what is still missing is one number per partition.  Those come from the
last and first rows of the partitions, one row each on the driver, however many
rows or keys there are, and are added where the rows are read.

No bucket width is chosen: a key with any number of rows in any stretch of the
order is cut where its rows are.  Only rows equal in all of (keys, order) stay
together, so ``order`` should tell rows apart.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from wavelark.session import materialise

#: What an empty prefix amounts to; None is null.
FOLDS = {"sum": 0, "max": None, "last": None, "first": None}


def _starts(columns: list, before: tuple | None) -> np.ndarray:
    """Where a key differs from the row before it; ``before`` is the key ahead of the batch."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n = len(columns[0])
    new = np.zeros(n, dtype=bool)
    for i, column in enumerate(columns):
        ahead = pa.array([None if before is None else before[i]], column.type)
        shifted = pa.concat_arrays([ahead, column.slice(0, n - 1)])
        both_null = pc.and_(pc.is_null(column), pc.is_null(shifted))
        differs = pc.fill_null(pc.not_equal(column, shifted), True)
        new |= pc.and_not(differs, both_null).to_numpy(zero_copy_only=False)
    if before is None:
        new[0] = True
    return new


def _fold(how: str, values: np.ndarray, known: np.ndarray, new: np.ndarray, carry) -> tuple[np.ndarray, np.ndarray, object]:
    """(value before each row, whether there is one, carry after the last row).

    ``carry`` is (value, known) of the key that goes on from the batch before.
    """
    n = len(values)
    begin = np.flatnonzero(new)
    group = np.cumsum(new) - (0 if n and new[0] else 0)
    first = np.zeros(n, dtype=np.int64)
    first[begin] = begin
    first = np.maximum.accumulate(first)  # first row of each row's key in this batch
    goes_on = group == 0  # rows of the key carried in
    if how == "sum":
        total = np.cumsum(np.where(known, values, 0))
        before = np.concatenate([[0], total[:-1]])
        base = before[first]
        out = before - base
        out[goes_on] = before[goes_on] + carry[0]
        last = out[-1] + (values[-1] if known[-1] else 0)
        return out, np.ones(n, dtype=bool), (last, True)
    shifted, there = np.empty_like(values), np.zeros(n, dtype=bool)
    shifted[1:], there[1:] = values[:-1], known[:-1]
    if how == "last":
        shifted[0], there[0] = carry
        there[new] = False
        return shifted, there, (values[-1], known[-1])
    if how == "first":
        out, has = values[first].copy(), known[first].copy()
        if goes_on.any() and carry[2]:
            out[goes_on], has[goes_on] = carry[0], carry[1]
        has_before = ~new
        seen = bool(goes_on[-1] and carry[2])
        end = (out[-1], has[-1], True) if (has_before[-1] or seen) else (values[-1], known[-1], True)
        return out, has & has_before, end
    # Running maxima: keys apart by sorting places of (key, value) would cost more than a loop over keys.
    out, has = np.empty_like(values), np.zeros(n, dtype=bool)
    edges = [*([0] if not len(begin) or begin[0] else []), *begin, n]
    low = -np.inf if values.dtype.kind == "f" else np.iinfo(values.dtype).min
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        top = np.maximum.accumulate(np.where(known[a:b], values[a:b], low))
        some = np.maximum.accumulate(known[a:b])
        start = carry if not new[a] else (low, False)
        out[a], has[a] = (start[0] if start[1] else low), start[1]
        out[a + 1 : b], has[a + 1 : b] = np.maximum(top[:-1], out[a]), some[:-1] | has[a]
        end = (max(top[-1], out[a]), bool(some[-1] or has[a]))
    return out, has, end


def _none(how: str, dtype) -> tuple:
    return (dtype.type(0), how == "sum", False) if how == "first" else (dtype.type(0), how == "sum")


def _local(keys: list[str], folds: list[tuple[str, str]], names: list[str]):
    """Task code: rows with their prefix inside the task, its number, and whether their key is its first."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        key, opening, carry, done = None, True, {}, 0
        batch, rest = next(batches, None), batches
        while batch is not None:
            # The batch after is looked for first, as the task's last row says what its key amounts to.
            following = next((b for b in rest if b.num_rows), None)
            n = batch.num_rows
            if n == 0:
                batch = following
                continue
            column = {name: batch.column(i) for i, name in enumerate(batch.schema.names)}
            own = [column[k] for k in keys]
            new = _starts(own, key) if own else np.array([done == 0] + [False] * (n - 1))
            later = np.cumsum(new) > (1 if done == 0 else 0)
            head = ~later if opening else np.zeros(n, dtype=bool)
            opening = bool(head[-1])
            key = tuple(c[n - 1].as_py() for c in own)
            added = []
            for name, how in folds:
                source = column[f"_v_{name}"]
                known = source.is_valid().to_numpy(zero_copy_only=False)
                values = source.fill_null(0).to_numpy(zero_copy_only=False)
                start = carry.get(name, _none(how, values.dtype))
                out, has, carry[name] = _fold(how, values, known, new, start)
                added += [pa.array(out, source.type, mask=~has)]
            end = np.zeros(n, dtype=bool)
            end[-1] = following is None
            after = []
            for name, _ in folds:
                value, there = carry[name][:2]
                after.append(pa.array([None] * (n - 1) + [value if there else None], column[f"_v_{name}"].type))
            place = pa.array(np.arange(done, done + n, dtype=np.int64))
            done += n
            arrays = [*batch.columns, *added, *after, pa.array(np.full(n, task, dtype=np.int32)), place, pa.array(head), pa.array(end)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)
            batch = following

    return run


def _joined(how: str, earlier, here):
    """What two stretches amount to, the earlier one first."""
    if how == "sum":
        return (earlier or 0) + (here or 0)
    if how == "max":
        known = [v for v in (earlier, here) if v is not None]
        return max(known) if known else None
    return here if how == "last" else earlier


def prefix(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], totals: Mapping[str, tuple[str, Column]]
) -> DataFrame:
    """Add what all rows of the key *before* the current one amount to.

    ``totals`` names new columns as (fold, value) with folds ``sum`` (0 at the
    start), ``max``, ``last`` and ``first`` (null at the start); values are whole
    numbers or doubles.  Null values add nothing to a sum or a maximum.  Names
    that begin with ``_scan_`` are the scan's own.
    """
    keys, order, names = list(keys), list(order), list(totals)
    folds = [(name, totals[name][0]) for name in names]
    rows = df.select("*", *[totals[n][1].alias(f"_v_{n}") for n in names])
    spread = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    value = {n: rows.schema[f"_v_{n}"].dataType.simpleString() for n in names}
    more = [f"`_l_{n}` {value[n]}" for n in names] + [f"`_a_{n}` {value[n]}" for n in names]
    more += ["_scan_part int", "_scan_place long", "_scan_head boolean", "_scan_end boolean"]
    schema = StructType([*rows.schema, *StructType.fromDDL(", ".join(more))])
    placed = materialise(spread.mapInArrow(_local(keys, folds, schema.names), schema))

    # A first and a last row per partition reach the driver.
    ends = placed.filter((F.col("_scan_place") == 0) | F.col("_scan_end")).select(
        *keys, *[f"_a_{n}" for n in names], "_scan_part", "_scan_place", "_scan_head", "_scan_end"
    )
    offsets, behind, total = [], None, {}
    for row in sorted(ends.collect(), key=lambda r: (r._scan_part, r._scan_place)):
        key = tuple(row[k] for k in keys)
        if row._scan_place == 0:
            carried = total if behind == key else {n: FOLDS[how] for n, how in folds}
            goes_on = behind == key
            offsets.append((row._scan_part, *[carried[n] for n in names], goes_on))
        if row._scan_end:
            own = {n: row[f"_a_{n}"] for n in names}
            # A partition of a single key passes on what came into it.
            through = row._scan_head and goes_on
            total = {n: _joined(how, carried[n], own[n]) for n, how in folds} if through else own
            behind = key
    import pyarrow as pa

    types = [pa.int32(), *[pa.float64() if value[n] == "double" else pa.int64() for n in names], pa.bool_()]
    columns = zip(*offsets, strict=True) if offsets else [[] for _ in types]
    arrays = [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)]
    carried = df.sparkSession.createDataFrame(pa.table(arrays, names=["_scan_part", *[f"_o_{n}" for n in names], "_scan_on"]))
    joined = placed.join(F.broadcast(carried), "_scan_part", "left")  # a row per partition
    into = F.col("_scan_head") & F.col("_scan_on")

    def whole(name: str, how: str) -> Column:
        here, earlier = F.col(f"_l_{name}"), F.col(f"_o_{name}")
        at_start = into & (F.col("_scan_place") == 0)
        if how == "sum":
            return F.when(into, here + earlier).otherwise(here)
        if how == "max":
            return F.when(into, F.greatest(here, earlier)).otherwise(here)
        if how == "first":
            return F.when(into, earlier).otherwise(here)
        return F.when(at_start, earlier).otherwise(here)

    return joined.select(*df.columns, *[whole(n, how).cast(value[n]).alias(n) for n, how in folds])


def index(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "idx") -> DataFrame:
    """Number rows 0, 1, … per key along ``order``."""
    return prefix(df, keys, order, {name: ("sum", F.lit(1).cast("long"))})
