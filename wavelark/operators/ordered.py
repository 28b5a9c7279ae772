"""Ordered computations that stay parallel inside one large group.

A plain ``Window.partitionBy(recording_id)`` puts a whole recording into one
task.  Here every ordered computation is cut into buckets along the order: the
window runs per (key, bucket) and only bucket totals, a few rows per key, are
ordered per key.  One recording holding a third of all rows is then spread over
as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.session import materialise

BLOCK = 65536


def running(
    df: DataFrame,
    keys: Sequence[str],
    bucket: Column,
    order: Sequence[str],
    totals: Mapping[str, Column],
    how: str = "sum",
    write: bool = False,
) -> DataFrame:
    """Add what all rows *before* the current one amount to.

    ``how``: ``"sum"`` (starts at 0), ``"max"`` or ``"last"`` (start at null).
    ``bucket`` must be non-decreasing along ``order``; rows of one (key,
    bucket) should fit a task.  The input is read twice; ``write=True`` writes
    it to the shared folder first, for rows that are few but costly to make.
    """
    keys, order, names = list(keys), list(order), list(totals)
    rows = df.withColumn("_bucket", bucket)
    for name, value in totals.items():
        rows = rows.withColumn(f"_v_{name}", value)
    if write:
        rows = materialise(rows)
    ordered = Window.partitionBy(*keys, "_bucket").orderBy(*order)
    buckets = Window.partitionBy(*keys).orderBy("_bucket")
    before = (Window.unboundedPreceding, -1)
    if how == "last":
        local = lambda n: F.lag(f"_v_{n}").over(ordered)
        total = lambda n: F.max_by(f"_v_{n}", F.struct(*order))
        earlier = lambda n: F.lag(f"_t_{n}").over(buckets)
        combine = lambda n: F.coalesce(f"_l_{n}", f"_o_{n}")
    else:
        fold = {"sum": F.sum, "max": F.max}[how]
        local = lambda n: fold(f"_v_{n}").over(ordered.rowsBetween(*before))
        total = lambda n: fold(f"_v_{n}")
        earlier = lambda n: fold(f"_t_{n}").over(buckets.rowsBetween(*before))
        if how == "max":
            combine = lambda n: F.greatest(f"_l_{n}", f"_o_{n}")
        else:
            zero = F.lit(0)
            combine = lambda n: F.coalesce(F.col(f"_l_{n}"), zero) + F.coalesce(F.col(f"_o_{n}"), zero)
    per_bucket = rows.groupBy(*keys, "_bucket").agg(*[total(n).alias(f"_t_{n}") for n in names])
    offsets = per_bucket.select(*keys, "_bucket", *[earlier(n).alias(f"_o_{n}") for n in names])
    numbered = rows.select("*", *[local(n).alias(f"_l_{n}") for n in names])
    joined = numbered.join(offsets, [*keys, "_bucket"])
    return joined.select(*df.columns, *[combine(n).alias(n) for n in names])


def row_index(
    df: DataFrame, keys: Sequence[str], bucket: Column, order: Sequence[str], name: str = "idx"
) -> DataFrame:
    """Number rows 0, 1, … per key in ``order``."""
    return running(df, keys, bucket, order, {name: F.lit(1).cast("long")})


def previous(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    columns: Mapping[str, str],
    block: int = BLOCK,
) -> DataFrame:
    """``lag`` by one along a gap-free index, one block of rows per task.

    The last row of every block is also sent to the next block, where it serves
    as predecessor and is then dropped.
    """
    home = F.floor(F.col(idx) / block)
    edge = F.col(idx) % block == block - 1
    rows = df.withColumn(
        "_block", F.explode(F.when(edge, F.array(home, home + 1)).otherwise(F.array(home)))
    )
    within = Window.partitionBy(*keys, "_block").orderBy(idx)
    lagged = rows.select(
        "*", *[F.lag(source).over(within).alias(new) for new, source in columns.items()]
    )
    return lagged.filter(F.col("_block") == home).drop("_block")


def value_bucket(value: Column, steps: int = 1 << 14) -> Column:
    """Order-keeping coarse key of a double: ``steps`` buckets per octave.

    As many that values crowded into a tenth of an octave still fall into more
    than a thousand buckets.
    The offset exceeds the 1075 octaves below 1 that doubles have.
    """
    size = F.floor(F.log2(F.abs(value)) * steps) + F.lit(1 << 25)
    return (
        F.when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0)).cast("long")
    )


def distinct_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values per key with their number of rows ``n``.

    Equal values collapse before any shuffle, so copies cost nothing.
    """
    return df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))


def counted(distinct: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Add ``below``: rows with smaller values, to the result of ``distinct_counts``."""
    return running(distinct, keys, value_bucket(F.col(value)), [value], {"below": F.col("n")})


#: Rows of a key whose quantile one aggregate may hold; values of more are bracketed first.
FEW = 100_000
#: A quantile sketch of this accuracy errs by at most a rank in this many.
ACCURACY = 2000


def _inside(rows: DataFrame, keys: list[str], value: str, brackets: DataFrame) -> DataFrame:
    joined = rows.join(brackets, keys)
    return joined.filter((F.col(value) >= F.col("low")) & (F.col(value) <= F.col("high")))


def _narrowed(rows: DataFrame, keys: list[str], value: str, brackets: DataFrame) -> DataFrame:
    """Brackets cut down by a sketch of the values inside, and checked by counting.

    ``brackets``: keys, first and second (places sought, from 0, among all rows
    of the key), low and high (values that hold both places between them), below
    (rows less than low), n (rows from low to high).
    """
    grid = F.array(*[F.lit(i / ACCURACY) for i in range(ACCURACY + 1)])
    sketched = _inside(rows, keys, value, brackets).groupBy(*keys).agg(
        F.approx_percentile(value, grid, F.lit(10 * ACCURACY)).alias("_grid")
    )
    # The sketch errs by a tenth of a step of the grid: a step more on each side holds the places.
    left = F.floor((F.col("first") - F.col("below")) / F.col("n") * ACCURACY) - 1
    right = F.ceil((F.col("second") - F.col("below") + 1) / F.col("n") * ACCURACY) + 1
    cut = brackets.join(sketched, keys).select(
        *keys, "first", "second", F.col("low").alias("_low"), F.col("high").alias("_high"),
        F.when(left > 0, F.get("_grid", left.cast("int"))).otherwise(F.col("low")).alias("low"),
        F.when(right < ACCURACY, F.get("_grid", right.cast("int"))).otherwise(F.col("high")).alias("high"),
        F.col("below").alias("_below"), F.col("n").alias("_n"),
    )
    at = F.col(value)
    counted = rows.join(cut, keys).groupBy(*keys, "first", "second", "low", "high", "_low", "_high", "_below", "_n").agg(
        F.count_if(at < F.col("low")).alias("below"),
        F.count_if((at >= F.col("low")) & (at <= F.col("high"))).alias("n"),
    )
    holds = (F.col("below") <= F.col("first")) & (F.col("below") + F.col("n") > F.col("second"))
    return materialise(
        counted.select(*keys, "first", "second", *[F.when(holds, F.col(c)).otherwise(F.col(f"_{c}")).alias(c) for c in ("low", "high", "below", "n")])
    )


#: Each round cuts the rows inside a bracket by hundreds; ties may keep them.
ROUNDS = 6


def _sought(rows: DataFrame, keys: list[str], value: str, brackets: DataFrame) -> DataFrame:
    """(keys, _low, _high): the values at both places sought, for keys with many rows."""
    for _ in range(ROUNDS):
        brackets = _narrowed(rows, keys, value, brackets)
        if brackets.filter((F.col("n") > FEW) & (F.col("low") < F.col("high"))).limit(1).count() == 0:
            break
    # Equal values count once, before anything is ordered.
    inside = _inside(rows, keys, value, brackets)
    distinct = inside.groupBy(*keys, "first", "second", "below", value).agg(F.count(F.lit(1)).alias("_own"))
    upto = F.col("below") + F.sum("_own").over(Window.partitionBy(*keys).orderBy(value))
    ranked = distinct.withColumn("_upto", upto)
    at = lambda place: F.min(F.when(F.col("_upto") > F.col(place), F.col(value)))
    return ranked.groupBy(*keys).agg(at("first").alias("_low"), at("second").alias("_high"))


def exact_quantile(
    df: DataFrame, keys: Sequence[str], value: str, q: float, name: str = "quantile"
) -> DataFrame:
    """Exact quantile with linear interpolation, one row per key.

    Keys of at most ``FEW`` rows take one aggregate.  For the others a mergeable
    sketch, aggregated before the shuffle, brackets the two places the quantile
    lies between; a pass counts the rows below, and only rows inside the bracket
    are ordered.  Nothing orders all values of a large key.
    """
    named = list(keys)
    keys = named or ["_all"]
    rows = df.filter(F.col(value).isNotNull()).select(*named, F.col(value).cast("double").alias(value), F.lit(0).alias("_all"))
    rows = rows.select(*keys, value)
    few = lambda table: table.groupBy(*keys).agg(F.percentile(value, F.lit(float(q))).alias(name))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("low"), F.max(value).alias("high"))
    large = sizes.filter(F.col("_n") > FEW)
    if large.limit(1).count() == 0:
        return few(rows).select(*named, name)
    place = F.lit(float(q)) * (F.col("_n") - 1)
    large = materialise(
        large.select(
            *keys, F.floor(place).alias("first"), F.ceil(place).alias("second"), (place - F.floor(place)).alias("_share"),
            "low", "high", F.lit(0).cast("long").alias("below"), F.col("_n").alias("n"),
        )
    )
    found = _sought(rows, keys, value, large.drop("_share")).join(large.select(*keys, "_share"), keys)
    many = found.select(*keys, (F.col("_low") + (F.col("_high") - F.col("_low")) * F.col("_share")).alias(name))
    rest = rows.join(large.select(*keys), keys, "left_anti")
    return few(rest).unionByName(many).select(*named, name)


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], k: int, spread: str, name: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key with their rank 1…k.

    Every key is first cut down inside 256 salted parts, so at most ``256*k``
    rows of one key meet in a task.
    """
    part = F.pmod(F.xxhash64(spread), F.lit(256))
    partial = Window.partitionBy(*keys, "_part").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    cut = df.withColumn("_part", part).withColumn("_rank", F.row_number().over(partial))
    cut = cut.filter(F.col("_rank") <= k).drop("_part", "_rank")
    return cut.withColumn(name, F.row_number().over(final)).filter(F.col(name) <= k)
