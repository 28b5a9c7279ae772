"""Blocks of consecutive STFT frames, and sums of arrays across blocks.

A block carries the samples of ``per_block`` frames, so spectra are made where
they are used and never travel: cutting blocks is a map over signal chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.operators.framing import frames
from wavelark.operators.ordered import running
from wavelark.session import materialise

KEY = ["recording_id", "channel"]
PER_BLOCK = 64


def n_frames(n_total: Column | str = "n_total", hop: int = 512) -> Column:
    n_total = F.col(n_total) if isinstance(n_total, str) else n_total
    return F.floor(n_total / hop) + 1


def stft_blocks(
    signals: DataFrame, n_fft: int, hop: int, before: int = 0, after: int = 0,
    per_block: int = PER_BLOCK, keep: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``per_block`` centred frames with ``before``/``after`` neighbours.

    Column ``block`` numbers them; the first own frame is ``block * per_block``.
    """
    cut = frames(
        signals,
        (per_block - 1 + before + after) * hop + n_fft,
        per_block * hop,
        F.ceil(n_frames(hop=hop) / per_block),
        n_fft // 2 + before * hop,
        keep,
    )
    return cut.withColumnRenamed("frame_idx", "block")


def sum_arrays(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Element-wise sums of equally long arrays per key."""
    rows = df.select(*keys, F.posexplode(F.arrays_zip(*columns)).alias("_pos", "_v"))
    sums = rows.groupBy(*keys, "_pos").agg(*[F.sum(f"_v.{c}").alias(c) for c in columns])
    return gather(sums, keys, columns)


def gather(rows: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Rows (key, _pos, values) back to arrays; as long as the arrays were."""
    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_pos", *columns))).alias("_all"))
    return packed.select(*keys, *[F.col(f"_all.{c}").alias(c) for c in columns])


def prefix_arrays(df: DataFrame, keys: Sequence[str], order: str, column: str) -> DataFrame:
    """Element-wise sum of all earlier rows' arrays, per key along ``order``.

    The arrays, small next to the audio they come from, are written once.
    """
    rows = materialise(df).select(*keys, order, F.posexplode(column).alias("_pos", "_x"))
    bucket = F.floor(F.col(order) / 4096)
    before = running(rows, [*keys, "_pos"], bucket, [order], {column: F.col("_x")})
    return gather(before, [*keys, order], [column])
