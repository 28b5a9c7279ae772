"""Decoded sensor packets and what got lost between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.operators.scan import prefix

HEADER = 8


def decode_packets(packets: DataFrame, fmt: str = "int16", channels: int = 16, keep: tuple[str, ...] = ("sensor_id", "ts")) -> DataFrame:
    """Packets with ``seq``, ``n_samples`` and ``frames`` (frames × channels).

    Layout: two little-endian uint32 (sequence, sample count), then interleaved
    int16 or float32 samples.  Short packets and packets without one whole frame
    are dropped; an incomplete last frame is cut off.  Unsigned fields widen to
    long.
    """
    kinds = {"int16": ("<i2", 32768.0), "float32": ("<f4", 1.0)}
    if fmt not in kinds:
        raise ValueError(f"unknown sample format {fmt!r}")
    dtype, scale = kinds[fmt]

    def body(data: bytes) -> list | None:
        if data is None or len(data) < HEADER:
            return None
        raw = data[HEADER:]
        width = np.dtype(dtype).itemsize
        values = np.frombuffer(raw[: len(raw) // width * width], dtype=dtype) / scale
        n = len(values) // channels
        return values[: n * channels].reshape(n, channels).astype(np.float64).tolist() if n else None

    @F.pandas_udf("array<array<double>>")
    def frames(payload: pd.Series) -> pd.Series:
        return payload.map(body)

    rows = packets.filter(F.length("payload") >= HEADER)
    return rows.select(
        *keep, uint32("payload", 1).alias("seq"), uint32("payload", 5).alias("n_samples"),
        frames("payload").alias("frames"),
    ).filter(F.col("frames").isNotNull())


def uint32(payload: Column | str, at: int) -> Column:
    """Little-endian unsigned 32-bit number at byte ``at`` (from 1)."""
    payload = F.col(payload) if isinstance(payload, str) else payload
    swapped = F.concat(*[F.hex(F.substring(payload, at + i, 1)) for i in (3, 2, 1, 0)])
    return F.conv(swapped, 16, 10).cast("long")


def packet_frames(decoded: DataFrame) -> DataFrame:
    """One row per frame and channel."""
    per_frame = decoded.select("*", F.posexplode("frames").alias("frame_idx", "_values")).drop("frames")
    return per_frame.select("*", F.posexplode("_values").alias("ch", "value")).drop("_values")


def packet_gaps(packets: DataFrame, order: list[str]) -> DataFrame:
    """Gap before every packet as a plain difference to the packet before it.

    A late packet gives a negative gap.  Summed gaps telescope, so one scan
    gives the packet before, the first packet and how many there were.
    """
    seq, one = F.col("seq"), F.lit(1).cast("long")
    seen = prefix(
        packets, ["sensor_id"], order, {"_prev": ("last", seq), "_first": ("first", seq), "_n": ("sum", one)}
    )
    gap = F.coalesce(seq - F.col("_prev") - 1, F.lit(0)).cast("long")
    lost = F.coalesce(seq - F.col("_first") - F.col("_n"), F.lit(0)).cast("long")
    return seen.withColumns({"gap": gap, "dropped": lost}).drop("_prev", "_first", "_n")


def packet_loss(packets: DataFrame, order: list[str]) -> DataFrame:
    """Gap and running losses against the highest sequence seen so far.

    A packet at or below that number is ``late`` and changes nothing.
    """
    seen = prefix(packets, ["sensor_id"], order, {"_top": ("max", F.col("seq"))})
    late = F.coalesce(F.col("seq") <= F.col("_top"), F.lit(False))
    gap = F.when(late | F.col("_top").isNull(), 0).otherwise(F.col("seq") - F.col("_top") - 1).cast("long")
    gaps = seen.withColumn("late", late).withColumn("gap", gap).drop("_top")
    lost = prefix(gaps, ["sensor_id"], order, {"_lost": ("sum", F.col("gap"))})
    return lost.withColumn("dropped", F.col("_lost") + F.col("gap")).drop("_lost")
