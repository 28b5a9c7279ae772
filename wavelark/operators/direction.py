"""Direction of arrival from pairs of channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions.spectral import gcc_phat
from wavelark.model import SPEED_OF_SOUND


def channel(signals: DataFrame, k: int) -> DataFrame:
    """Rows of one channel."""
    if k < 0:
        raise ValueError("channel must not be negative")
    return signals.filter(F.col("channel") == k)


def has_channel(signals: DataFrame, k: int) -> DataFrame:
    """Per recording: is channel ``k`` there?"""
    return signals.groupBy("recording_id").agg(
        F.count_if((F.col("channel") == k) & (F.col("start") == 0)).alias("found"),
        F.max("channel").alias("last_channel"),
    ).withColumn("present", F.col("found") > 0).drop("found")


def angle(tdoa_s: Column, distance_m: Column, speed: float = SPEED_OF_SOUND) -> Column:
    """Angle in degrees: 0 broadside, ±90 along the pair's axis."""
    ratio = F.lit(float(speed)) * tdoa_s / distance_m
    return F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))))


def doa(pairs: DataFrame, mic_distance: float | Column, speed: float = SPEED_OF_SOUND) -> DataFrame:
    """Add delay and angle to rows holding two signals, ``first`` and ``second``."""
    distance = mic_distance if isinstance(mic_distance, Column) else F.lit(float(mic_distance))
    reach = F.floor(distance / speed * F.col("sr"))
    rows = pairs.withColumn("delay", gcc_phat("first", "second", reach))
    rows = rows.withColumn("tdoa_s", F.col("delay") / F.col("sr"))
    return rows.withColumn("angle_deg", angle(F.col("tdoa_s"), distance, speed))


def channel_pairs(frames: DataFrame, ref_channel: int = 0) -> DataFrame:
    """Reference frame beside the same frame of every other channel.

    An equi-join on (recording, frame): the reference side has one row per key.
    """
    keys = ["recording_id", "frame_idx"]
    ref = frames.filter(F.col("channel") == ref_channel).select(*keys, F.col("samples").alias("first"))
    others = frames.filter(F.col("channel") != ref_channel).select(
        *keys, "sr", "channel", F.col("samples").alias("second")
    )
    return others.join(ref, keys)


def doa_array(
    frames: DataFrame, mics: list[tuple[float, ...]], speed: float = SPEED_OF_SOUND, ref_channel: int = 0
) -> DataFrame:
    """Delay and angle of every channel against the reference, frame by frame.

    ``mics`` is the array's geometry, one position per channel; it is a
    property of the device, so distances become literals.
    """
    home = mics[ref_channel]
    distances = [sum((a - b) ** 2 for a, b in zip(p, home)) ** 0.5 for p in mics]
    pairs = channel_pairs(frames, ref_channel).withColumn(
        "distance_m", F.get(F.array(*[F.lit(d) for d in distances]), F.col("channel"))
    )
    pairs = pairs.filter(F.col("distance_m") >= 1e-6)
    return doa(pairs, F.col("distance_m"), speed).select(
        "recording_id", "frame_idx", F.lit(ref_channel).alias("ref_channel"), "channel",
        "distance_m", "tdoa_s", "angle_deg",
    )
