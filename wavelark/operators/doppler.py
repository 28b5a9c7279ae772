"""Frequency tracks and the velocities they imply."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions.spectral import dominant_frequency
from wavelark.model import SPEED_OF_SOUND
from wavelark.operators.framing import frames, seconds_to_samples
from wavelark.operators.ordered import previous

KEY = ("recording_id", "channel")
TOLERANCE_HZ = 2.0
FALLBACK_HZ = 1000.0
DIRECTIONS = ("approaching", "receding", "stationary")


def velocity(shift: Column, observed: Column, speed: float = SPEED_OF_SOUND) -> Column:
    """Velocity from a frequency shift; 0 where nothing was observed."""
    return F.when(observed > 0, F.lit(float(speed)) * shift / observed).otherwise(0.0)


def direction(shift: Column) -> Column:
    return (
        F.when(F.abs(shift) < TOLERANCE_HZ, "stationary")
        .when(shift > 0, "approaching")
        .otherwise("receding")
    )


def travel_time(distance_m: float | None, speed: Column) -> Column:
    """Seconds to cover the distance; null when hardly moving or unknown."""
    if distance_m is None:
        return F.lit(None).cast("double")
    return F.when(F.abs(speed) > 0.1, F.lit(float(distance_m)) / F.abs(speed))


def frequency_track(
    signals: DataFrame,
    frame_s: float = 0.1,
    hop_s: float = 0.05,
    low_hz: float = 20.0,
    high_hz: float = 20000.0,
) -> DataFrame:
    """Dominant frequency per frame; framing, FFT and peak search are one map."""
    length, hop = seconds_to_samples(frame_s), seconds_to_samples(hop_s)
    count = F.greatest(F.lit(1), F.floor((F.col("n_total") - length) / hop) + 1)
    cut = frames(signals, length, hop, count)
    return cut.select(
        *KEY, "class_name", "sr", "n_total", "frame_idx",
        ((F.col("start") * 2 + F.size("samples")) / 2.0 / F.col("sr")).alias("time_s"),
        dominant_frequency("samples", "sr", None, low_hz, high_hz).alias("freq_hz"),
    )


def first_frequency(
    signals: DataFrame, frame_s: float = 0.1, low_hz: float = 20.0, high_hz: float = 20000.0
) -> DataFrame:
    """Frequency of the first frame of every channel, as ``reference_hz``.

    Only the chunk at sample 0 is read, and of it only one frame.
    """
    head = signals.filter(F.col("start") == 0)
    frame = F.slice("samples", 1, F.least(seconds_to_samples(frame_s), F.size("samples")))
    length = seconds_to_samples(frame_s)
    padded = F.concat(frame, F.array_repeat(F.lit(0.0), length - F.size(frame)))
    freq = dominant_frequency(padded, F.col("sr"), None, low_hz, high_hz)
    return head.select(*KEY, freq.alias("_hz")).select(
        *KEY, F.when(F.col("_hz") > 0, F.col("_hz")).otherwise(FALLBACK_HZ).alias("reference_hz")
    )


def doppler_track(
    track: DataFrame,
    source_frequency: float | None = None,
    speed: float = SPEED_OF_SOUND,
    distance_m: float | None = None,
    reference: DataFrame | None = None,
) -> DataFrame:
    """Velocity and direction per frame against the emitted frequency.

    Without ``source_frequency`` the first frame is the reference: taken from
    ``reference`` (see ``first_frequency``) or else from the track itself.
    """
    if source_frequency is not None:
        rows = track.withColumn("reference_hz", F.lit(float(source_frequency)))
    else:
        if reference is None:
            first = F.when(F.col("freq_hz") > 0, F.col("freq_hz")).otherwise(FALLBACK_HZ)
            reference = track.filter(F.col("frame_idx") == 0).select(*KEY, first.alias("reference_hz"))
        rows = track.join(reference, list(KEY))
    shift = F.col("freq_hz") - F.col("reference_hz")
    rows = rows.withColumn("velocity_m_s", velocity(shift, F.col("freq_hz"), speed))
    return rows.withColumn("direction", direction(shift)).withColumn(
        "travel_time_s", travel_time(distance_m, F.col("velocity_m_s"))
    )


def full_doppler(
    signals: DataFrame,
    source_frequency: float | None = None,
    speed: float = SPEED_OF_SOUND,
    frame_s: float = 0.1,
    hop_s: float = 0.05,
    distance_m: float | None = None,
) -> DataFrame:
    """Track, reference, velocity and direction of every frame."""
    track = frequency_track(signals, frame_s, hop_s)
    reference = None if source_frequency is not None else first_frequency(signals, frame_s)
    return doppler_track(track, source_frequency, speed, distance_m, reference)


def doppler_summary(rows: DataFrame) -> DataFrame:
    """One row per channel; the commonest direction, earliest first on a tie."""
    votes = [
        F.struct(
            F.count_if(F.col("direction") == d).alias("n"),
            (-F.min(F.when(F.col("direction") == d, F.col("frame_idx")))).alias("early"),
            F.lit(d).alias("direction"),
        )
        for d in DIRECTIONS
    ]
    return rows.groupBy(*KEY).agg(
        F.avg("velocity_m_s").alias("mean_velocity_m_s"),
        F.max(F.abs("velocity_m_s")).alias("max_velocity_m_s"),
        F.array_max(F.array(*votes))["direction"].alias("dominant_direction"),
        F.count(F.lit(1)).alias("n_frames"),
        F.max(F.col("n_total") / F.col("sr")).alias("duration_s"),
        F.avg("travel_time_s").alias("mean_travel_time_s"),
    )


def chunk_velocity(track: DataFrame, order_by: str = "frame_idx", speed: float = SPEED_OF_SOUND) -> DataFrame:
    """Velocity between each chunk and the one before it (gap-free ``order_by``)."""
    pairs = previous(track, KEY, order_by, {"f1_hz": "freq_hz"}, block=4096)
    pairs = pairs.filter(F.col("f1_hz").isNotNull()).withColumnRenamed("freq_hz", "f2_hz")
    shift = F.col("f2_hz") - F.col("f1_hz")
    return pairs.select(
        *KEY, order_by, "f1_hz", "f2_hz",
        shift.alias("delta_f_hz"),
        velocity(shift, F.col("f2_hz"), speed).alias("velocity_m_s"),
        direction(shift).alias("direction"),
        F.when(F.col("f1_hz") > 0, F.col("f1_hz")).otherwise(1.0).alias("source_frequency_hz"),
    )
