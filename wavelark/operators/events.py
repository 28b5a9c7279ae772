"""Energy events and the overall scene of a recording."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.functions.levels import energy
from wavelark.operators.framing import sliding_windows
from wavelark.operators.scan import prefix
from wavelark.session import materialise

KEY = ["recording_id", "channel"]


def scene_windows(signals: DataFrame, window_s: float = 1.0, inclusive: bool = False) -> DataFrame:
    """RMS of consecutive windows; the last one that fits exactly is left out."""
    cut = sliding_windows(signals, window_s, window_s, inclusive)
    return cut.select(
        *KEY, "sr", "n_total", "frame_idx", (F.col("start") / F.col("sr")).alias("time_s"),
        F.sqrt(energy(F.col("samples")) / F.size("samples")).alias("rms"),
    )


def energy_spikes(windows: DataFrame, window_s: float = 1.0, ratio: float = 2.0, floor: float = 0.01) -> DataFrame:
    """Windows louder than ``ratio`` times the mean of all windows before them."""
    # Windows, small next to the audio they come from, are written once: sorting by ranges reads them twice.
    seen = prefix(
        materialise(windows), KEY, ["frame_idx"],
        {"_sum": ("sum", F.col("rms")), "_n": ("sum", F.lit(1).cast("long"))},
    )
    loud = (F.col("_n") > 0) & (F.col("rms") * F.col("_n") > F.col("_sum") * ratio) & (F.col("rms") > floor)
    return seen.filter(loud).select(
        *KEY, "frame_idx", F.bround("time_s", 2).alias("time_s"), F.lit(float(window_s)).alias("duration_s"),
        F.bround("rms", 4).alias("energy"), F.lit("energy_spike").alias("type"),
    )


def scene_totals(windows: DataFrame) -> DataFrame:
    return windows.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_windows"),
        F.bround(F.max(F.col("n_total") / F.col("sr")), 2).alias("duration_s"),
    )


def scene(
    signals: DataFrame, profiles: DataFrame, window_s: float = 1.0, scores: DataFrame | None = None
) -> DataFrame:
    """One row per channel: dominant band, event count, windows and model score.

    ``scores`` (recording_id, channel, anomaly_score) is optional.
    """
    windows = scene_windows(signals, window_s)
    spikes = energy_spikes(windows, window_s).groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_events"))
    strongest = F.array_max(
        F.transform("bands", lambda b, i: F.struct(b["energy"].alias("energy"), (-i).alias("place"), b["name"].alias("name")))
    )["name"]
    length = F.bround(F.col("n_total") / F.col("sr"), 2)
    rows = (
        profiles.select(*KEY, "class_name", length.alias("duration_s"), strongest.alias("scene_label"), "bands")
        .join(windows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_windows")), KEY, "left")
        .join(spikes, KEY, "left")
        .fillna(0, ["n_windows", "n_events"])
    )
    if scores is None:
        return rows.withColumn("anomaly_score", F.lit(None).cast("double"))
    return rows.join(scores.select(*KEY, "anomaly_score"), KEY, "left")
