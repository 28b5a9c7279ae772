"""Event-time windows and sessions over sensor streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.operators.runs import session_windows


def windowed_stats(
    values: DataFrame, width: str, slide: str | None = None, watermark: str | None = None
) -> DataFrame:
    """Count, mean and maximum per sensor and window, batch or stream.

    Rows later than ``watermark`` are dropped by Spark; ``slide=None`` tumbles.
    """
    if watermark:
        values = values.withWatermark("ts", watermark)
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        values.groupBy(window.alias("_window"), "sensor_id")
        .agg(
            F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value")
        )
        .select(
            "sensor_id", F.col("_window.start").alias("started"), F.col("_window.end").alias("ended"),
            "n", "mean_value", "max_value",
        )
    )


def session_rollup(events: DataFrame, gap: str = "30 minutes", watermark: str = "10 minutes") -> DataFrame:
    """Live form of ``session_summary``."""
    return session_windows(events.withWatermark("ts", watermark), gap)
