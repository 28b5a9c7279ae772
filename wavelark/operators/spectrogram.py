"""Numbers behind waveform and spectrogram displays."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["recording_id", "channel"]


def waveform_envelope(signals: DataFrame, buckets: int = 1000) -> DataFrame:
    """Lowest and highest sample in each of ``buckets`` equal parts of a channel.

    A chunk is cut at bucket borders in place, so one row per chunk and bucket
    enters the aggregate, not one per sample.
    """
    first = F.floor(F.col("start") * buckets / F.col("n_total"))
    last = F.floor((F.col("start") + F.col("own") - 1) * buckets / F.col("n_total"))
    edge = lambda b: F.ceil(b * F.col("n_total") / buckets)

    def extremes(b):
        begin = F.greatest(edge(b), F.col("start")) - F.col("start")
        end = F.least(edge(b + 1), F.col("start") + F.col("own")) - F.col("start")
        piece = F.slice("samples", (begin + 1).cast("int"), F.greatest(end - begin, F.lit(0)).cast("int"))
        return F.struct(b.alias("bucket"), F.array_min(piece).alias("low"), F.array_max(piece).alias("high"))

    parts = signals.select(*KEY, F.explode(F.transform(F.sequence(first, last), extremes)).alias("p"))
    return (
        parts.groupBy(*KEY, F.col("p.bucket").alias("bucket"))
        .agg(F.min("p.low").alias("low"), F.max("p.high").alias("high"))
        .filter(F.col("low").isNotNull())
    )
