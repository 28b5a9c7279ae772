"""Clicks and the segments between them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.functions.levels import dbfs
from wavelark.operators.ordered import running

KEY = ["recording_id", "channel"]


def _jumps(signals: DataFrame) -> DataFrame:
    """Add ``jumps``: absolute difference between each own sample and the next.

    The next sample of a chunk's last one is the first of its halo.
    """
    n = F.least(F.col("own").cast("long"), F.col("n_total") - F.col("start") - 1).cast("int")
    here, following = F.slice("samples", 1, n), F.slice("samples", 2, n)
    missing = F.size("samples") < n + 1
    jumps = F.when(
        missing & (n > 0), F.raise_error(F.lit("chunk without halo; call with_halo")).cast("array<double>")
    ).otherwise(F.zip_with(here, following, lambda a, b: F.abs(b - a)))
    return signals.withColumn("jumps", jumps)


def click_thresholds(signals: DataFrame) -> DataFrame:
    """Mean plus two standard deviations of the jumps, per channel.

    Chunk sums go into the shuffle, never samples.
    """
    rows = _jumps(signals).select(
        *KEY,
        F.size("jumps").alias("_n"),
        F.aggregate("jumps", F.lit(0.0), lambda a, x: a + x).alias("_s"),
        F.aggregate("jumps", F.lit(0.0), lambda a, x: a + x * x).alias("_q"),
    )
    sums = rows.groupBy(*KEY).agg(F.sum("_n").alias("_n"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"))
    mean = F.try_divide(F.col("_s"), F.col("_n"))
    spread = F.sqrt(F.greatest(F.try_divide(F.col("_q"), F.col("_n")) - mean * mean, F.lit(0.0)))
    return sums.select(*KEY, (mean + 2 * spread).alias("threshold"))


def _with_clicks(signals: DataFrame) -> DataFrame:
    """Add ``clicks``: positions in the chunk where the jump exceeds the threshold."""
    rows = _jumps(signals).join(click_thresholds(signals), KEY)
    places = F.filter(
        F.transform("jumps", lambda x, i: F.when(x > F.col("threshold"), i)), lambda i: i.isNotNull()
    )
    return rows.withColumn("clicks", places)


def clicks(signals: DataFrame) -> DataFrame:
    """One row per click: position, time and size of the jump."""
    about = F.transform(
        "clicks",
        lambda i: F.struct((F.col("start") + i).alias("idx"), F.get("jumps", i).alias("amplitude")),
    )
    found = _with_clicks(signals).select(*KEY, "sr", F.explode(about).alias("c"))
    return found.select(*KEY, "c.idx", (F.col("c.idx") / F.col("sr")).alias("time_s"), "c.amplitude")


def segments(signals: DataFrame, min_ms: float = 3000.0, min_dbfs: float = -50.0) -> DataFrame:
    """Stretches between clicks that are long and loud enough, numbered from 1.

    A click at sample ``i`` ends one segment and begins the next, which starts
    with sample ``i`` itself; the stretch after the last click is tested too.
    Each chunk only contributes, per segment it touches, a length and a power.
    """
    rows = _with_clicks(signals)

    @F.pandas_udf("array<struct<part int, first int, n int, power double>>")
    def parts(samples: pd.Series, own: pd.Series, cuts: pd.Series) -> pd.Series:
        result = []
        for values, n, at in zip(samples, own, cuts):
            bounds = np.concatenate([[0], np.asarray(at, dtype=np.int64), [n]]).astype(np.int64)
            total = np.concatenate([[0.0], np.cumsum(np.asarray(values[:n]) ** 2)])
            result.append(
                [
                    {"part": i, "first": int(a), "n": int(b - a), "power": float(total[b] - total[a])}
                    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:]))
                    if b > a
                ]
            )
        return pd.Series(result)

    cut = rows.select(
        *KEY, "sr", "start", F.size("clicks").alias("_clicks"), parts("samples", "own", "clicks").alias("_parts")
    )
    numbered = running(
        cut, KEY, F.floor(F.col("start") / (1 << 24)), ["start"], {"before": F.col("_clicks")}, write=True
    )
    pieces = numbered.select(*KEY, "sr", "start", "before", F.explode("_parts").alias("p"))
    found = (
        pieces.groupBy(*KEY, "sr", (F.col("before") + F.col("p.part")).alias("segment"))
        .agg(
            F.min(F.col("start") + F.col("p.first")).alias("first_idx"),
            F.sum("p.n").alias("n_samples"),
            F.sum("p.power").alias("_power"),
        )
        .withColumn("length_ms", F.col("n_samples") / F.col("sr") * 1000)
        .withColumn("level_db", dbfs(F.sqrt(F.col("_power") / F.col("n_samples"))))
        .filter((F.col("length_ms") >= min_ms) & (F.col("level_db") > min_dbfs))
        .drop("_power")
    )
    block = F.floor(F.col("segment") / 65536)
    counted = running(found, KEY, block, ["segment"], {"_kept": F.lit(1).cast("long")}, write=True)
    return counted.withColumn("number", F.col("_kept") + 1).drop("_kept", "segment")
