"""Live audio chunks: guard, features, first guess, scores.

Input: sensor_id string, ts timestamp, audio binary (raw float32).  Everything
here is a map over rows, so a stream needs no state and a batch gives the same
rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.functions import descriptors as D
from wavelark.functions.spectral import dominant_frequency
from wavelark.functions.sql import decode_float32
from wavelark.model import BANDS, FeatureConfig
from wavelark.operators import bands as B
from wavelark.operators.blocks import PER_BLOCK
from wavelark.operators.features import MARGIN, N_MELS, _spectra, describe_block, layout, vector_length
from wavelark.operators.quality import length_guard

MIN_SAMPLES = 1024

# Texts of the three kinds of message.
TOO_SHORT = "Audio chunk too short"
FEATURES_ONLY = "Features extracted (no model loaded)"
FAILED = "Audio below threshold or extraction failed"


def chunk_signals(chunks: DataFrame, sr: int = 44100) -> DataFrame:
    """Every chunk as a signal of its own, named by sensor and time."""
    name = F.concat_ws("@", "sensor_id", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"))
    rows = chunks.withColumn("samples", decode_float32("audio"))
    n = F.size("samples")
    return rows.select(
        "sensor_id", "ts", name.alias("recording_id"), F.lit("live").alias("class_name"), F.lit(0).alias("channel"),
        F.lit(sr).alias("sr"), n.cast("long").alias("n_total"), F.lit(0).cast("long").alias("start"),
        n.alias("own"), "samples",
    )


def _statistics(values: np.ndarray, config: FeatureConfig) -> np.ndarray:
    out, at = [], 0
    for _, width in layout(config):
        part = values[:, at : at + width]
        part = part[~np.isnan(part).any(axis=1)]
        at += width
        mean, std = part.mean(axis=0), part.std(axis=0)
        for stat in config.stats:
            if stat == "mean":
                out.append(mean)
            elif stat == "std":
                out.append(std)
            elif stat == "median":
                out.append(np.median(part, axis=0))
            elif stat in ("skew", "kurtosis"):
                # A constant coefficient has neither, as in the batch statistics.
                z = (part - mean) / np.where(std > 0, std, np.nan)
                out.append((z**3).mean(axis=0) if stat == "skew" else (z**4).mean(axis=0) - 3)
    return np.concatenate(out)


def chunk_features(signals: DataFrame, config: FeatureConfig = FeatureConfig(), n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """Add ``features`` to rows that each hold one whole signal.

    The same block description as in batch; a chunk is short, so its blocks
    and their statistics are made where the row is.  Too short rows get null.
    """

    def vector(samples: np.ndarray, sr: int) -> np.ndarray:
        n = len(samples)
        frames = n // hop + 1
        lead = n_fft // 2 + MARGIN * hop
        length = (PER_BLOCK - 1 + 2 * MARGIN) * hop + n_fft
        blocks = -(-frames // PER_BLOCK)
        padded = np.pad(samples, (lead, blocks * PER_BLOCK * hop + length))
        size = min(n_fft, n)
        power = np.abs(_spectra(padded[MARGIN * hop : MARGIN * hop + (frames - 1) * hop + n_fft], n_fft, size, hop)) ** 2
        loudest = float((power @ D.mel_matrix(sr, size, N_MELS).T).max())
        values = []
        for b in range(blocks):
            at = b * PER_BLOCK * hop
            values.append(
                describe_block(padded[at : at + length], at - lead, b, n, sr, loudest, config, n_fft, hop)[1]
            )
        return _statistics(np.vstack(values), config)

    @F.pandas_udf("array<double>")
    def features(samples: pd.Series, rate: pd.Series) -> pd.Series:
        return pd.Series(
            [None if x is None or len(x) < 64 else vector(np.asarray(x), int(r)) for x, r in zip(samples, rate)]
        )

    return signals.withColumn("features", features("samples", "sr"))


def featurise_stream(chunks: DataFrame, config: FeatureConfig = FeatureConfig(), sr: int = 44100) -> DataFrame:
    """One message per chunk: too short, features extracted, or failed."""
    signals = chunk_signals(chunks, sr)
    short = length_guard(F.col("n_total"), MIN_SAMPLES) == "too_short"
    rows = chunk_features(signals.withColumn("samples", F.when(~short, F.col("samples"))), config)
    length = F.when(F.col("features").isNotNull(), F.size("features"))
    message = F.when(short, TOO_SHORT).when(length.isNotNull(), FEATURES_ONLY).otherwise(FAILED)
    return rows.select("sensor_id", "ts", length.alias("features_length"), message.alias("message"))


def hybrid_stream(chunks: DataFrame, sr: int = 44100, bands=BANDS, n_fft: int = 4096) -> DataFrame:
    """First guess and dominant frequency of every chunk; null, with the reason, where one is too short."""
    signals = chunk_signals(chunks, sr)
    short = length_guard(F.col("n_total"), MIN_SAMPLES) == "too_short"
    signals = signals.withColumn("freq_hz", dominant_frequency("samples", "sr", n_fft)).withColumn("short", short)
    about = ("sensor_id", "freq_hz", "short")
    guess = B.hybrid_classify(B.chunk_energy(signals, bands, n_fft, about), bands=bands, keep=about)
    known = lambda c: F.when(~F.col("short"), c)
    return guess.select(
        "sensor_id", "recording_id", known(F.col("freq_hz")).alias("freq_hz"),
        known(F.col("first_guess")).alias("first_guess"),
        known(F.col("candidates")[0]["confidence"]).alias("confidence"),
        F.when(F.col("short"), TOO_SHORT).otherwise(F.col("method")).alias("method"),
    )


def score_stream(chunks: DataFrame, model=None, config: FeatureConfig = FeatureConfig(), sr: int = 44100) -> DataFrame:
    """Label and confidence per chunk, or the no-model message.

    A chunk that is too short has a row without label.
    """
    if model is None:
        return featurise_stream(chunks, config, sr)
    signals = chunk_signals(chunks, sr)
    short = length_guard(F.col("n_total"), MIN_SAMPLES) == "too_short"
    rows = chunk_features(signals.withColumn("samples", F.when(~short, F.col("samples"))), config)
    zeros = F.array_repeat(F.lit(0.0), vector_length(config))
    known = F.col("features").isNotNull()
    ready = rows.select("sensor_id", "ts", "class_name", known.alias("known"), F.coalesce("features", zeros).alias("features"))
    scored = model.classify(ready)
    return scored.select(
        "sensor_id", "ts", F.when(F.col("known"), F.col("prediction")).alias("prediction"),
        F.when(F.col("known"), F.col("confidence")).alias("confidence"),
    )
