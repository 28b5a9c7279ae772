"""Registration of the signal functions for SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from wavelark.functions import spectral


def decode_float32(audio: Column | str) -> Column:
    """Raw little-endian float32 bytes as samples; incomplete values are cut off."""

    @F.pandas_udf("array<double>")
    def decode(payload: pd.Series) -> pd.Series:
        return payload.map(
            lambda b: None if b is None else np.frombuffer(b[: len(b) // 4 * 4], dtype="<f4").astype(np.float64)
        )

    return decode(audio)


def decode_pcm16(audio: Column | str) -> Column:
    """Raw little-endian int16 bytes as samples in [-1, 1)."""

    @F.pandas_udf("array<double>")
    def decode(payload: pd.Series) -> pd.Series:
        return payload.map(
            lambda b: None if b is None else np.frombuffer(b[: len(b) // 2 * 2], dtype="<i2") / 32768.0
        )

    return decode(audio)


def register(spark: SparkSession) -> None:
    """Register power_spectrum, dominant_freq, gcc_phat and decode_pcm."""

    @F.arrow_udf("array<double>")
    def power_spectrum(samples: pa.Array) -> pa.Array:
        return spectral.power_spectrum_batch(samples, None)

    @F.arrow_udf("double")
    def dominant_freq(samples: pa.Array, sr: pa.Array) -> pa.Array:
        return spectral.dominant_frequency_batch(samples, sr, None, 20.0, 20000.0)

    @F.arrow_udf("int")
    def gcc_phat(first: pa.Array, second: pa.Array, limit: pa.Array) -> pa.Array:
        return spectral.gcc_phat_batch(first, second, limit)

    @F.pandas_udf("array<double>")
    def decode_pcm(payload: pd.Series) -> pd.Series:
        return payload.map(
            lambda b: None if b is None else np.frombuffer(b[: len(b) // 2 * 2], dtype="<i2") / 32768.0
        )

    for name, function in (
        ("power_spectrum", power_spectrum), ("dominant_freq", dominant_freq),
        ("gcc_phat", gcc_phat), ("decode_pcm", decode_pcm),
    ):
        spark.udf.register(name, function)
