"""Levels and other per-array numbers, evaluated in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SILENCE = 1e-10


def energy(samples: Column) -> Column:
    return F.aggregate(samples, F.lit(0.0), lambda acc, x: acc + x * x)


def dbfs(rms: Column) -> Column:
    """Level in dB relative to full scale; silence is minus infinity."""
    return F.when(rms < SILENCE, F.lit(float("-inf"))).otherwise(20 * F.log10(rms))


def level_ok(rms: Column, threshold: float = -110.0) -> Column:
    return 20 * F.log10(rms + 1e-6) > threshold


def zero_crossings(samples: Column) -> Column:
    """Sign changes between neighbours; zero counts as positive."""
    negative = F.transform(samples, lambda x: x < 0)
    pairs = F.zip_with(
        F.slice(negative, 1, F.greatest(F.size(negative) - 1, F.lit(0))),
        F.slice(negative, 2, F.greatest(F.size(negative) - 1, F.lit(0))),
        lambda a, b: F.when(a != b, 1).otherwise(0),
    )
    return F.aggregate(pairs, F.lit(0), lambda acc, x: acc + x)


def pcm16_to_float(value: Column) -> Column:
    return value.cast("double") / 32768.0


def float_to_pcm16(value: Column) -> Column:
    """Truncate to int16 after clipping to its range."""
    return F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), value)).cast("int")
