"""Time stretching and pitch shifting."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavelark.functions import stft
from wavelark.operators.blocks import KEY, PER_BLOCK, prefix_arrays, stft_blocks
from wavelark.operators.framing import overlap_add


def _steps(block: int, frames: int, rate: float) -> np.ndarray:
    """Output steps whose analysis position falls into a block's own frames."""
    low, high = block * PER_BLOCK, min((block + 1) * PER_BLOCK, frames)
    t = np.arange(int(low / rate) - 1, int(high / rate) + 2)
    place = np.floor(t * rate)
    return t[(t >= 0) & (place >= low) & (place < high) & (t * rate < frames)]


def _analyse(samples, block: int, n_total: int, rate: float, n_fft: int, hop: int):
    """Steps, magnitudes and phase advances of one block."""
    spectra = stft.transform(np.asarray(samples), n_fft, hop)
    frames = n_total // hop + 1
    spectra[np.arange(block * PER_BLOCK, block * PER_BLOCK + len(spectra)) >= frames] = 0
    steps = _steps(block, frames, rate)
    at = steps * rate - block * PER_BLOCK
    low = np.floor(at).astype(int)
    share = (at - low)[:, None]
    magnitude = (1 - share) * np.abs(spectra[low]) + share * np.abs(spectra[low + 1])
    expected = 2 * np.pi * hop * np.arange(n_fft // 2 + 1) / n_fft
    turn = np.angle(spectra[low + 1]) - np.angle(spectra[low]) - expected
    advance = expected + turn - 2 * np.pi * np.round(turn / (2 * np.pi))
    return steps, magnitude, advance, np.angle(spectra[0])


def time_stretch(
    signals: DataFrame, rate: float | None, n_fft: int = 2048, hop: int = 512,
    keep: Sequence[str] = (), halo: int = 0,
) -> DataFrame:
    """Change speed without changing pitch; ``rate`` above 1 is faster.

    ``rate=None`` reads the column ``rate``.  A phase vocoder in two passes:
    each block of frames reports how far its phases advance, these few numbers
    are summed along the recording, and then every block is re-synthesised on
    its own from its starting phase.
    """
    rows = signals if rate is None else signals.withColumn("rate", F.lit(float(rate)))
    rows = rows.withColumn("length", F.col("n_total"))
    blocks = stft_blocks(rows, n_fft, hop, after=1, keep=["rate"])

    @F.pandas_udf("array<double>")
    def advances(samples: pd.Series, block: pd.Series, n_total: pd.Series, speed: pd.Series) -> pd.Series:
        out = []
        for x, b, n, r in zip(samples, block, n_total, speed):
            _, _, advance, first = _analyse(x, b, n, r, n_fft, hop)
            out.append(advance.sum(axis=0) + (first if b == 0 else 0.0))
        return pd.Series(out)

    @F.pandas_udf("start long, samples array<double>, weight array<double>")
    def synthesis(
        samples: pd.Series, block: pd.Series, n_total: pd.Series, speed: pd.Series, phase: pd.Series
    ) -> pd.DataFrame:
        out = []
        for x, b, n, r, begin in zip(samples, block, n_total, speed, phase):
            steps, magnitude, advance, first = _analyse(x, b, n, r, n_fft, hop)
            if len(steps) == 0:
                out.append((0, np.zeros(0), np.zeros(0)))
                continue
            begin = first if b == 0 else np.asarray(begin)
            turned = begin + np.vstack([np.zeros_like(begin), np.cumsum(advance, axis=0)[:-1]])
            piece, weight = stft.inverse(magnitude * np.exp(1j * turned), n_fft, hop)
            out.append((int(steps[0]) * hop - n_fft // 2, piece, weight))
        return pd.DataFrame(out, columns=["start", "samples", "weight"])

    moved = blocks.select(*KEY, "block", advances("samples", "block", "n_total", "rate").alias("phase"))
    phases = prefix_arrays(moved, KEY, "block", "phase")
    pieces = blocks.join(phases, [*KEY, "block"]).withColumn(
        "piece", synthesis("samples", "block", "n_total", "rate", "phase")
    )
    stretched = pieces.select(
        *KEY, "class_name", "sr", F.round(F.col("n_total") / F.col("rate")).cast("long").alias("n_total"),
        "piece.start", "piece.samples", "piece.weight",
    ).filter(F.size("samples") > 0)
    result = overlap_add(stretched, halo=halo)
    if not keep:
        return result
    carried = rows.filter(F.col("start") == 0).select(*KEY, *keep)
    return result.join(carried, KEY)


def resample(signals: DataFrame) -> DataFrame:
    """Linear resampling by column ``rate`` to ``length`` samples per channel.

    Output sample ``j`` lies at ``j / rate``; the chunk owning that position
    computes it, with one sample of halo, so this is a map.
    """

    @F.pandas_udf("start long, samples array<double>")
    def interpolate(
        samples: pd.Series, start: pd.Series, own: pd.Series, n_total: pd.Series, rate: pd.Series, length: pd.Series
    ) -> pd.DataFrame:
        out = []
        for x, s, n, total, r, size in zip(samples, start, own, n_total, rate, length):
            x = np.asarray(x)
            last = s + n >= total
            j = np.arange(int(np.ceil(s * r - 1e-9)), size if last else int(np.ceil((s + n) * r - 1e-9)))
            j = j[j < size]
            out.append((int(j[0]) if len(j) else 0, np.interp(j / r - s, np.arange(len(x)), x)))
        return pd.DataFrame(out, columns=["start", "samples"])

    rows = signals.withColumn(
        "_r", interpolate("samples", "start", "own", "n_total", "rate", "length")
    )
    return rows.select(
        *KEY, "class_name", "sr", F.col("length").alias("n_total"), F.col("_r.start").alias("start"),
        F.size("_r.samples").alias("own"), F.col("_r.samples").alias("samples"),
    ).filter(F.col("own") > 0)


def pitch_shift(signals: DataFrame, semitones: float, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """Change pitch and keep the duration."""
    stretched = time_stretch(
        signals, 2.0 ** (-semitones / 12), n_fft, hop, keep=["rate", "length"], halo=1
    )
    return resample(stretched)


def hz_to_semitones(offset_hz: float) -> float:
    """Legacy approximation: 100 Hz count as one semitone."""
    return offset_hz / 100.0
