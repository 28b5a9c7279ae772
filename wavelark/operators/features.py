"""Frame features and the vectors made of their statistics.

Frames are described in blocks of consecutive frames with a margin of
neighbours, so no audio is shuffled; statistics are Spark aggregates that
combine map-side before one small row per recording is exchanged.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions import descriptors as D
from wavelark.functions import stft
from wavelark.model import FeatureConfig
from wavelark.operators.blocks import KEY, PER_BLOCK, stft_blocks
from wavelark.operators.ordered import exact_quantile

N_MELS = 128
MARGIN = 16
MIN_SAMPLES = 64
TOP_DB = 80.0
NAMES = ("recording_id", "class_name", "channel")


def layout(config: FeatureConfig) -> list[tuple[str, int]]:
    """Families in the order of the vector, with their widths."""
    families = [
        ("mfcc", config.mfcc, config.n_mfcc),
        ("delta", config.mfcc and config.delta_mfcc, config.n_mfcc),
        ("delta2", config.mfcc and config.delta_mfcc, config.n_mfcc),
        ("chroma", config.chroma, 12),
        ("tonnetz", config.tonnetz, 6),
        ("mel", config.mel, N_MELS),
        ("contrast", config.contrast, 7),
        ("centroid", config.spectral_centroid, 1),
        ("bandwidth", config.spectral_bandwidth, 1),
        ("rolloff", config.spectral_rolloff, 1),
        ("flatness", config.spectral_flatness, 1),
        ("flux", config.spectral_flux, 1),
        ("zcr", config.zcr, 1),
        ("rms", config.rms, 1),
    ]
    return [(name, width) for name, on, width in families if on]


def vector_length(config: FeatureConfig) -> int:
    return sum(width for _, width in layout(config)) * len(known_stats(config.stats))


def _spectra(samples, n_fft: int, size: int, hop: int) -> np.ndarray:
    """Spectra of a block cut for ``n_fft`` when the recording only has ``size`` samples."""
    x = np.asarray(samples)
    spare = n_fft // 2 - size // 2
    return stft.transform(x[spare : len(x) - (n_fft - size - spare)] if size < n_fft else x, size, hop)


def mel_blocks(signals: DataFrame, n_fft: int, hop: int) -> DataFrame:
    """Largest mel power per channel, the reference level of the dB floor."""

    @F.pandas_udf("double")
    def loudest(samples: pd.Series, n_total: pd.Series, sr: pd.Series) -> pd.Series:
        out = []
        for x, n, rate in zip(samples, n_total, sr):
            size = min(n_fft, int(n))
            power = np.abs(_spectra(x, n_fft, size, hop)) ** 2
            out.append(float((power @ D.mel_matrix(int(rate), size, N_MELS).T).max()))
        return pd.Series(out)

    blocks = stft_blocks(signals, n_fft, hop)
    return blocks.select(*KEY, loudest("samples", "n_total", "sr").alias("m")).groupBy(*KEY).agg(
        F.max("m").alias("loudest")
    )


def describe_block(
    samples, start: int, block: int, n: int, sr: int, loudest: float, config: FeatureConfig, n_fft: int, hop: int
) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers and values (frames × families) of one block."""
    wanted = {name for name, _ in layout(config)}
    size = min(n_fft, n)
    total = n // hop + 1
    first = block * PER_BLOCK - MARGIN
    spectra = _spectra(samples, n_fft, size, hop)
    inside = np.flatnonzero((np.arange(len(spectra)) + first >= 0) & (np.arange(len(spectra)) + first < total))
    low, high = int(inside[0]), int(inside[-1]) + 1
    spectra, first = spectra[low:high], first + low
    own_first = block * PER_BLOCK - first
    own = slice(own_first, min(own_first + PER_BLOCK, len(spectra)))
    frames = np.arange(own.start, own.stop)
    magnitude = np.abs(spectra)
    here = magnitude[own]
    parts: dict[str, np.ndarray] = {}
    if {"mfcc", "mel"} & wanted:
        mel = magnitude**2 @ D.mel_matrix(sr, size, N_MELS).T
        parts["mel"] = mel[own]
    if "mfcc" in wanted:
        level = np.maximum(D.decibels(mel), D.decibels(np.array(loudest)) - TOP_DB)
        cepstra = level @ D.dct_matrix(config.n_mfcc, N_MELS).T
        parts["mfcc"] = cepstra[own]
        # The first and last frame stand in for missing neighbours.
        around = np.clip(frames[:, None] + np.arange(-4, 5), 0, len(cepstra) - 1)
        if "delta" in wanted:
            parts["delta"] = D.slope(cepstra, around, 1)
            parts["delta2"] = D.slope(cepstra, around, 2)
    if "chroma" in wanted:
        parts["chroma"] = D.chroma(here**2, sr, size)
    if "tonnetz" in wanted:
        steady = D.harmonic_power(magnitude, own, first, total)
        parts["tonnetz"] = D.tonnetz(D.chroma(steady, sr, size))
    if "contrast" in wanted:
        parts["contrast"] = D.contrast(here, sr, size)
    if {"centroid", "bandwidth", "rolloff", "flatness"} & wanted:
        parts |= {k: v[:, None] for k, v in D.shape(here, sr, size).items()}
    if "flux" in wanted:
        before = magnitude[np.clip(frames - 1, 0, None)]
        flux = np.sqrt(((here - before) ** 2).sum(axis=1))
        parts["flux"] = np.where(frames + first > 0, flux, np.nan)[:, None]
    if {"zcr", "rms"} & wanted:
        x = np.asarray(samples)
        places = np.arange(len(x)) + start
        real = (places >= 0) & (places < n)
        skip = n_fft // 2 - size // 2
        cut = lambda v: np.lib.stride_tricks.sliding_window_view(v, size)[skip::hop][low:high][own]
        parts["rms"] = np.sqrt((cut(x) ** 2).mean(axis=1))[:, None]
        change = np.concatenate([[False], (x[1:] < 0) != (x[:-1] < 0)])
        change[1:] &= real[1:] & real[:-1]
        counted = cut(change).copy()
        counted[:, 0] = False
        parts["zcr"] = counted.mean(axis=1)[:, None]
    return frames + first, np.hstack([parts[name] for name, _ in layout(config)])


def frame_features(
    signals: DataFrame, config: FeatureConfig = FeatureConfig(), n_fft: int = 2048, hop: int = 512
) -> DataFrame:
    """One row per frame; ``values`` holds the families of ``layout(config)``.

    Recordings under 64 samples have no features.  A recording shorter than
    ``n_fft`` uses its own length as frame size.  Families that are switched off
    are not computed.
    """
    chosen = layout(config)
    wanted = {name for name, _ in chosen}
    usable = signals.filter(F.col("n_total") >= MIN_SAMPLES)
    blocks = stft_blocks(usable, n_fft, hop, before=MARGIN, after=MARGIN)
    if "mfcc" in wanted:
        blocks = blocks.join(mel_blocks(usable, n_fft, hop), KEY)
    else:
        blocks = blocks.withColumn("loudest", F.lit(0.0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["recording_id", "class_name", "channel", "frame_idx", "values"]
        ready: list[tuple] = []
        for batch in batches:
            for row in batch.itertuples(index=False):
                frames, values = describe_block(
                    row.samples, row.start, row.block, int(row.n_total), int(row.sr), row.loudest, config, n_fft, hop
                )
                about = (row.recording_id, row.class_name, row.channel)
                ready += [(*about, int(f), v) for f, v in zip(frames, values)]
                if len(ready) >= 2048:  # a few megabytes
                    yield pd.DataFrame(ready, columns=names)
                    ready = []
        if ready:
            yield pd.DataFrame(ready, columns=names)

    return blocks.mapInPandas(
        run, "recording_id string, class_name string, channel int, frame_idx long, values array<double>"
    )


def family(frame_rows: DataFrame, config: FeatureConfig, name: str) -> DataFrame:
    """One family's values per frame."""
    at = 1
    for family_name, width in layout(config):
        if family_name == name:
            return frame_rows.select(*NAMES, "frame_idx", F.slice("values", at, width).alias(name))
        at += width
    raise ValueError(f"{name} is switched off")


# Statistic name to the aggregate over a coefficient's frames; the median is
# found by exact_quantile.  Unknown names are ignored.
STATS: dict[str, Callable[[Column], Column] | None] = {
    "mean": F.avg,
    "std": F.stddev_pop,
    "skew": F.skewness,
    "kurtosis": F.kurtosis,
    "median": None,
}


def known_stats(stats: Sequence[str]) -> list[str]:
    return [s for s in stats if s in STATS]


def coefficient_stats(frame_rows: DataFrame, stats: Sequence[str], keys: Sequence[str] = NAMES) -> DataFrame:
    """Long form: key, pos, one column per statistic over the values present."""
    keys = list(keys)
    rows = frame_rows.select(*keys, F.posexplode("values").alias("pos", "value"))
    rows = rows.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    simple = [s for s in known_stats(stats) if STATS[s] is not None]
    result = rows.groupBy(*keys, "pos").agg(
        F.count(F.lit(1)).alias("n"), *[STATS[s](F.col("value")).alias(s) for s in simple]
    )
    if "median" in stats:
        result = result.join(exact_quantile(rows, [*keys, "pos"], "value", 0.5, "median"), [*keys, "pos"])
    return result


def aggregate_features(frame_rows: DataFrame, config: FeatureConfig = FeatureConfig()) -> DataFrame:
    """One vector per channel: per family, each statistic over its coefficients.

    Mean and deviation, the default, come from one vector aggregate without
    exploding; other statistics go through the long form.
    """
    stats = known_stats(config.stats)
    chosen = layout(config)
    if not config.spectral_flux and set(stats) <= {"mean", "std"}:
        summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector("values"))
        rows = frame_rows.groupBy(*NAMES).agg(summary.alias("s"))
        count = F.col("s.count")
        rows = rows.select(
            *NAMES,
            vector_to_array("s.mean").alias("mean"),
            # The summary divides by n - 1, the features by n.
            F.transform(
                vector_to_array("s.variance"), lambda v: F.sqrt(F.greatest(v * (count - 1) / count, F.lit(0.0)))
            ).alias("std"),
        )
    else:
        long = coefficient_stats(frame_rows, stats)
        packed = long.groupBy(*NAMES).agg(
            F.array_sort(F.collect_list(F.struct("pos", *stats))).alias("_all")  # one entry per coefficient
        )
        rows = packed.select(*NAMES, *[F.col(f"_all.{s}").alias(s) for s in stats])
    pieces, at = [], 1
    for _, width in chosen:
        pieces += [F.slice(s, at, width) for s in stats]
        at += width
    return rows.select(*NAMES, F.concat(*pieces).alias("features"))


def feature_vectors(
    signals: DataFrame, config: FeatureConfig = FeatureConfig(), n_fft: int = 2048, hop: int = 512
) -> DataFrame:
    """Feature vector per channel of every recording.

    Recordings under ``MIN_SAMPLES`` samples have a row without features and the
    ``reason``; it is null for all others.
    """
    made = aggregate_features(frame_features(signals, config, n_fft, hop), config)
    short = signals.filter((F.col("start") == 0) & (F.col("n_total") < MIN_SAMPLES)).select(
        *NAMES, F.lit(None).cast("array<double>").alias("features"), F.lit("too short").alias("reason")
    )
    return made.withColumn("reason", F.lit(None).cast("string")).unionByName(short)


def mel_db(signals: DataFrame, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """Mel spectrogram rows in dB relative to the channel's loudest value."""
    config = FeatureConfig.from_dict(
        {n: n == "mel" for n in FeatureConfig.__dataclass_fields__ if n not in ("n_mfcc", "stats")}
    )
    rows = frame_features(signals, config, n_fft, hop)
    peaks = rows.groupBy("recording_id", "channel").agg(F.max(F.array_max("values")).alias("_peak"))
    floor = F.lit(1e-10)
    level = lambda x: 10 * F.log10(F.greatest(x, floor))
    return rows.join(peaks, ["recording_id", "channel"]).select(
        *NAMES, "frame_idx",
        F.transform("values", lambda x: F.greatest(level(x) - level(F.col("_peak")), F.lit(-TOP_DB))).alias("mel_db"),
    )
