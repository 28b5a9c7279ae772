"""Frequency-band profile and the heuristic first guess built on it.

Bands and their sources are a handful of literals, so every step after the FFT
is an array expression on the recording's own row: no join, no explode.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions.spectral import band_power, mean_band_power
from wavelark.model import BANDS, MOVING_SOURCES, Band
from wavelark.operators.framing import frames

KEY = ("recording_id", "channel")


def array_sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def band_energy(signals: DataFrame, bands: Sequence[Band] = BANDS, n_fft: int = 4096) -> DataFrame:
    """Share of energy per band over the whole recording, one row per channel.

    Means over consecutive frames; the last one is padded with silence.
    """
    count = F.greatest(F.ceil(F.col("n_total") / n_fft), F.lit(1))
    return _profiles(frames(signals, n_fft, n_fft, count), bands, n_fft)


def first_frame_energy(signals: DataFrame, bands: Sequence[Band] = BANDS, n_fft: int = 4096) -> DataFrame:
    """Share of energy per band in the first ``n_fft`` samples only."""
    return _profiles(frames(signals, n_fft, n_fft, F.lit(1)), bands, n_fft)


def _limits(bands: Sequence[Band]) -> list[tuple[float, float]]:
    return [(float(b.low_hz), float(b.high_hz)) for b in bands]


def chunk_energy(
    signals: DataFrame, bands: Sequence[Band] = BANDS, n_fft: int = 4096, keep: Sequence[str] = ()
) -> DataFrame:
    """``band_energy`` where each row holds a whole signal: a map, fit for streams."""
    raw = mean_band_power("samples", "sr", n_fft, _limits(bands))
    return _shares(signals.select(*KEY, "class_name", "sr", "n_total", *keep, raw.alias("raw")), bands, keep)


def _profiles(cut: DataFrame, bands: Sequence[Band], n_fft: int) -> DataFrame:
    powers = cut.select(
        *KEY, "class_name", "sr", "n_total", band_power("samples", "sr", n_fft, _limits(bands)).alias("raw")
    )
    means = [F.avg(F.col("raw")[i]).alias(f"b{i}") for i in range(len(bands))]
    rows = (
        powers.groupBy(*KEY, "class_name", "sr", "n_total").agg(*means)
        .withColumn("raw", F.array(*[f"b{i}" for i in range(len(bands))]))
    )
    return _shares(rows, bands)


def _shares(rows: DataFrame, bands: Sequence[Band], keep: Sequence[str] = ()) -> DataFrame:
    rows = rows.withColumn("total", reduce(lambda a, b: a + b, [F.col("raw")[i] for i in range(len(bands))]))
    share = lambda i: F.when(F.col("total") > 0, F.col("raw")[i] / F.col("total")).otherwise(0.0)
    profile = F.array(
        *[
            F.struct(
                F.lit(b.name).alias("name"),
                F.lit(float(b.low_hz)).alias("low_hz"),
                F.lit(float(b.high_hz)).alias("high_hz"),
                share(i).alias("energy"),
                (10 * F.log10(F.col("raw")[i] + 1e-10)).alias("energy_db"),
            )
            for i, b in enumerate(bands)
        ]
    )
    return rows.select(*KEY, "class_name", "sr", "n_total", *keep, profile.alias("bands"))


def band_rows(profiles: DataFrame) -> DataFrame:
    """One row per band."""
    return profiles.select(*KEY, "class_name", F.posexplode_outer("bands").alias("band_idx", "band")).select(
        *KEY, "class_name", "band_idx", "band.*"
    )


def source_positions(bands: Sequence[Band]) -> dict[str, list[int]]:
    """Source name to the bands listing it, in order of first mention."""
    listing: dict[str, list[int]] = {}
    for i, band in enumerate(bands):
        for source in band.sources:
            listing.setdefault(source, []).append(i)
    return listing


def source_scores(profiles: DataFrame, bands: Sequence[Band] = BANDS) -> DataFrame:
    """Add ``scores``: every source with its energy, best = 1, ranked."""
    listing = source_positions(bands)
    energy = lambda i: F.col("bands")[i]["energy"]
    raw = {s: reduce(lambda a, b: a + b, [energy(i) for i in places]) for s, places in listing.items()}
    if len(raw) == 1:
        best = next(iter(raw.values()))
    else:
        best = F.greatest(*raw.values())
    entries = F.array(
        *[
            F.struct(
                F.when(F.col("_best") > 0, score / F.col("_best")).otherwise(score).alias("score"),
                F.lit(-place).alias("place"),
                F.lit(source).alias("source"),
            )
            for place, (source, score) in enumerate(raw.items())
        ]
    )
    return (
        profiles.withColumn("_best", best)
        .withColumn("scores", F.sort_array(entries, asc=False))
        .drop("_best")
    )


def hybrid_classify(
    profiles: DataFrame,
    doppler_summary: DataFrame | None = None,
    bands: Sequence[Band] = BANDS,
    top_k: int = 3,
    keep: Sequence[str] = (),
) -> DataFrame:
    """First guess per channel from band energies, with Doppler context if given.

    The top ``top_k`` are cut and rounded before motion changes their scores.
    ``keep`` names further columns of ``profiles`` to carry along.
    """
    scored = source_scores(profiles, bands)
    top = F.transform(
        F.slice("scores", 1, top_k),
        lambda s, i: F.struct(
            F.bround(s["score"], 3).alias("confidence"), (-i).alias("place"), s["source"].alias("source")
        ),
    )
    rows = scored.withColumn("_top", top)
    if doppler_summary is None:
        rows = rows.withColumns(
            {
                "is_moving": F.lit(None).cast("boolean"),
                "velocity_m_s": F.lit(None).cast("double"),
                "direction": F.lit(None).cast("string"),
                "method": F.lit("frequency_band"),
            }
        )
    else:
        context = doppler_summary.select(
            *KEY,
            F.col("mean_velocity_m_s").alias("velocity_m_s"),
            F.col("dominant_direction").alias("direction"),
        )
        moved = F.coalesce(F.col("is_moving"), F.lit(False))
        boosted = F.sort_array(
            F.transform(
                "_top",
                lambda s: F.struct(
                    F.when(
                        s["source"].isin(*MOVING_SOURCES),
                        F.least(F.lit(1.0), s["confidence"] * 1.3),
                    ).otherwise(s["confidence"] * 0.7).alias("confidence"),
                    s["place"].alias("place"),
                    s["source"].alias("source"),
                ),
            ),
            asc=False,
        )
        rows = rows.join(context, list(KEY), "left")
        found = F.col("direction").isNotNull()
        rows = rows.withColumn("is_moving", F.when(found, F.col("direction") != "stationary"))
        rows = rows.withColumn("_top", F.when(moved, boosted).otherwise(F.col("_top"))).withColumn(
            "method", F.when(found, "frequency_band+doppler").otherwise("frequency_band")
        )
    return rows.select(
        *KEY,
        "class_name",
        F.col("_top")[0]["source"].alias("first_guess"),
        F.transform(
            "_top", lambda s: F.struct(s["source"].alias("class"), s["confidence"].alias("confidence"))
        ).alias("candidates"),
        "bands",
        "is_moving",
        "velocity_m_s",
        "direction",
        "method",
        *keep,
    )
