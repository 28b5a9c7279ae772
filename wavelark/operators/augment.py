"""Which variants to make, and the transforms that make them."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions.levels import SILENCE
from wavelark.functions.text import stem, variant_name
from wavelark.model import AugmentConfig
from wavelark.operators.ordered import top_k
from wavelark.operators.quality import with_rms_dbfs

KEY = ["recording_id", "channel"]


def parameter_grid(recordings: DataFrame, kind: str, params: Sequence[float]) -> DataFrame:
    """Every recording with every parameter; the grid is a literal on each row."""
    values = F.array(*[F.lit(float(p)) for p in params])
    rows = recordings.select("*", F.posexplode(values).alias("variant_idx", "param"))
    named = variant_name(stem("file_name"), F.lit(kind), F.col("param"))
    return rows.withColumn("kind", F.lit(kind)).withColumn("out_name", F.concat(named, F.lit(".wav")))


def augmentation_plan(recordings: DataFrame, config: AugmentConfig = AugmentConfig()) -> DataFrame:
    """Variants to create, class by class, until each class reaches the target.

    Files are taken by name; each contributes its first variants up to the cap.
    Since every file gives the same number, only ``target / cap`` files of a
    class can matter, and those are found by a salted top-k.
    """
    variants = config.variants()[: config.max_augments_per_file]
    if not variants:
        return recordings.limit(0).selectExpr(
            "class_name", "recording_id", "file_name", "'' AS kind", "0D AS param",
            "0 AS variant_idx", "0L AS created_idx", "'' AS out_name",
        )
    per_file = len(variants)
    target = config.target_samples_per_class
    sizes = recordings.groupBy("class_name").agg(F.count(F.lit(1)).alias("_existing"))
    files = top_k(
        recordings.select("class_name", "recording_id", "file_name"),
        ["class_name"], ["file_name", "recording_id"], math.ceil(target / per_file), "recording_id", "_place",
    )
    grid = F.array(
        *[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("param")) for k, p in variants]
    )
    rows = files.join(sizes, "class_name").select("*", F.posexplode(grid).alias("variant_idx", "_v"))
    created = ((F.col("_place") - 1) * per_file + F.col("variant_idx")).cast("long")
    rows = rows.withColumn("created_idx", created).filter(F.col("created_idx") < target - F.col("_existing"))
    name = variant_name(stem("file_name"), F.col("_v.kind"), F.col("_v.param"))
    return rows.select(
        "class_name", "recording_id", "file_name", "_v.kind", "_v.param", "variant_idx", "created_idx",
        F.concat(name, F.lit(".wav")).alias("out_name"),
    )


def augmentation_counts(plan: DataFrame) -> DataFrame:
    return plan.groupBy("class_name").agg(F.count(F.lit(1)).alias("created"))


def with_originals(recordings: DataFrame, plan: DataFrame) -> DataFrame:
    """Original files and planned variants in one listing."""
    originals = recordings.select("class_name", F.col("file_name").alias("out_name"), F.lit("original").alias("kind"))
    return originals.unionByName(plan.select("class_name", "out_name", "kind"))


def scale_volume(signals: DataFrame, db: float | Column) -> DataFrame:
    """Amplitude by ``db`` decibels, without clipping."""
    factor = F.pow(F.lit(10.0), (db if isinstance(db, Column) else F.lit(float(db))) / 20.0)
    return signals.withColumn("_k", factor).withColumn(
        "samples", F.transform("samples", lambda x: x * F.col("_k"))
    ).drop("_k")


def reverse_signal(signals: DataFrame) -> DataFrame:
    """Each chunk is turned around and moves to the mirrored place (no halo)."""
    return signals.withColumns(
        {
            "start": F.col("n_total") - F.col("start") - F.col("own"),
            "samples": F.reverse(F.slice("samples", 1, F.col("own"))),
        }
    )


def uniform(seed: int, *parts: Column) -> Column:
    """Number in (0, 1) that depends only on the parts, not on partitioning."""
    bits = F.shiftrightunsigned(F.xxhash64(*parts, F.lit(seed)), 11)
    return (bits.cast("double") + 0.5) / float(1 << 53)


def gaussian(seed: int, *parts: Column) -> Column:
    radius = F.sqrt(-2 * F.log(uniform(seed, *parts, F.lit("r"))))
    return radius * F.cos(2 * math.pi * uniform(seed, *parts, F.lit("a")))


def add_noise(signals: DataFrame, snr_db: float | Column, seed: int = 42) -> DataFrame:
    """White noise at the given ratio to the channel's RMS; silence stays as is.

    The noise of a sample depends on recording, channel, place and seed, so it
    is the same in every chunk's halo and after a lost executor.
    """
    ratio = snr_db if isinstance(snr_db, Column) else F.lit(float(snr_db))
    levels = with_rms_dbfs(signals).select(*KEY, "rms")
    rows = signals.join(levels, KEY).withColumn("_sigma", F.col("rms") / F.pow(F.lit(10.0), ratio / 20.0))
    noisy = F.transform(
        "samples",
        lambda x, i: x + F.col("_sigma") * gaussian(seed, F.col("recording_id"), F.col("channel"), F.col("start") + i),
    )
    return rows.withColumn(
        "samples", F.when(F.col("rms") < SILENCE, F.col("samples")).otherwise(noisy)
    ).drop("rms", "_sigma")


def mask_spectrum(
    spectra: DataFrame, freq_width: int = 0, time_width: int = 0, seed: int = 42, power: str = "power"
) -> DataFrame:
    """Silence one band of bins and one run of frames per channel.

    Offsets come from a hash of the channel, so every frame of a recording
    gets the same mask without a lookup.
    """
    bins = F.size(power)
    place = uniform(seed, F.col("recording_id"), F.col("channel"), F.lit("f"))
    low = F.floor(place * F.greatest(bins - freq_width + 1, F.lit(1)))
    rows = spectra
    if freq_width:
        rows = rows.withColumn("_low", low).withColumn(
            power,
            F.transform(power, lambda x, i: F.when(i.between(F.col("_low"), F.col("_low") + freq_width - 1), 0.0).otherwise(x)),
        ).drop("_low")
    if time_width:
        total = F.col("n_frames")
        begin = F.floor(
            uniform(seed, F.col("recording_id"), F.col("channel"), F.lit("t")) * F.greatest(total - time_width + 1, F.lit(1))
        )
        hidden = F.col("frame_idx").between(begin, begin + time_width - 1)
        rows = rows.withColumn(
            power, F.when(hidden, F.transform(power, lambda x: F.lit(0.0))).otherwise(F.col(power))
        )
    return rows


def apply_plan(signals: DataFrame, plan: DataFrame, seed: int = 42, n_fft: int = 2048, hop: int = 512) -> DataFrame:
    """Signals of all planned variants; ``recording_id`` becomes the variant's name.

    One join brings plan and signals together; kinds differ only in the
    transform, and pitch and stretch share the vocoder through a rate column.
    """
    from wavelark.operators.vocoder import resample, time_stretch

    wanted = plan.select("recording_id", "kind", "param", "out_name")
    rows = signals.join(wanted, "recording_id").withColumn("recording_id", F.col("out_name")).drop("out_name")
    kind = F.col("kind")
    plain = ["recording_id", "class_name", "channel", "sr", "n_total", "start", "own", "samples"]
    loud = scale_volume(rows.filter(kind == "volume"), F.col("param")).select(plain)
    noisy = add_noise(rows.filter(kind == "noise"), F.col("param"), seed).select(plain)
    turned = reverse_signal(rows.filter(kind == "reversed")).select(plain)
    slow = time_stretch(
        rows.filter(kind == "stretch").withColumn("rate", F.col("param")), None, n_fft, hop
    ).select(plain)
    bent = rows.filter(kind == "pitch").withColumn("rate", F.pow(F.lit(2.0), -F.col("param") / 12))
    shifted = resample(time_stretch(bent, None, n_fft, hop, keep=["rate", "length"], halo=1)).select(plain)
    return loud.unionByName(noisy).unionByName(turned).unionByName(slow).unionByName(shifted)
