"""Quality gate: duration, level and signal-to-noise per recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions.levels import SILENCE, dbfs, energy, zero_crossings
from wavelark.functions.text import fixed
from wavelark.model import FilterConfig
from wavelark.operators.framing import frames, seconds_to_samples
from wavelark.operators.ordered import counted, distinct_counts

KEY = ["recording_id", "channel"]


def duration_s(n_total: Column | str = "n_total", sr: Column | str = "sr") -> Column:
    n_total, sr = (F.col(c) if isinstance(c, str) else c for c in (n_total, sr))
    return n_total / sr


def duration_verdict(duration: Column, config: FilterConfig) -> Column:
    return (
        F.when(duration < config.min_duration_s, F.concat(F.lit("too_short ("), fixed(duration, 2), F.lit("s)")))
        .when(duration > config.max_duration_s, F.concat(F.lit("too_long ("), fixed(duration, 2), F.lit("s)")))
    )


def with_rms_dbfs(signals: DataFrame) -> DataFrame:
    """One row per channel with its RMS and level; chunks add up map-side."""
    power = energy(F.slice("samples", 1, F.col("own")))
    return (
        signals.groupBy(*KEY, "class_name", "sr", "n_total")
        .agg(F.sum(power).alias("_power"))
        .withColumn("rms", F.sqrt(F.col("_power") / F.col("n_total")))
        .withColumn("rms_db", dbfs(F.col("rms")))
        .drop("_power")
    )


def frame_levels(cut: DataFrame) -> DataFrame:
    """RMS and zero-crossing rate per frame."""
    n = F.size("samples")
    return cut.select(
        *KEY, "frame_idx",
        F.sqrt(energy(F.col("samples")) / n).alias("rms"),
        (zero_crossings(F.col("samples")) / n).alias("zcr"),
    )


def snr_db(signals: DataFrame, noise_fraction: float = 0.1) -> DataFrame:
    """Estimate of the signal-to-noise ratio per channel.

    The quietest ``noise_fraction`` of the 25 ms frames (at least one) is taken
    as noise.  Equal energies are counted before they are ordered, and the order
    runs in buckets, so one long recording does not become one task.
    """
    length, hop = seconds_to_samples(0.025), seconds_to_samples(0.010)
    count = F.when(F.col("n_total") >= length, F.floor((F.col("n_total") - length) / hop) + 1).otherwise(0)
    levels = frames(signals, length, hop, count).select(*KEY, energy(F.col("samples")).alias("energy"))
    distinct = distinct_counts(levels, KEY, "energy")
    totals = distinct.groupBy(*KEY).agg(
        F.sum("n").alias("_n"), (F.sum(F.col("energy") * F.col("n")) / F.sum("n")).alias("_mean")
    )
    quietest = F.greatest(F.lit(1), F.floor(F.col("_n") * noise_fraction))
    ranked = counted(distinct, KEY, "energy").join(
        totals.select(*KEY, "_mean", quietest.alias("_k")), KEY
    )
    taken = F.least(F.col("n"), F.col("_k") - F.col("below"))
    noise = (
        ranked.filter(F.col("below") < F.col("_k"))
        .groupBy(*KEY, "_mean", "_k")
        .agg((F.sum(F.col("energy") * taken) / F.first("_k")).alias("_noise"))
    )
    ratio = F.when(F.col("_noise") < SILENCE, 100.0).otherwise(
        10 * F.log10(F.col("_mean") / F.col("_noise"))
    )
    return noise.select(*KEY, ratio.alias("snr_db"))


def quality_gate(signals: DataFrame, config: FilterConfig = FilterConfig(), errors: DataFrame | None = None) -> DataFrame:
    """Verdict per channel; ``reason`` is the first failing check.

    ``errors`` (recording_id, class_name, error) are inputs that could not be
    decoded.  The SNR, the costly check, only sees recordings whose duration
    passes.
    """
    levels = with_rms_dbfs(signals).withColumn("duration_s", duration_s())
    bad_duration = duration_verdict(F.col("duration_s"), config)
    level = F.col("rms_db")
    reason = (
        F.when(bad_duration.isNotNull(), bad_duration)
        .when(level < config.min_rms_db, F.concat(F.lit("too_quiet ("), fixed(level, 1), F.lit(" dBFS)")))
        .when(level > config.max_rms_db, F.concat(F.lit("clipped ("), fixed(level, 1), F.lit(" dBFS)")))
    )
    if config.min_snr_db is None:
        rows = levels.withColumn("snr_db", F.lit(None).cast("double"))
    else:
        fits = signals.filter(duration_s().between(config.min_duration_s, config.max_duration_s))
        rows = levels.join(snr_db(fits), KEY, "left")
        snr = F.col("snr_db")
        reason = reason.when(snr < config.min_snr_db, F.concat(F.lit("low_snr ("), fixed(snr, 1), F.lit(" dB)")))
    rows = rows.withColumn("reason", reason.otherwise("ok"))
    if errors is not None:
        failed = errors.select(
            "recording_id", "class_name", F.concat(F.lit("load_error: "), "error").alias("reason")
        )
        rows = rows.unionByName(failed, allowMissingColumns=True)
    return rows.withColumn("passed", F.col("reason") == "ok")


def quality_report(gated: DataFrame) -> DataFrame:
    """Accepted and rejected per class, classes without any accepted included."""
    return gated.groupBy("class_name").agg(
        F.count_if(F.col("passed")).alias("accepted"), F.count_if(~F.col("passed")).alias("rejected")
    )


def accepted(signals: DataFrame, gated: DataFrame) -> DataFrame:
    """Signals of recordings that passed."""
    return signals.join(gated.filter("passed").select(*KEY), KEY, "left_semi")


def length_guard(n_samples: Column, minimum: int = 1024) -> Column:
    """Route for a live chunk: too short ones are not featurised."""
    return F.when(n_samples < minimum, "too_short").otherwise("featurise")
