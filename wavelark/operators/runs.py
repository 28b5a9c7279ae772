"""Experiments, executions and the files they produced."""

from __future__ import annotations

from collections.abc import Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Parameter presets by name.
PRESETS = {
    "Urban Noise Detection": {
        "sampling_rate": 48000, "chunk_duration": 3.0, "click_threshold": 0.6, "window_size": 2048,
        "pitch_shift_range": [-1, 1], "noise_level": 0.05, "volume_adjustment": 0, "mfcc_coefficients": 13,
        "learning_rate": 0.0005, "batch_size": 64, "classification_threshold": 0.8,
        "clustering_method": "dbscan", "directional_inference": "omnidirectional",
    },
    "Wildlife Monitoring": {
        "sampling_rate": 44100, "chunk_duration": 10.0, "click_threshold": 0.9, "window_size": 4096,
        "pitch_shift_range": [-3, 3], "noise_level": 0.02, "volume_adjustment": 3, "mfcc_coefficients": 20,
        "learning_rate": 0.001, "batch_size": 32, "classification_threshold": 0.9,
        "clustering_method": "hierarchical", "directional_inference": "beamforming",
    },
    "Industrial Sound Analysis": {
        "sampling_rate": 96000, "chunk_duration": 2.0, "click_threshold": 0.5, "window_size": 1024,
        "pitch_shift_range": [0, 0], "noise_level": 0.1, "volume_adjustment": -2, "mfcc_coefficients": 16,
        "learning_rate": 0.002, "batch_size": 128, "classification_threshold": 0.7,
        "clustering_method": "kmeans", "directional_inference": "multi_directional",
    },
    "Music Analysis": {
        "sampling_rate": 44100, "chunk_duration": 5.0, "click_threshold": 0.7, "window_size": 2048,
        "pitch_shift_range": [-5, 5], "noise_level": 0.01, "volume_adjustment": 0, "mfcc_coefficients": 25,
        "learning_rate": 0.0008, "batch_size": 48, "classification_threshold": 0.85,
        "clustering_method": "kmeans", "directional_inference": "stereo_analysis",
    },
}


def newest_first(rows: DataFrame, time: str = "created_at", tie: str = "id") -> DataFrame:
    return rows.orderBy(F.desc(time), F.desc(tie))


def latest_values(log: DataFrame, columns: list[str], version: str = "version") -> DataFrame:
    """Current state of every id from an append-only change log.

    A null in a change leaves that column as it was; a change marked
    ``deleted`` removes the id for good.
    """
    current = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in columns]
    state = log.groupBy("id").agg(*current, F.max("deleted").alias("_gone"))
    return state.filter(~F.coalesce(F.col("_gone"), F.lit(False))).drop("_gone")


def by_id(rows: DataFrame, wanted) -> DataFrame:
    return rows.filter(F.col("id") == wanted)


def without_deleted(children: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    """Rows of ``children`` whose parent is not in ``deleted`` (column id)."""
    gone = deleted.select(F.col("id").alias(key)).distinct()
    return children.join(gone, key, "left_anti")


def executions_of(executions: DataFrame, experiment_id) -> DataFrame:
    return newest_first(executions.filter(F.col("experiment_id") == experiment_id), "started_at")


def latest_execution(executions: DataFrame) -> DataFrame:
    """Newest execution per experiment; an aggregate, so busy ones do not queue."""
    newest = F.max_by(F.struct("id", "started_at", "status"), F.struct("started_at", "id"))
    return executions.groupBy("experiment_id").agg(newest.alias("e")).select("experiment_id", "e.*")


def run_summary(experiments: DataFrame, executions: DataFrame, files: DataFrame) -> DataFrame:
    """Executions, files and bytes per experiment.

    Files are added up per execution and executions per experiment before each
    join, so the joins only see one row per key.
    """
    sizes = files.groupBy("execution_id").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("file_size").alias("bytes")
    )
    per_run = executions.join(sizes, F.col("id") == F.col("execution_id"), "left")
    per_experiment = per_run.groupBy("experiment_id").agg(
        F.count(F.lit(1)).alias("n_executions"),
        F.sum(F.coalesce("n_files", F.lit(0))).alias("n_files"),
        F.sum(F.coalesce("bytes", F.lit(0))).alias("bytes"),
    )
    return (
        experiments.join(per_experiment, F.col("id") == F.col("experiment_id"), "left")
        .drop("experiment_id")
        .fillna(0, ["n_executions", "n_files", "bytes"])
    )


def stage_inventory(files: DataFrame) -> DataFrame:
    return files.groupBy("module_stage").agg(
        F.count(F.lit(1)).alias("n_files"), F.sum("file_size").alias("bytes")
    )


def json_number(text: Column | str, field: str) -> Column:
    """Number in a JSON text; null when it is absent or not a number."""
    return F.get_json_object(text, f"$.{field}").try_cast("double")


def parse_config(text: Column | str) -> Column:
    """JSON object as a map of texts."""
    return F.from_json(text, "map<string,string>")


def apply_preset(defaults: Column, preset: Column) -> Column:
    """Defaults with the preset's values on top, key by key."""
    return F.map_from_entries(
        F.concat(
            F.filter(F.map_entries(defaults), lambda e: ~F.array_contains(F.map_keys(preset), e["key"])),
            F.map_entries(preset),
        )
    )


def literal_map(values: Mapping[str, object]) -> Column:
    return F.create_map(*[F.lit(str(x)) for pair in values.items() for x in pair])


def session_summary(events: DataFrame, gap: str = "30 minutes", sensor: str = "sensor_id") -> DataFrame:
    """Processed chunks, mean latency and detections per session of a sensor.

    Rows of a sensor within one stretch as long as the gap belong to one
    session, so they are first aggregated per stretch, map-side too.  Only the
    stretches, whose number depends on the time covered and not on the rows, are
    ordered per sensor.  Decimal latencies are added exactly, whatever the
    grouping.  Streams use ``session_rollup``.
    """
    length = F.lit(int(pd.Timedelta(gap).total_seconds() * 1_000_000)).cast("long")
    kind = events.schema["ts"].dataType
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    stretches = events.groupBy(sensor, F.floor(at / length).alias("_stretch")).agg(
        F.min(at).alias("_first"), F.max(at).alias("_last"), F.count(F.lit(1)).alias("processed"),
        F.sum("latency").alias("_latency"), F.count("latency").alias("_timed"), F.count_if(F.col("detected")).alias("detections"),
    )
    order = Window.partitionBy(sensor).orderBy("_stretch")
    fresh = F.coalesce(F.col("_first") - F.lag("_last").over(order) >= length, F.lit(True))
    sessions = stretches.withColumn("_fresh", fresh.cast("int")).withColumn("_session", F.sum("_fresh").over(order))
    return sessions.groupBy(sensor, "_session").agg(
        F.timestamp_micros(F.min("_first")).cast(kind).alias("started"),
        F.timestamp_micros(F.max("_last") + length).cast(kind).alias("ended"),
        F.sum("processed").alias("processed"),
        (F.sum("_latency").cast("double") / F.sum("_timed")).alias("mean_latency"),
        F.sum("detections").alias("detections"),
    ).drop("_session")


def session_windows(events: DataFrame, gap: str = "30 minutes", sensor: str = "sensor_id") -> DataFrame:
    """``session_summary`` by Spark's session windows, for streams: state is per sensor and session."""
    return (
        events.groupBy(sensor, F.session_window("ts", gap).alias("session"))
        .agg(
            F.count(F.lit(1)).alias("processed"),
            F.avg("latency").alias("mean_latency"),
            F.count_if(F.col("detected")).alias("detections"),
        )
        .select(sensor, F.col("session.start").alias("started"), F.col("session.end").alias("ended"),
                "processed", "mean_latency", "detections")
    )
