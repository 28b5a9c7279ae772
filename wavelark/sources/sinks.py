"""Partitioned tables of files, features and models."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.operators.dataset import only_new


def table_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def write_partitioned(df: DataFrame, path: str, by: Sequence[str], keys: Sequence[str]) -> None:
    """Append rows whose ``keys`` are not in the table yet; safe to run again.

    ``rebalance`` lets the runtime split a class that is too big for one task
    and merge small ones, so the table gets few and even files.
    """
    if table_exists(df.sparkSession, path):
        df = only_new(df, df.sparkSession.read.parquet(path), keys)
    df.hint("rebalance", *by).write.partitionBy(*by).mode("append").parquet(path)


def save_features(df: DataFrame, path: str) -> None:
    """Write features by class; a class that is there already is left alone."""
    rows = df.filter(F.col("features").isNotNull())
    write_partitioned(rows, path, ["class_name"], ["class_name"])


def load_features(spark: SparkSession, path: str, classes: Sequence[str] | None = None) -> DataFrame:
    """Features with the class from the partition; ``classes`` prunes partitions."""
    return select_classes(spark.read.parquet(path), classes)


def select_classes(features: DataFrame, classes: Sequence[str] | None) -> DataFrame:
    return features if classes is None else features.filter(F.col("class_name").isin(*classes))


def save_model(spark: SparkSession, model, folder: str, model_id: str, metrics: dict[str, float]) -> None:
    """Save a Spark ML model and add its row to the ``models`` table."""
    path = f"{folder}/{model_id}"
    model.write().overwrite().save(path)
    row = spark.createDataFrame(
        [(model_id, path, {k: float(v) for k, v in metrics.items()})],
        "model_id string, path string, metrics map<string,double>",
    )
    row.withColumn("created_at", F.current_timestamp()).coalesce(1).write.mode("append").parquet(f"{folder}/models")


def latest_model(models: DataFrame) -> DataFrame:
    """The row created last (ties: greatest id)."""
    columns = [c for c in models.columns]
    newest = F.max_by(F.struct(*columns), F.struct("created_at", "model_id"))
    return models.agg(newest.alias("newest")).select("newest.*")
