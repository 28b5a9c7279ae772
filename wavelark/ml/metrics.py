"""Evaluation of predictions (columns class_name and prediction)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame) -> DataFrame:
    """Rows per (actual, predicted) pair."""
    return df.groupBy("class_name", "prediction").agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, labels: list[str]) -> DataFrame:
    """One row per actual class, one column per label."""
    return df.groupBy("class_name").pivot("prediction", labels).agg(F.count(F.lit(1))).fillna(0)


def accuracy(df: DataFrame) -> DataFrame:
    hit = F.count_if(F.col("class_name") == F.col("prediction"))
    return df.agg(F.count(F.lit(1)).alias("n"), F.try_divide(hit, F.count(F.lit(1))).alias("accuracy"))


def class_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; 0 where undefined."""
    hit = F.when(F.col("class_name") == F.col("prediction"), 1).otherwise(0)
    sides = F.array(
        F.struct(F.col("class_name").alias("label"), F.lit(1).alias("actual"), F.lit(0).alias("predicted"), hit.alias("hit")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).alias("actual"), F.lit(1).alias("predicted"), F.lit(0).alias("hit")),
    )
    sums = (
        df.select(F.explode(sides).alias("s"))
        .groupBy(F.col("s.label").alias("label"))
        .agg(F.sum("s.actual").alias("support"), F.sum("s.predicted").alias("_predicted"), F.sum("s.hit").alias("_hit"))
    )
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    rows = sums.withColumn("precision", share(F.col("_hit"), F.col("_predicted")))
    rows = rows.withColumn("recall", share(F.col("_hit"), F.col("support")))
    both = F.col("precision") + F.col("recall")
    return rows.select(
        "label", "precision", "recall",
        share(2 * F.col("precision") * F.col("recall"), both).alias("f1"), "support",
    )


def average_report(report: DataFrame) -> DataFrame:
    """Macro and support-weighted averages of a class report."""
    names = ("precision", "recall", "f1")
    macro = [F.avg(n).alias(f"macro_{n}") for n in names]
    weighted = [(F.sum(F.col(n) * F.col("support")) / F.sum("support")).alias(f"weighted_{n}") for n in names]
    return report.agg(*macro, *weighted, F.sum("support").alias("support"))
