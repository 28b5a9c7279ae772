"""Combine and threshold class probabilities (long form: class_name, p)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def soft_vote(models: list[DataFrame]) -> DataFrame:
    """Mean probability over models per recording and class.

    Each model gives rows (recording_id, class_name, p); a class it leaves out
    counts as 0.
    """
    rows = reduce(DataFrame.unionByName, models)
    return rows.groupBy("recording_id", "class_name").agg((F.sum("p") / len(models)).alias("p"))


def best_class(probabilities: DataFrame) -> DataFrame:
    """Most probable class and its probability; ties go to the smaller name."""
    best = F.min(F.struct((-F.col("p")).alias("rank"), F.col("class_name"), F.col("p")))
    return probabilities.groupBy("recording_id").agg(best.alias("b")).select(
        "recording_id", F.col("b.class_name").alias("prediction"), F.col("b.p").alias("confidence")
    )


def threshold_labels(probabilities: DataFrame, threshold: float = 0.5, multi: bool = True) -> DataFrame:
    """Classes at or above the threshold; only the best one unless ``multi``."""
    kept = probabilities.filter(F.col("p") >= threshold)
    if multi:
        return kept.select("recording_id", "class_name", "p")
    best = best_class(kept)
    return best.select("recording_id", F.col("prediction").alias("class_name"), F.col("confidence").alias("p"))
