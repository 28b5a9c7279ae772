"""Standardisation with population deviations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Scaler:
    """Mean and deviation per position: one number each per feature."""

    mean: list[float]
    std: list[float]

    def transform(self, df: DataFrame, column: str = "features") -> DataFrame:
        """Scaled values; a constant feature becomes 0."""
        mean, std = (F.array(*[F.lit(float(v)) for v in part]) for part in (self.mean, self.std))
        centred = F.zip_with(F.col(column), mean, lambda x, m: x - m)
        scaled = F.zip_with(centred, std, lambda x, s: F.when(s > 0, x / s).otherwise(0.0))
        return df.withColumn(column, scaled)


def fit_scaler(df: DataFrame, column: str = "features") -> Scaler:
    """One pass over the table; only the per-position numbers reach the driver."""
    summary = Summarizer.metrics("mean", "variance", "count").summary(array_to_vector(column))
    row = df.agg(summary.alias("s")).select(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("var"), "s.count"
    ).first()
    n = row["count"]
    spread = [max(v * (n - 1) / n, 0.0) ** 0.5 for v in row["var"]]
    return Scaler(list(row["mean"]), [s if s > 1e-12 else 0.0 for s in spread])


def standardise(df: DataFrame, column: str = "features") -> DataFrame:
    return fit_scaler(df, column).transform(df, column)
