"""Queries over files that Spark writes from the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from wavelark.plans.registry import query
from wavelark.session import shared_folder
from wavelark.sources import adapters as A


@query(
    "recording_ranges",
    """WITH e AS (
    SELECT vec_id // 256 AS rec, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS j FROM embeddings),
  n AS (SELECT rec, v, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY rec) AS n_total FROM e
    WINDOW w AS (PARTITION BY rec ORDER BY vec_id, j))
  SELECT rec::VARCHAR AS recording, n_total, i // 1000 * 1000 AS start, count(*)::INTEGER AS own, min_by(v, i) AS first,
    max_by(v, i) AS last, min(v) AS lowest, max(v) AS highest FROM n GROUP BY ALL""",
)
def recording_ranges(spark, folder):
    """256 vectors at a time are one recording; files are written, then read by ranges of 1000 samples."""
    from wavelark.sources.ranges import read_ranges, save_wav, scan_headers

    parts = F.sort_array(F.collect_list(F.struct("vec_id", "embedding")))
    recordings = A.table(spark, folder, "embeddings").groupBy(F.floor(F.col("vec_id") / 256).alias("rec")).agg(
        parts.alias("parts")
    ).select(
        F.col("rec").cast("string").alias("recording_id"), F.lit("all").alias("class_name"), F.lit(16384).alias("sr"),
        F.flatten(F.col("parts.embedding")).alias("samples"),
    )
    home = f"{shared_folder(spark)}/wavelark-wav-{uuid.uuid4().hex}"
    save_wav(recordings, home).write.format("noop").mode("overwrite").save()
    own = F.slice("samples", 1, F.col("own"))
    return read_ranges(scan_headers(spark, home), chunk=1000, halo=100).select(
        F.regexp_extract("recording_id", r"([0-9]+)\.wav$", 1).alias("recording"), "n_total", "start", "own",
        F.element_at("samples", 1).alias("first"), F.element_at(own, -1).alias("last"),
        F.array_min(own).alias("lowest"), F.array_max(own).alias("highest"),
    )
