"""Metadata and URL-list files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.operators.scan import index

# Metadata files tried below a dataset's folder, in this order.
METADATA_FILES = ("UrbanSound8K.csv", "esc50.csv", "meta.csv", "metadata.csv", "meta/esc50.csv")


def find_metadata(spark: SparkSession, base: str) -> str:
    """Path of the first metadata file that exists."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in METADATA_FILES:
        path = jvm.org.apache.hadoop.fs.Path(base, name)
        if path.getFileSystem(conf).exists(path):
            return path.toString()
    raise FileNotFoundError(f"no metadata file in {base}, tried {list(METADATA_FILES)}")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """CSV with header; every column stays text."""
    return spark.read.csv(path, header=True)


def numbered_urls(lines: DataFrame, base_name: str) -> DataFrame:
    """Non-blank lines with the output name ``<base>_<line number>.wav``.

    ``lines``: line_no (from 1, blank lines counted), value.
    """
    url = F.trim("value")
    return lines.filter(url != "").select(
        "line_no", url.alias("url"),
        F.concat(F.lit(base_name + "_"), F.col("line_no").cast("string"), F.lit(".wav")).alias("output_name"),
    )


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """URLs of a text file, one per line."""
    base = path.rstrip("/").rsplit("/", 1)[-1].rsplit(".", 1)[0]
    lines = spark.read.text(path).withColumn("_place", F.monotonically_increasing_id())
    numbered = index(lines, [], ["_place"], "line_no")
    return numbered_urls(numbered.withColumn("line_no", F.col("line_no") + 1), base)
