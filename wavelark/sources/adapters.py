"""Views of the star-schema test tables as signals, samples, features and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.operators.scan import index
from wavelark.session import materialise


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def signals_from_embeddings(spark: SparkSession, folder: str, sr: int = 16384) -> DataFrame:
    """Every vector is one short single-channel recording."""
    samples = F.transform("embedding", lambda x: x.cast("double"))
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("recording_id"),
        F.concat(F.lit("class_"), F.col("label").cast("string")).alias("class_name"),
        F.lit(0).alias("channel"),
        F.lit(sr).alias("sr"),
        F.size("embedding").cast("long").alias("n_total"),
        F.lit(0).cast("long").alias("start"),
        F.size("embedding").alias("own"),
        samples.alias("samples"),
    )


def stereo_from_embeddings(spark: SparkSession, folder: str, sr: int = 16384) -> DataFrame:
    """Vectors 2k and 2k+1 are the two channels of recording k."""
    vec = F.col("recording_id").cast("long")
    return signals_from_embeddings(spark, folder, sr).withColumns(
        {
            "channel": (vec % 2).cast("int"),
            "recording_id": F.floor(vec / 2).cast("string"),
        }
    )


def samples_from_events(spark: SparkSession, folder: str) -> DataFrame:
    """Every user is a sensor; values in time order are its samples."""
    events = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("recording_id"), "ts", "event_id", "value", "event_type"
    )
    indexed = index(events, ["recording_id"], ["ts", "event_id"])
    return indexed.select(
        "recording_id", F.lit(0).alias("channel"), F.lit(1).alias("sr"), "idx", "value", "ts", "event_type"
    )


def features_from_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "embeddings").select(
        F.col("vec_id").cast("string").alias("recording_id"),
        F.concat(F.lit("class_"), F.col("label").cast("string")).alias("class_name"),
        F.transform("embedding", lambda x: x.cast("double")).alias("features"),
    )


def recordings_from_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as a catalogue: the source is a folder, the language a class."""
    name = F.concat(F.lit("rec_"), (F.col("doc_id") % 500).cast("string"), F.lit(".wav"))
    path = F.concat(F.lit("/audio/"), "source", F.lit("/"), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("/"), name)
    return table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("recording_id"),
        path.alias("path"),
        name.alias("file_name"),
        F.col("lang").alias("class_name"),
        "source",
        (F.col("n_chars") * 2).alias("bytes"),
    )


def metadata_from_documents(spark: SparkSession, folder: str) -> DataFrame:
    """File-to-class rows as a metadata CSV would give them."""
    return table(spark, folder, "documents").join(table(spark, folder, "labels"), "doc_id").select(
        F.concat(F.lit(" rec_"), F.col("doc_id").cast("string"), F.lit(".wav ")).alias("filename"),
        F.concat_ws(" ", "lang", F.concat(F.lit("Quality "), F.col("quality").cast("string"))).alias("category"),
        "source",
    )


def recordings_from_pages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "pages").select(
        F.col("page_id").cast("string").alias("recording_id"), F.col("url").alias("path")
    )


def experiments_from_customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("status"),
        F.col("c_acctbal").alias("score"),
    )


def executions_from_orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("experiment_id"),
        F.col("o_orderdate").alias("started_at"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_totalprice").alias("cost"),
        F.to_json(F.struct(F.col("o_totalprice").alias("cost"), F.col("o_orderpriority").alias("priority"))).alias("metrics"),
    )


def files_from_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("execution_id"),
        F.concat_ws("_", "l_partkey", "l_linenumber").alias("file_name"),
        F.col("l_quantity").cast("long").alias("file_size"),
        F.concat_ws("/", "l_returnflag", "l_linestatus").alias("module_stage"),
    )


def pack_samples(
    samples: DataFrame, chunk: int, halo: int = 0, totals: DataFrame | None = None
) -> DataFrame:
    """Long samples (recording_id, channel, sr, idx, value) as signal chunks.

    A group is one chunk plus its halo, whatever the length of the recording.
    ``totals`` (recording_id, channel, n_total) saves counting the samples.
    """
    keys = ["recording_id", "channel"]
    if totals is None:
        totals = samples.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_total"))
    home = F.floor(F.col("idx") / chunk)
    back = F.ceil(F.greatest(F.lit(halo) - F.col("idx") % chunk, F.lit(0)) / chunk)
    routed = samples.withColumn("_chunk", F.explode(F.sequence(F.greatest(home - back, F.lit(0)), home)))
    packed = routed.groupBy(*keys, "sr", "_chunk").agg(
        F.array_sort(F.collect_list(F.struct("idx", F.col("value").cast("double").alias("value")))).alias("_parts"),
        F.count_if(home == F.col("_chunk")).cast("int").alias("own"),
    )
    return packed.join(totals, keys).select(
        "recording_id", F.lit("sensor").alias("class_name"), "channel", "sr", "n_total",
        (F.col("_chunk") * chunk).cast("long").alias("start"), "own",
        F.transform("_parts", lambda p: p["value"]).alias("samples"),
    )


def signals_from_events(spark: SparkSession, folder: str, chunk: int = 4096, halo: int = 1024) -> DataFrame:
    """Sensor values as signals of one sample per second.

    Packing is the ingest step of these recordings: the table is written once
    and operators read it as they would read any signals table.
    """
    sensor = F.col("user_id").cast("string").alias("recording_id")
    totals = table(spark, folder, "events").groupBy(sensor, F.lit(0).alias("channel")).agg(
        F.count(F.lit(1)).alias("n_total")
    )
    return materialise(pack_samples(samples_from_events(spark, folder), chunk, halo, totals))
