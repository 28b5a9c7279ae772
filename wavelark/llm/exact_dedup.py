"""Exact dedup by deterministic block naming, in DataFrame functions only.

A normalised text is cut into blocks of ``BLOCK`` bytes.  Equal blocks get the
same integer name: block keys are sorted and numbered.  Then adjacent names are
paired, the pairs are sorted and numbered in turn, and so on until each text
has one name.  Two texts of as many blocks have the same last name exactly
when they are equal (Karp, Miller and Rosenberg's naming).

The pairs are integers, so naming them can't collide.  The key a block is
sorted by is its SHA-256; blocks whose key occurs more than once are compared
byte by byte, and the job ends in an error if two different ones share a key.
So texts travel only where a block repeats, and there as one copy per task.

Defined results: null counts as empty, an empty text has one empty block,
repeated rows are copies of each other (of rows with the same id and text one
is kept), an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.llm.tables import BLANKS, shuffle_parts, text_of, written

#: Bytes in a block.
BLOCK = 1 << 14


def normalised(text: Column) -> Column:
    """Each run of blanks as one space."""
    return F.regexp_replace(text, f"[{BLANKS}]+", " ")


def _blocks(data: Column, size: int) -> Column:
    """Blocks of ``size`` bytes; an empty text has one empty block."""
    last = F.greatest(F.octet_length(data) - 1, F.lit(0))
    starts = F.sequence(F.lit(0), (last / size).cast("int"))
    return F.transform(starts, lambda i: F.substring(data, i * size + 1, F.lit(size)))


def name_sorted(keys: DataFrame, columns: list[str], level: int = 0) -> DataFrame:
    """Distinct ``columns`` and their integer ``name``, which follows their order.

    The numbers are made once and written: later reads see the same ones.
    """
    parts = shuffle_parts(keys.sparkSession)
    ordered = keys.select(*columns).distinct().repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    return written(ordered.withColumn("name", F.monotonically_increasing_id()), _files(keys, level))


def _files(df: DataFrame, level: int) -> int:
    """Partitions to write: each level has half the names of the one before."""
    spark = df.sparkSession
    return max(spark.sparkContext.defaultParallelism, shuffle_parts(spark) >> level)


def _checked_keys(pieces: DataFrame, contents: DataFrame) -> DataFrame:
    """Distinct block keys; an error where one key stands for two different blocks."""
    repeated = pieces.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    compared = (
        contents.join(repeated, "key", "left_semi")
        .groupBy("key")
        .agg(F.min("block").alias("low"), F.max("block").alias("high"))
        .select("key", F.when(F.col("low") != F.col("high"), F.raise_error(F.lit("two blocks share a key"))).alias("odd"))
        .filter("odd is null")
        .select("key")
    )
    return pieces.select("key").union(compared)


def block_names(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(row, id, text_sha256, n_blocks, name): equal (n_blocks, name) means equal text."""
    data = docs.select(
        F.col(id_col).alias("id"), normalised(text_of(text_col)).cast("binary").alias("data")
    ).select("id", "data", _blocks(F.col("data"), block).alias("blocks"))
    rows = written(
        data.select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.sha2("data", 256).alias("text_sha256"),
            F.transform("blocks", lambda b: F.unhex(F.sha2(b, 256))).alias("keys"),
        )
    )
    pieces = rows.select("row", F.size("keys").alias("n"), F.posexplode("keys").alias("place", "key"))
    contents = data.select(F.explode("blocks").alias("block")).select(F.unhex(F.sha2("block", 256)).alias("key"), "block")
    names = name_sorted(_checked_keys(pieces, contents), ["key"])
    level = written(pieces.join(names, "key").select("row", "n", "place", "name", F.col("n").alias("left")))
    done, depth = level.filter("left = 1"), 0
    while True:
        depth += 1
        open_ = level.filter("left > 1")
        if open_.isEmpty():
            break
        half = F.floor(F.col("place") / 2)
        pairs = written(
            open_.groupBy("row", "n", half.cast("int").alias("half"), F.ceil(F.col("left") / 2).cast("int").alias("rest"))
            .agg(
                F.max(F.when(F.col("place") % 2 == 0, F.col("name"))).alias("first"),
                F.coalesce(F.max(F.when(F.col("place") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
            ),
            _files(docs, depth),
        )
        level = pairs.join(name_sorted(pairs, ["first", "second"], depth), ["first", "second"]).select(
            "row", "n", F.col("half").alias("place"), "name", F.col("rest").alias("left")
        )
        done = done.unionByName(level.filter("left = 1"))
    return rows.select("row", "id", "text_sha256").join(
        done.select("row", F.col("n").alias("n_blocks"), "name"), "row"
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row per document: (doc_id, keep_id, group_size, kept, text_sha256, n_blocks, block_name).

    The row with the smallest id of a group stays; a null id counts as larger
    than any other.
    """
    named = written(block_names(docs, id_col, text_col, block))
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    groups = named.groupBy("n_blocks", "name").agg(F.min(order).alias("best"), F.count("*").alias("group_size"))
    return named.join(groups, ["n_blocks", "name"]).select(
        F.col("id").alias("doc_id"),
        F.col("best.id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        "text_sha256",
        F.col("n_blocks").cast("long").alias("n_blocks"),
        F.col("name").alias("block_name"),
    )
