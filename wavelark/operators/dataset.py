"""Catalogue work: names, labels, reviews, splits and what is already there."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions.text import clean_text, normalise_class
from wavelark.model import AUDIO_EXTENSIONS
from wavelark.operators.ordered import running

# Column names tried in a metadata file, first match wins.
FILE_COLUMNS = ("slice_file_name", "filename", "fname", "file", "audio_filename")
CLASS_COLUMNS = ("class", "category", "label", "classID", "class_name", "target")


def is_audio(path: Column, exts: Iterable[str] = AUDIO_EXTENSIONS) -> Column:
    names = [e.lower().lstrip(".") for e in exts]
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(names)


def dedupe_by_name(recordings: DataFrame) -> DataFrame:
    """One recording per file name, the first by path.

    An aggregate, not a window: copies of one name shrink to one row before the
    shuffle.
    """
    kept = recordings.groupBy("file_name").agg(
        F.min_by(F.struct(*recordings.columns), F.col("path")).alias("kept")
    )
    return kept.select("kept.*")


def duplicate_names(recordings: DataFrame) -> DataFrame:
    """Recordings that ``dedupe_by_name`` leaves out."""
    first = recordings.groupBy("file_name").agg(F.min("path").alias("path"))
    return recordings.join(first, ["file_name", "path"], "left_anti")


def relative_path(path: Column, root: str) -> Column:
    prefix = root.rstrip("/") + "/" if root else ""
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def with_class_from_path(recordings: DataFrame, root: str = "") -> DataFrame:
    """First folder below ``root`` is the class; files at the top have none."""
    inside = relative_path(F.col("path"), root)
    folder = F.when(F.instr(inside, "/") > 0, F.substring_index(inside, "/", 1))
    return recordings.withColumn("class_name", F.coalesce(folder, F.lit("unclassified")))


def listing(recordings: DataFrame) -> DataFrame:
    """Recordings by class, then name."""
    return recordings.orderBy("class_name", "file_name", "path")


def audio_dirs(recordings: DataFrame, root: str, exts: Iterable[str] = AUDIO_EXTENSIONS) -> DataFrame:
    """Folders directly below ``root`` with the number of audio files in them."""
    inside = F.split(relative_path(F.col("path"), root), "/")
    return (
        recordings.filter(is_audio(F.col("path"), exts))
        .select(inside.alias("_parts"))
        .filter(F.size("_parts") == 2)
        .groupBy(F.col("_parts")[0].alias("directory"))
        .agg(F.count(F.lit(1)).alias("n_files"))
    )


def detect_columns(columns: Sequence[str]) -> tuple[str, str]:
    """Names of the file and the class column."""
    found = []
    for what, candidates in (("file", FILE_COLUMNS), ("class", CLASS_COLUMNS)):
        name = next((c for c in candidates if c in columns), None)
        if name is None:
            raise ValueError(f"no {what} column among {list(columns)}")
        found.append(name)
    return found[0], found[1]


def metadata_rows(metadata: DataFrame, file_col: str | None = None, class_col: str | None = None) -> DataFrame:
    """Metadata as trimmed text columns ``file_name`` and ``class_name``."""
    if file_col is None or class_col is None:
        file_col, class_col = detect_columns(metadata.columns)
    return metadata.select(clean_text(file_col).alias("file_name"), clean_text(class_col).alias("class_name"))


def homogenise(
    recordings: DataFrame, metadata: DataFrame, file_col: str | None = None, class_col: str | None = None
) -> DataFrame:
    """Recordings labelled by their metadata row, each (class, file) once."""
    wanted = metadata_rows(metadata, file_col, class_col).distinct()
    return dedupe_by_name(recordings).drop("class_name").join(wanted, "file_name")


def unmatched(metadata: DataFrame, recordings: DataFrame) -> DataFrame:
    """Metadata rows whose file was not found."""
    names = recordings.select("file_name").distinct()
    return metadata_rows(metadata).join(names, "file_name", "left_anti")


def class_counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("class_name").agg(F.count(F.lit(1)).alias("n_files"))


def class_totals(labelled: DataFrame) -> DataFrame:
    """Total files and number of classes, from the per-class counts."""
    return class_counts(labelled).agg(
        F.sum("n_files").alias("total"), F.count(F.lit(1)).alias("n_classes")
    )


def relabel(recordings: DataFrame, mapping: DataFrame) -> DataFrame:
    """Give each directory its mapped class; directories may share one.

    ``mapping``: directory, new_class.
    """
    names = mapping.select("directory", normalise_class("new_class").alias("class_name"))
    return recordings.drop("class_name").join(names, "directory")


def only_new(df: DataFrame, existing: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key is not in the target yet."""
    return df.join(existing.select(*keys), list(keys), "left_anti")


def kept_chunks(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    """Chunks a reviewer kept, with the class they were given."""
    keep = decisions.filter(F.col("decision") == "keep").select("path", "class_name").distinct()
    return chunks.drop("class_name").join(keep, "path")


def without_deleted(chunks: DataFrame, decisions: DataFrame) -> DataFrame:
    gone = decisions.filter(F.col("decision") == "delete").select("path")
    return chunks.join(gone, "path", "left_anti")


def decision_tally(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("decision").agg(F.count(F.lit(1)).alias("n"))


def shuffled_rank(df: DataFrame, key: str, class_col: str, seed: int) -> DataFrame:
    """Add ``rank``: position in a seeded order of each class, from 0.

    The order is an MD5 of seed and key.  Its first three digits cut every
    class into 4096 even buckets, so a huge class is ranked in parallel.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    rows = df.withColumn("_digest", digest)
    ranked = running(
        rows, [class_col], F.substring("_digest", 1, 3), ["_digest", key], {"rank": F.lit(1).cast("long")}
    )
    return ranked.drop("_digest")


def assign_splits(
    df: DataFrame,
    key: str = "recording_id",
    class_col: str = "class_name",
    test: float = 0.15,
    val: float = 0.15,
    seed: int = 42,
) -> DataFrame:
    """Add ``split``: per class a hold-out is taken first and then halved.

    Classes under six files give one file each to test and validation.
    """
    hold = test + val
    sizes = df.groupBy(class_col).agg(F.count(F.lit(1)).alias("_n"))
    held = F.ceil(F.lit(hold) * F.col("_n"))
    in_test = F.ceil(F.lit(1 - val / hold) * held)
    ranked = shuffled_rank(df, key, class_col, seed).join(sizes, class_col)
    split = (
        F.when(F.col("_n") < 6, F.when(F.col("rank") == 0, "test").when(F.col("rank") == 1, "validation").otherwise("train"))
        .when(F.col("rank") < in_test, "test")
        .when(F.col("rank") < held, "validation")
        .otherwise("train")
    )
    return ranked.withColumn("split", split).drop("_n", "rank")


def train_test(
    df: DataFrame, key: str = "recording_id", class_col: str | None = "class_name", test: float = 0.2, seed: int = 42
) -> DataFrame:
    """Add ``split`` (train/test), stratified unless ``class_col`` is None."""
    group = class_col or "_every"
    rows = df if class_col else df.withColumn(group, F.lit(0))
    sizes = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = shuffled_rank(rows, key, group, seed).join(sizes, group)
    split = F.when(F.col("rank") < F.ceil(F.lit(test) * F.col("_n")), "test").otherwise("train")
    return ranked.withColumn("split", split).drop("_n", "rank", "_every")


def split_report(df: DataFrame, class_col: str = "class_name") -> DataFrame:
    """Files per (split, class), per split and in total; null marks a subtotal."""
    return df.rollup("split", class_col).agg(F.count(F.lit(1)).alias("n_files"))
