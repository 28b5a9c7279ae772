"""Corpus pipeline: five operators of ``wavelark.llm`` over ``documents``, in order.

Every stage takes all documents its predecessor kept.  All but the last return
the columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.llm import exact_dedup as exact
from wavelark.llm import language_id as language
from wavelark.llm import packing, pii, simhash
from wavelark.llm.tables import table, written

#: Score from which a predicted language outweighs the label.
CERTAIN = 0.95

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Language identification, boosted trees and packing are beyond SQL;
#: tests/llm/test_pipeline.py follows the stages by brute force.
ORACLE_SQL = None


def _packed(docs: DataFrame) -> DataFrame:
    """(text, _row): all columns in one struct, whatever their names."""
    return docs.select("text", F.struct("*").alias("_row"))


def _marked(docs: DataFrame) -> DataFrame:
    """(_id, text, _row) with an id that orders by doc_id, null last, and tells texts of one doc_id apart."""
    mark = F.xxhash64(F.col("text")).alias("mark")
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", mark)
    return docs.select(one.alias("_id"), "text", F.struct("*").alias("_row"))


def _only(marked: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents of ``marked``, one row for each of ``ids`` (_id, rows with it)."""
    joined = marked.select("_id", "_row").join(ids, "_id")
    single = joined.filter("n = 1")
    several = joined.filter("n > 1").dropDuplicates(["_id"])
    return single.unionByName(several).select("_row.*")


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and texts surely of another learnt language than their label.

    Texts fall by hash into two halves, and each is judged by the model fitted
    on the other, so no label speaks for itself or for its copies.  Surely means
    a score of ``CERTAIN`` or more.  Texts without a label, or with one that was
    not learnt, can't contradict it and stay.
    """
    return reduce(DataFrame.unionByName, [_agreeing(docs, half) for half in (0, 1)])


def _agreeing(docs: DataFrame, half: int) -> DataFrame:
    """The rows of one half that the other half's model lets stay."""
    own = F.pmod(F.xxhash64("text"), F.lit(2)) == half
    model = language.fit(language.training_sample(docs, ~own, "doc_id", "text", "lang"))
    if model is None:
        return docs.filter(own & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    named = language.predict(_packed(docs.filter(own)), model)
    label = F.col("_row.lang").cast("string")
    other = label.isin(model.languages) & (F.col("lang_pred") != label) & (F.col("score") >= CERTAIN)
    kept = (F.col("lang_pred") != language.UNDETERMINED) & ~F.coalesce(other, F.lit(False))
    return named.filter(kept).select("_row.*")


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of equal texts."""
    marked = _marked(docs)
    found = exact.exact_dedup(marked, id_col="_id")
    ids = found.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("kept").alias("kept")).filter("kept")
    return _only(marked, ids.select(F.col("doc_id").alias("_id"), "n"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of linked fingerprints."""
    marked = _marked(docs)
    found = simhash.simhash_groups(marked, id_col="_id")
    ids = found.filter("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("n"))
    return _only(marked, ids.select(F.col("doc_id").alias("_id"), "n"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars counts the new text."""
    others = [c for c in docs.columns if c != "text"]
    packed = docs.select("text", F.struct(*[docs[f"`{c}`"] for c in others]).alias("_row"))
    new = pii.redact(packed)
    columns = [F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns]
    return new.select(*columns).withColumn("n_chars", F.char_length("text").cast("long"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all documents into sequences."""
    return packing.best_fit_packing(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_stage),
    ("exact_dedup", exact_stage),
    ("simhash_near_dedup", simhash_stage),
    ("pii", pii_stage),
    ("best_fit_packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage over ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
