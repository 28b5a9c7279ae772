"""Toxicity by multiple-instance learning.

A document is a bag of sentences; its label says that at least one of them is
toxic, not which.  A sentence's score is 1 - exp(-rate), its rate the sum of
the rates of its different words, a word's rate the sum of the weights of the
word and of its beginnings of ``SHORTEST`` to ``LONGEST`` letters.  Sentences are
combined by noisy-or with a leak that stands for labels without any cause in
the text:

    score = 1 - exp(-leak) * product(1 - score of sentence)

With weights that aren't negative the likelihood of the document labels is
concave; it is raised by multiplicative (expectation-maximisation) steps.  A
penalty keeps weights at zero that few toxic documents speak for, so a long
clean document doesn't add up many small scores.  Sentences of high score are
the offending ones.

The fit reads at most ``ROWS`` documents per label, those with the smallest
hash of (id, text) among the ones of at most ``FIT_CHARS`` characters, and
weighs them by the number of labelled documents of each label; every document
is scored whole, however long.

Defined results: a null text counts as empty and gets the leak's score; rows
without a label of 0 or 1 teach nothing; of several labels of one id the largest
counts; a null id has no label and isn't held out; without a toxic label every
score is 0; repeated rows are rows; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.llm.tables import Memo, map_text, slices, written

#: Documents per label in the fit, and the longest of them in characters.
ROWS, FIT_CHARS = 2500, 16_384
#: Lengths of the beginnings of words; documents a beginning must occur in.
SHORTEST, LONGEST, SEEN = 3, 8, 3
#: Weight of the penalty in toxic documents; steps of the fit.
PENALTY, STEPS = 2.0, 200
TOXIC = 0.7
#: Sentences at or above this score are reported.
OFFENDING = 0.3

WORD = re.compile(r"\w+")
#: Ends a sentence; the next one starts behind it.
END = re.compile(r"[.!?\n]+\s*")


def word_features(word: str) -> list[str]:
    """The word, marked, and its beginnings."""
    return [f"{word}$", *[word[:k] for k in range(SHORTEST, min(LONGEST, len(word)) + 1)]]


def sentences(text: str):
    """(start, end) of every sentence that isn't empty, read a stretch at a time."""
    for start, stop in slices(text, END):
        at = start
        for found in END.finditer(text, start, stop):
            if found.start() > at:
                yield at, found.start()
            at = found.end()
        if stop > at:
            yield at, stop


def _features(text: str) -> tuple[list[str], list[int]]:
    """Features of a document and in how many words of its sentences each occurs."""
    count: dict[str, int] = {}
    for start, end in sentences(text):
        for word in set(WORD.findall(text[start:end].lower())):
            for name in word_features(word):
                count[name] = count.get(name, 0) + 1
    return list(count), list(count.values())


@dataclass
class Model:
    """Weights of words and beginnings, all above zero, and the leak."""

    weights: dict[str, float]
    leak: float

    def rate(self, word: str) -> float:
        return sum(self.weights.get(name, 0.0) for name in word_features(word))


def held_out(id_col: str) -> Column:
    """Documents kept out of the fit."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_sample(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> tuple[DataFrame, dict[int, int]]:
    """(key, label, name, times) of the sampled documents, and the number of labelled documents per label.

    Only ids and hashes meet the labels; the keys chosen, at most ``ROWS`` per
    label, are sent to where the texts are.
    """
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.col(label_col).cast("int")).alias("label")
    )
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.filter(~held_out(id_col)).select(
        F.col(id_col).alias("id"), text.alias("text"), F.xxhash64(F.col(id_col).cast("string"), text).alias("key")
    )
    known = written(rows.select("id", "key", F.char_length("text").alias("chars")).join(marks, "id").select("key", "label", "chars"))
    number = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    place = F.row_number().over(Window.partitionBy("label").orderBy("key"))
    short = known.filter(F.col("chars") <= FIT_CHARS).select("key", "label").distinct()
    chosen = written(short.withColumn("place", place).filter(F.col("place") <= ROWS).drop("place"))
    # At most ROWS keys per label, two labels: a bound that holds for any table.
    taken = rows.select("key", "text").join(F.broadcast(chosen), "key").dropDuplicates(["key", "label"])
    made = map_text(taken, lambda: lambda texts: [list(c) for c in zip(*map(_features, texts))], "names array<string>, times array<int>")
    return written(made), number


def fit(sample: DataFrame, number: dict[int, int]) -> Model | None:
    """Weights and leak; None without toxic documents.

    A weight can only rise above zero for what occurs in toxic documents, so
    other features aren't brought to the driver.
    """
    size = {r.label: r.n for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not size.get(1):
        return None
    pairs = sample.select("key", "label", F.explode(F.arrays_zip("names", "times")).alias("one"))
    names = pairs.filter("label = 1").groupBy(F.col("one.names").alias("name")).count().filter(F.col("count") >= SEEN)
    names = written(names.select("name", F.monotonically_increasing_id().alias("id")))
    ordered = names.orderBy("id").toArrow().column("name").to_pylist()
    found = pairs.select("key", "label", F.col("one.names").alias("name"), F.col("one.times").alias("times")).join(names, "name")
    table = found.select("key", "label", "id", "times").toArrow().combine_chunks()
    key, label, ids, times = (table.column(c).to_numpy() for c in ("key", "label", "id", "times"))
    if not ordered:
        return Model({}, float(-np.log1p(-min(number[1] / sum(number.values()), 0.999))))
    place = np.unique(ids)  # ids rise with the order of ``ordered``
    feature = np.searchsorted(place, ids)
    bag = np.unique(np.stack([label.astype(np.int64), key], axis=1), axis=0, return_inverse=True)
    weights, leak = _raised(bag[1].ravel(), bag[0][:, 0] == 1, feature, times.astype(float), len(ordered), size, number)
    kept = np.flatnonzero(weights > 1e-4)
    return Model({ordered[i]: float(weights[i]) for i in kept}, leak)


def _raised(
    bag: np.ndarray, toxic: np.ndarray, feature: np.ndarray, times: np.ndarray, features: int,
    size: dict[int, int], number: dict[int, int],
) -> tuple[np.ndarray, float]:
    """Weights and leak after ``STEPS`` expectation-maximisation steps.

    ``bag``, ``feature``, ``times`` are the entries of the matrix of documents
    and features; documents without an entry matter to the leak only.
    """
    # A toxic document weighs one; the others stand for all of their label.
    clean = (number.get(0, 0) / number[1]) * (size[1] / max(size.get(0, 0), 1))
    weight = np.where(toxic, 1.0, clean)
    expected = np.bincount(feature, times * weight[bag], features) + PENALTY
    total = size[1] + clean * size.get(0, 0)
    without = size[1] - int(toxic.sum())
    weights, leak = np.full(features, 0.01), 0.02
    mine = toxic[bag]
    bag1, feature1, times1 = bag[mine], feature[mine], times[mine]
    for _ in range(STEPS):
        rate = leak + np.bincount(bag1, weights[feature1] * times1, len(toxic))
        cause = np.where(toxic, 1 / -np.expm1(-np.maximum(rate, 1e-12)), 0.0)
        weights = weights * np.bincount(feature1, times1 * cause[bag1], features) / expected
        leak = min(leak * (cause.sum() + without / -np.expm1(-max(leak, 1e-12))) / total, 20.0)
    return weights, float(leak)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", offending: float = OFFENDING) -> DataFrame:
    """``docs`` with its ``text_col``, as ``text``, replaced by score and the offending sentences.

    Sentences are (start, end, score), in code points, end exclusive.
    """

    def make():
        if model is None:
            return lambda texts: [[0.0] * len(texts), [[] for _ in texts]]
        rates = Memo(1 << 17, lambda words: [model.rate(w) for w in words])

        def one(text: str) -> tuple[float, list[dict]]:
            rate, found = model.leak, []
            for begin, stop in slices(text, END):
                part = text[begin:stop].lower()
                words = list(set(WORD.findall(part)))
                if not any(rates.values(words)):
                    continue
                for start, end in sentences(text[begin:stop]):
                    inner = list(set(WORD.findall(text[begin + start : begin + end].lower())))
                    own = sum(rates.values(inner))
                    rate += own
                    if -np.expm1(-own) >= offending:
                        found.append({"start": begin + start, "end": begin + end, "score": float(-np.expm1(-own))})
            return float(-np.expm1(-rate)), found

        return lambda texts: [list(c) for c in zip(*[one(t or "") for t in texts])] or [[], []]

    added = "score double, sentences array<struct<start:long,end:long,score:double>>"
    return map_text(docs.withColumnRenamed(text_col, "text"), make, added)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic"
) -> DataFrame:
    """One row per document: (doc_id, held_out, score, predicted, sentences)."""
    sample, number = training_sample(docs, labels, id_col, text_col, label_col)
    model = fit(sample, number)
    source = docs.select(
        F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    scored = score(source, model)
    return scored.select(
        "doc_id", "held_out", "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"), "sentences"
    )
