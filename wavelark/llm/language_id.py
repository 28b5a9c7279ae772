"""Language identification by a string kernel.

The kernel counts the n-grams two texts have in common, whatever their number
of occurrences (presence), for all lengths up to ``GRAMS`` together (blended
spectrum), divided by the geometric mean of each text with itself.  N-grams are
those of the whole lower-cased text, control characters read as blanks; they are
numbered by a hash of ``BUCKETS`` values, part of the kernel's definition.

Landmarks, some documents of each language, give the Nyström map; one ridge
regression per language is fitted on it against the rest.  A text's kernel
values with all landmarks times the weights is its score, so landmarks and
weights fold into one (bucket, language) matrix and a batch of texts is scored
by one matrix product.

Fitting reads at most ``LANDMARKS`` + ``SAMPLE`` labelled documents per
language, those with the smallest hash of (id, text); prediction reads every
text whole.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if there is nothing to learn from; null labels aren't learnt;
repeated rows are rows; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wavelark.llm.tables import map_text, written

#: Longest n-gram; buckets of the n-gram hash.
GRAMS = 4
BUCKETS = 1 << 18
#: Documents per language that serve as landmarks, and that the weights are fitted on.
LANDMARKS, SAMPLE = 40, 160
RIDGE = 1e-2
#: Keys of sampled rows (24 bytes each) that are sent to all executors.
FEW = 100_000
UNDETERMINED = "und"
#: Characters read at a time; texts in a product.
STRETCH, BATCH = 1 << 16, 64


class Spectrum:
    """N-gram buckets of texts."""

    def __init__(self):
        self.seen = np.zeros(BUCKETS, dtype=bool)

    def present(self, text: str) -> tuple[np.ndarray, bool]:
        """(buckets present, whether there is a letter), read a stretch at a time."""
        letters, tail = False, np.array([32], dtype=np.uint64)
        for start in range(0, len(text), STRETCH):
            part = text[start : start + STRETCH].lower()
            letters = letters or any(map(str.isalpha, part))
            codes = np.frombuffer(part.encode("utf-32-le", "replace"), dtype="<u4").astype(np.uint64)
            codes = np.concatenate([tail, np.maximum(codes, np.uint64(32))])
            mixed = np.zeros(len(codes), dtype=np.uint64)
            for n in range(1, GRAMS + 1):
                mixed = (mixed[: len(codes) - n + 1] ^ codes[n - 1 :]) * np.uint64(0x9E3779B97F4A7C15)
                mixed ^= mixed >> np.uint64(29)
                self.seen[(mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - 18)] = True
            tail = codes[1 - GRAMS :]
        found = np.flatnonzero(self.seen)
        self.seen[found] = False
        return found.astype(np.int32), letters


@dataclass
class Model:
    """``weights[bucket, language]``: landmarks and regression folded into one matrix; ``constant`` per language."""

    languages: list[str]
    weights: np.ndarray
    constant: np.ndarray

    def scores(self, present: list[np.ndarray]) -> np.ndarray:
        """Kernel values with the landmarks times the regression, a batch at once."""
        columns = np.unique(np.concatenate(present)) if present else np.zeros(0, dtype=np.int32)
        rows = np.zeros((len(present), len(columns)), dtype=np.float32)
        for row, buckets in zip(rows, present, strict=True):
            row[np.searchsorted(columns, buckets)] = 1.0
        norms = np.sqrt(np.maximum(rows.sum(axis=1), 1.0))
        return (rows @ self.weights[columns]) / norms[:, None] + self.constant


def _spectra(rows: DataFrame) -> DataFrame:
    """Sampled rows with ``text`` replaced by its buckets."""

    def make():
        spectrum = Spectrum()
        return lambda texts: [[spectrum.present(t)[0].tolist() for t in texts]]

    return map_text(rows, make, "buckets array<int>")


def training_sample(docs: DataFrame, usable: Column, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """(lang, place, buckets) of the rows with the smallest hash of each language.

    Ranks cut each language to a bounded number of rows before anything moves.
    """
    rows = docs.filter(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"),
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)).alias("key"),
    )
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    chosen = rows.select("lang", "key").withColumn("place", rank).filter(F.col("place") <= LANDMARKS + SAMPLE)
    keys = written(chosen.select("lang", "key").distinct())
    # LANDMARKS + SAMPLE keys per language; checked, as nothing bounds the languages.
    taken = rows.join(F.broadcast(keys) if keys.count() <= FEW else keys, ["lang", "key"])
    again = F.row_number().over(Window.partitionBy("lang").orderBy("key"))
    spectra = written(_spectra(taken))
    return spectra.withColumn("place", again).filter(F.col("place") <= LANDMARKS + SAMPLE).select("lang", "place", "buckets")


def _kernel(buckets: np.ndarray, landmarks: list[np.ndarray], marked: np.ndarray) -> np.ndarray:
    """Kernel values of one text with all landmarks; ``marked`` is all false before and after."""
    marked[buckets] = True
    shared = np.array([np.count_nonzero(marked[b]) / np.sqrt(len(b)) for b in landmarks])
    marked[buckets] = False
    return shared / np.sqrt(max(len(buckets), 1))


def fit(sample: DataFrame) -> Model | None:
    """Nyström landmarks and one-versus-rest kernel ridge regression."""
    marks = sorted(
        (r.lang, r.place, r.buckets) for r in sample.filter(F.col("place") <= LANDMARKS).collect() if r.buckets
    )
    if not marks:
        return None
    languages = sorted({lang for lang, _, _ in marks})
    landmarks = [np.array(buckets, dtype=np.int32) for _, _, buckets in marks]
    marked = np.zeros(BUCKETS, dtype=bool)
    among = np.array([_kernel(b, landmarks, marked) for b in landmarks])

    # Kernel values of the sample with the landmarks are made where its rows are.
    def against(batches):
        import pandas as pd

        marked = np.zeros(BUCKETS, dtype=bool)
        for batch in batches:
            out = [_kernel(np.asarray(b, dtype=np.int32), landmarks, marked).tolist() for b in batch["buckets"]]
            yield pd.DataFrame({"lang": batch["lang"], "place": batch["place"], "kernel": out})

    rows = sample.mapInPandas(against, "lang string, place int, kernel array<double>").collect()
    rows.sort(key=lambda r: (r.lang, r.place))
    values, vectors = np.linalg.eigh(among)
    kept = values > 1e-6 * values[-1]
    to_map = vectors[:, kept] / np.sqrt(values[kept])
    mapped = np.array([r.kernel for r in rows]) @ to_map
    target = np.array([[1.0 if r.lang == x else -1.0 for x in languages] for r in rows])
    mapped = np.hstack([mapped, np.ones((len(mapped), 1))])
    weight = 1.0 / np.array([sum(r.lang == x for r in rows) for x in [r.lang for r in rows]])
    weighted = mapped * weight[:, None]
    inner = weighted.T @ mapped
    solved = np.linalg.solve(inner + RIDGE * np.trace(inner) / len(inner) * np.eye(len(inner)), weighted.T @ target)
    folded = np.zeros((BUCKETS, len(languages)), dtype=np.float32)
    for buckets, row in zip(landmarks, to_map @ solved[:-1], strict=True):
        folded[buckets] += (row / np.sqrt(len(buckets))).astype(np.float32)
    return Model(languages, folded, solved[-1])


def predict(docs: DataFrame, model: Model | None, text_col: str = "text") -> DataFrame:
    """``docs`` with its ``text_col``, as ``text``, replaced by lang_pred and score."""

    def make():
        spectrum = Spectrum()

        def work(texts: list[str | None]) -> tuple[list[str], list[float]]:
            names, scores = [], []
            for start in range(0, len(texts), BATCH):
                found = [spectrum.present(t or "") for t in texts[start : start + BATCH]]
                if model is None:
                    names += [UNDETERMINED] * len(found)
                    scores += [0.0] * len(found)
                    continue
                made = model.scores([p for p, _ in found])
                best = made.argmax(axis=1)
                for (_, letters), row, at in zip(found, made, best, strict=True):
                    names.append(model.languages[at] if letters else UNDETERMINED)
                    scores.append(float(np.clip((row[at] + 1) / 2, 0, 1)) if letters else 0.0)
            return names, scores

        return work

    return map_text(docs.withColumnRenamed(text_col, "text"), make, "lang_pred string, score double")


def held_out(id_col: str) -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: (doc_id, held_out, lang_pred, score).

    Rows whose CRC-32 of the id is a multiple of 5 are held out of the fit; a
    null id is not held out.
    """
    out = F.coalesce(held_out(id_col), F.lit(False))
    model = fit(training_sample(docs, ~out, id_col, text_col, lang_col))
    source = docs.select(
        F.col(id_col).alias("doc_id"), out.alias("held_out"), F.col(text_col).cast("string").alias("text")
    )
    return predict(source, model)
