from zlib import crc32

import numpy as np
import pytest
from wavelark.llm import language_id as L

FOLDER = "/root/testdata/sf0.01"


def grams(text):
    codes = [32] + [max(ord(c), 32) for c in text.lower()]
    return {tuple(codes[i : i + n]) for n in range(1, L.GRAMS + 1) for i in range(len(codes) - n + 1)}


def test_presence_by_definition(monkeypatch):
    monkeypatch.setattr(L, "STRETCH", 7)
    spectrum = L.Spectrum()
    for text in ["", "a", "The cat sat on the mat", "über\tÜBER", "0" * 50]:
        # Buckets may join n-grams, never split one: as many as there are, but for a few that share.
        found, letters = spectrum.present(text)
        assert len(grams(text)) - 2 <= len(found) <= len(grams(text)) or not text
        assert letters == any(c.isalpha() for c in text)
    assert not spectrum.seen.any()


def test_folded_scores_equal_kernel_times_weights():
    rng = np.random.default_rng(0)
    marks = rng.random((5, L.BUCKETS)) < 0.001
    weights = rng.normal(size=(5, 3))
    model = L.Model(["a", "b", "c"], (marks.T.astype(float) @ weights).astype(np.float32), np.zeros(3))
    texts = [np.flatnonzero(rng.random(L.BUCKETS) < 0.001).astype(np.int32) for _ in range(4)]
    kernel = np.array([[marks[m][t].sum() for m in range(5)] for t in texts]) / np.sqrt([[len(t)] for t in texts])
    assert np.allclose(model.scores(texts), kernel @ weights, atol=1e-4)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    got = {r.doc_id: r for r in L.language_id(docs).collect()}
    known = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(known)
    out = [i for i in known if crc32(str(i).encode()) % 5 == 0]
    assert {i for i in got if got[i].held_out} == set(out)
    assert all(0 <= r.score <= 1 for r in got.values())
    assert np.mean([got[i].lang_pred == known[i] for i in out]) > 0.97


def test_labels_of_held_out_rows_are_never_read(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(300)
    other = docs.withColumn("lang", L.F.when(L.held_out("doc_id"), "xx").otherwise(L.F.col("lang")))
    rows = lambda d: sorted((r.doc_id, r.lang_pred, r.score) for r in L.language_id(d).collect())
    assert rows(docs) == rows(other)


def test_edges(spark):
    schema = "doc_id long, text string, lang string, score double"
    rows = [(i, "der hund und die katze " * 3, "de", 1.0) for i in range(20)]
    rows += [(i, "the dog and the cat " * 3, "en", 1.0) for i in range(20, 40)]
    rows += [(50, None, "en", 0.0), (51, "", "de", 0.0), (52, "123 !?", None, 0.0), (53, "the dog", None, 0.0)]
    rows += [(53, "the dog", None, 0.0), (None, "x" * 200000 + " the the", None, 0.0)]
    got = L.language_id(spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    named = {r.doc_id: r.lang_pred for r in got}
    assert [named[i] for i in (50, 51, 52, 53, 0, 20)] == ["und", "und", "und", "en", "de", "en"]
    nothing = spark.createDataFrame([(1, "abc", None, 0.0)], schema)
    assert [tuple(r) for r in L.language_id(nothing).collect()] == [(1, False, "und", 0.0)]
    assert L.language_id(spark.createDataFrame([], schema)).collect() == []
