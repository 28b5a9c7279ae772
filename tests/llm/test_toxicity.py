import math
import zlib

import numpy as np
import pytest
from wavelark.llm import toxicity as T

SF = "/root/testdata/sf0.1"
NAMES = "doc_id long, text string, lang string, score string, label int, key int, sentences int"


def tables(spark, docs, labels):
    rows = [(*d, "x", "clash", 1, 2, 3) for d in docs]
    return (
        spark.createDataFrame(rows, NAMES).repartition(3),
        spark.createDataFrame(labels, "doc_id long, toxic int"),
    )


def corpus(n=600, seed=1):
    """Texts of several sentences; a toxic one holds one bad sentence somewhere."""
    rng = np.random.default_rng(seed)
    words = [f"w{i:03d}" for i in range(400)]
    docs, labels, bad = [], [], {}
    for i in range(n):
        parts = [" ".join(rng.choice(words, rng.integers(3, 9))) for _ in range(rng.integers(1, 9))]
        if i % 4 == 0:
            place = int(rng.integers(len(parts)))
            parts[place] += " Nasty" + str(rng.choice(["ness", "ly", "er"]))
            bad[i] = sum(len(p) + 2 for p in parts[:place])
        docs.append((i, ". ".join(parts)))
        labels.append((i, int(i in bad)))
    return docs, labels, bad


def test_finds_offending_sentences(spark):
    docs, labels, bad = corpus()
    got = {r.doc_id: r for r in T.toxicity(*tables(spark, docs, labels)).collect()}
    assert len(got) == len(docs)
    for i, text in docs:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and r.predicted == int(i in bad) == int(r.score >= 0.7)
        assert [s.start for s in r.sentences] == ([bad[i]] if i in bad else [])
        for s in r.sentences:
            assert "Nasty" in text[s.start : s.end] and "." not in text[s.start : s.end]


def test_score_is_noisy_or(spark):
    model = T.Model({"bad$": 0.5, "nas": 0.25, "nasty$": 1.0}, 0.1)
    docs = [(1, "Bad. bad bad! Nasty nasal"), (2, None), (3, ""), (4, "bad"), (5, "good\nsome")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in T.score(frame, model, offending=0.0).collect()}
    one = lambda rate: 1 - math.exp(-rate)
    sentence = [one(0.5), one(0.5), one(0.25 + 1.0 + 0.25)]
    assert abs(got[1].score - (1 - math.exp(-0.1) * np.prod([1 - s for s in sentence]))) < 1e-12
    assert [(s.start, s.end) for s in got[1].sentences] == [(0, 3), (5, 12), (14, 25)]
    assert np.allclose([s.score for s in got[1].sentences], sentence)
    for i in (2, 3, 5):
        assert abs(got[i].score - one(0.1)) < 1e-12
    assert abs(got[4].score - one(0.6)) < 1e-12


def test_likelihood_rises():
    """Steps raise the penalised likelihood of the labels up to a point no weight can improve on."""
    rng = np.random.default_rng(2)
    n, k = 300, 30
    table = rng.poisson(0.15, size=(n, k))
    toxic = rng.random(n) < -np.expm1(-(0.05 + table @ np.where(np.arange(k) < 3, 1.5, 0)))
    bag, feature = np.nonzero(table)
    times = table[bag, feature].astype(float)
    size = number = {0: int((~toxic).sum()), 1: int(toxic.sum())}

    def value(weights, leak):
        rate = leak + table @ weights
        return np.log(-np.expm1(-rate[toxic])).sum() - rate[~toxic].sum() - T.PENALTY * weights.sum()

    used = np.zeros(n, dtype=bool)
    used[bag] = True
    assert used.sum() > 250
    keep = np.flatnonzero(used)
    place = np.searchsorted(keep, bag)
    found, steps = [], T.STEPS
    for count in (1, 5, 50, steps):
        T.STEPS = count
        try:
            found.append(T._raised(place, toxic[keep], feature, times, k, size, number))
        finally:
            T.STEPS = steps
    values = [value(*f) for f in found]
    assert values == sorted(values)
    weights, leak = found[-1]
    for i in range(k):
        for move in (-0.02, 0.02):
            other = weights.copy()
            other[i] = max(other[i] + move, 0)
            assert value(other, leak) <= values[-1] + 1e-2
    assert weights[:3].min() > 0.8 > 0.4 > weights[3:].max()


def test_defined_cases(spark):
    docs, labels, _ = corpus(200)
    more = [(1000, None), (1001, ""), (1002, "nastyly " * 3), (1002, "nastyly " * 3), (None, "Nastyness"), (1003, "w001 " * 700_000), (1004, "x" * 3_000_000)]
    got = T.toxicity(*tables(spark, docs + more, labels + [(2, None), (3, 7), (1002, 1), (1002, 0), (5000, 1)])).collect()
    assert len(got) == 207
    by = {r.doc_id: r for r in got}
    assert by[None].held_out is False and by[None].predicted == 1
    leak = by[1000].score
    assert 0 <= leak < 0.2 and all(abs(by[i].score - leak) < 1e-9 for i in (1001, 1004)) and by[1003].predicted == 0
    assert len({(r.score, r.predicted) for r in got if r.doc_id == 1002}) == 1
    for marks in ([], [(i, 0) for i in range(9)]):
        assert {r.score for r in T.toxicity(*tables(spark, docs[:9], marks)).collect()} == {0.0}
    only = T.toxicity(*tables(spark, docs[:9], [(i, 1) for i in range(9)])).collect()
    assert all(0 <= r.score <= 1 for r in only)
    empty = T.toxicity(*tables(spark, [], labels))
    assert empty.collect() == [] and empty.columns == ["doc_id", "held_out", "score", "predicted", "sentences"]


@pytest.fixture(scope="module")
def held(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    scored = T.toxicity(docs, labels)
    return scored.join(labels.select("doc_id", "toxic"), "doc_id").join(docs.select("doc_id", "text"), "doc_id").collect()


def test_held_out_accuracy(held):
    rows = [r for r in held if r.held_out]
    score, toxic = np.array([r.score for r in rows]), np.array([r.toxic == 1 for r in rows])
    wins = (score[toxic][:, None] > score[~toxic][None, :]) + 0.5 * (score[toxic][:, None] == score[~toxic][None, :])
    flagged = score >= T.TOXIC
    print("auc", wins.mean(), "precision", toxic[flagged].mean(), "recall", flagged[toxic].mean())
    assert wins.mean() > 0.93
    assert toxic[flagged].mean() > 0.93 and flagged[toxic].mean() > 0.7
    assert all(r.sentences for r in rows if r.predicted and r.score > 0.9)
