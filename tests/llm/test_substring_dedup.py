import hashlib
import random

import numpy as np
import pytest
from wavelark.llm import substring_dedup as S

SCHEMA = "doc_id long, text string, lo int, spans string"


def slow(rows):
    """By definition: every window of every document."""
    first = {}
    split = [(d, (t or "").encode().split()) for d, t in rows]
    for d, words in split:
        for i in range(len(words) - S.WINDOW + 1) if d is not None else ():
            key = tuple(words[i : i + S.WINDOW])
            first[key] = min(first.get(key, d), d)
    out = []
    for d, words in split:
        gone = [False] * len(words)
        for i in range(len(words) - S.WINDOW + 1) if d is not None else ():
            if first[tuple(words[i : i + S.WINDOW])] < d:
                gone[i : i + S.WINDOW] = [True] * S.WINDOW
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((d, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def fast(spark, rows):
    docs = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], SCHEMA).repartition(3)
    got = S.substring_dedup(docs).collect()
    return sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str)


@pytest.mark.parametrize("seed", range(3))
def test_against_all_windows(spark, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)] + ["the"] * 40
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [text(n) for n in (49, 50, 51, 60, 75, 120, 300)] + [["x"] * 90, ["a", "b"] * 60]
    rows = [(7, None), (8, ""), (9, " \t "), (10, "one two"), (10, "one two")]
    for i in range(60):
        parts = text(rng.randint(0, 60))
        for _ in range(rng.randint(0, 3)):
            p = rng.choice(passages)
            lo = rng.randint(0, 5) if rng.random() < 0.5 else 0
            parts = parts + p[lo : len(p) - rng.randint(0, 5) * (rng.random() < 0.5)] + text(rng.randint(0, 30))
        rows.append((rng.randint(20, 70), rng.choice([" ", "\n", " \t "]).join(parts)))
    whole = " ".join(text(200))
    rows += [(i, whole) for i in (100, 101, 102, 102)] + [(90, " ".join(["pre"] + whole.split()[:120])), (None, whole)]
    assert fast(spark, rows) == slow(rows)


def test_first_blocks_are_windows_partition():
    rng = np.random.default_rng(0)
    for n in (50, 51, 74, 75, 76, 500):
        codes = rng.integers(0, 30, n).astype(np.uint64)
        lo, hi, _, _ = S.blocks(codes)
        covered = [s for a, b in zip(lo, hi, strict=True) for s in range(a, b + 1)]
        assert covered == list(range(n - 49))


def test_documents_and_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = S.substring_dedup(docs, keep_text=True).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got), key=str) == slow(rows)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_empty_table(spark):
    assert fast(spark, []) == []
