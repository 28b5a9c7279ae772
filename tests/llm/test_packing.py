import itertools
import random
from collections import Counter
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from wavelark.llm import packing as K

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("seed", range(8))
def test_fullest_against_all_subsets(seed):
    rng = random.Random(seed)
    items = [rng.randint(1, 30) for _ in range(9)]
    room = rng.randint(1, 80)
    best = max(sum(c) for n in range(10) for c in itertools.combinations(items, n) if sum(c) <= room)
    used = K.fullest(dict(Counter(items)), room)
    assert sum(used) == best and not Counter(used) - Counter(items)


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_each_piece_once(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 64), 64, 7]) for _ in range(3000))
    plan = K.packing_plan(dict(counts), 64)
    used = Counter()
    for times, lengths in plan:
        assert sum(lengths) <= 64 and times > 0
        for length in lengths:
            used[length] += times
    assert used == counts
    assert sum(t for t, _ in plan) <= 1.01 * sum(k * n for k, n in counts.items()) / 64 + 1


def check(rows, texts, capacity):
    """Rows are the pieces of the texts and fill sequences without gaps."""
    library = Tokenizer.from_file(PATH)
    want = Counter()
    for doc, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), capacity)):
            part = np.array(ids[start : start + capacity], dtype="<u4")
            want[(doc, piece, start, len(part), crc32(part.tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), key=lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= capacity


@pytest.mark.parametrize("ranked", [3, 20_000])
def test_table(spark, monkeypatch, ranked):
    monkeypatch.setattr(K, "RANKED", ranked)
    rng = random.Random(1)
    alphabet = " \n \x1c\x1f\x85 abcdeéñÀ̀'stl129.,!?ΣΣ ßİ中😀-_/<|>"
    texts = [None, "", " ", "a", "a", "<|endoftext|> x<|startoftext|>Y", "The End. " * 400, "z" * 5000, "Σας ΟΔΟΣ ǅ ŉ ﬁ"]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(150)]
    rows = [(i // 2, t, 5) for i, t in enumerate(texts)]  # ids repeat
    docs = spark.createDataFrame(rows, "doc_id long, text string, length int").repartition(3)
    got = K.best_fit_packing(docs, PATH, capacity=32).collect()
    check(got, [(i, t) for i, t, _ in rows], 32)


def test_words_by_pieces_are_the_librarys():
    library, encoder = Tokenizer.from_file(PATH), K._encoder(PATH)
    rng = random.Random(3)
    every = "".join(map(chr, range(0x21, 0x100)))
    words = [c for c in every] + ["'S", "l'été", "'ll've'd", "<|endoftext|>x", "STRASSE'Tß", "ªºµ", "×÷", "e\u0301", "İI", "ſ'ſ", "a" * 3000]
    words += ["".join(rng.choice(rng.choice((every, "aeÉß'stld19", "e'İ\u0301ʼnΣ中"))) for _ in range(rng.randint(1, 12))) for _ in range(20_000)]
    words = sorted({w for w in words if len(w.split()) == 1 and w.split()[0] == w})
    want = [np.array(f.ids, dtype="<u4").tobytes() for f in library.encode_batch_fast(words, add_special_tokens=False)]
    assert encoder.make(words) == want


def test_new_plain_words_do_not_pass_the_whole_library(monkeypatch):
    passed = []

    class Counting:
        def __init__(self, inner):
            self.inner, self.model = inner, inner.model

        @classmethod
        def from_file(cls, path):
            return cls(Tokenizer.from_file(path))

        def encode_batch_fast(self, words, **options):
            passed.extend(words)
            return self.inner.encode_batch_fast(words, **options)

    monkeypatch.setattr("tokenizers.Tokenizer", Counting)
    monkeypatch.setattr(K, "kept_in_worker", lambda key, make: make())
    encoder = K._encoder(PATH)
    encoder.values([f"Wörter{i}." for i in range(100)] + ["<|a|>", "中"])
    assert sorted(passed) == ["<|a|>", "中"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert K.best_fit_packing(docs, PATH).collect() == []


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = K.best_fit_packing(docs, PATH).collect()
    check(rows, [(r.doc_id, r.text) for r in docs.collect()], K.CAPACITY)
    total = sum(r.length for r in rows)
    assert len({r.sequence_id for r in rows}) <= 1.02 * total / K.CAPACITY + 1
