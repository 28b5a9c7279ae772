"""Single texts of 3 MB, with and without blanks, through the operators that cut texts."""

import base64
import hashlib
import random
from zlib import crc32

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer
from wavelark.llm import packing, substring_dedup, token_counts, warc

SIZE = 3 << 20


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(5000)]
    prose = " ".join(rng.choice(words) for _ in range(SIZE // 6))
    return {1: prose, 2: "".join(rng.choice("etaoinshrdlu") for _ in range(SIZE)), 3: "x" * SIZE, 4: " " * SIZE}


def table(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id long, text string")


def test_token_counts(spark, texts):
    """Prose far beyond a chunk is spliced with the production chunk and overlap."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(table(spark, texts), path).collect()}
    assert got == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in texts.items()}


def test_packing(spark, texts):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    chosen = {i: texts[i] for i in (1, 4)}
    rows = packing.best_fit_packing(table(spark, chosen), path).collect()
    for doc, text in chosen.items():
        ids = library.encode(text, add_special_tokens=False).ids + [0]
        own = sorted((r for r in rows if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.start for r in own] == list(range(0, len(ids), 2048)) and sum(r.length for r in own) == len(ids)
        for r in own:
            part = np.array(ids[r.start : r.start + r.length], dtype="<u4")
            assert r.ids_crc32 == crc32(part.tobytes())


def test_substrings(spark, texts):
    """A copy of the prose with a word changed in the middle keeps that word alone; one long word is no window."""
    words = texts[1].split()
    middle = len(words) // 2
    other = " ".join(words[:middle] + ["changed"] + words[middle + 1 :])
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(table(spark, {**texts, 9: other})).collect()}
    assert [got[i].n_removed for i in (1, 2, 3, 4)] == [0] * 4 and [got[i].n_words for i in (2, 3, 4)] == [1, 1, 0]
    assert got[9].n_removed == len(words) - 1
    assert got[9].kept_sha256 == hashlib.sha256(b"changed").hexdigest()


def test_archives(spark, texts):
    rows = [(i, f"http://x/{i}", t) for i, t in texts.items()] + [(8, "http://x/8", texts[2])]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.warc_round_trip(pages).collect()}
    for i, _, text in rows:
        digest = base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(text), digest)
        assert (got[i].record_type, got[i].refers_to) == (("revisit", 2) if i == 8 else ("response", None))
