import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from wavelark.llm import bpe_transducer as B

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    return B.Codec(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=B.read_ranks(PATH), special_tokens={}
    )


def ids_of(codec, text):
    return [i for at in B.slices(text, B.BORDER, 16) for s in B.SEGMENT.findall(text, *at) for i in codec.ids(s)]


def test_random_texts(codec, library):
    rng = random.Random(3)
    alphabet = " \n\t  abcdeéñ'stl129.,!?\x1c\x1f\x85\xa0 ßа中😀-_/<|>"
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))
        ids = ids_of(codec, text)
        assert ids == library.encode_ordinary(text), repr(text)
        assert "".join(codec.decode(ids)) == text


@pytest.mark.parametrize("flush", [7, 64, 1 << 16])
def test_long_runs(codec, library, monkeypatch, flush):
    monkeypatch.setattr(B, "FLUSH", flush)
    codec = B.Codec(PATH, public_tokenizers.PATTERN)  # nothing kept from another flush
    rng = random.Random(flush)
    runs = ["a" * 5000, "ab" * 3000, " " * 3000, "\n" * 900, "é" * 700, "1" * 4000, "=-" * 2000]
    runs.append("".join(rng.choice("etaoinshr") for _ in range(20000)))
    for text in runs:
        assert ids_of(codec, text) == library.encode_ordinary(text)


def test_pairs(codec):
    """Side by side by spines is side by side by merging both, for pairs that occur and any others."""
    rng, ranks = random.Random(9), codec.transducer.ranks
    tokens = [t for t in ranks if len(t) < 9 and B.merged(t, ranks) == (ranks[t],)]
    pairs = [(rng.choice(tokens), rng.choice(tokens)) for _ in range(4000)]
    for word in rng.sample(tokens, 3000):
        cut = rng.randrange(len(word))
        pairs += [(word[:cut], word[cut:])] if cut and word[:cut] in ranks and word[cut:] in ranks else []
    pairs += [(a, b) for a in (b"a", b"aa", b"aaaa", b" ", b"  ", b"=", b"==") for b in (b"a", b"aa", b"aaaa", b" ", b"==")]
    sound = [p for p in pairs if all(t in ranks and B.merged(t, ranks) == (ranks[t],) for t in p)]
    found = [codec.transducer._side_by_side(*p) for p in sound]
    want = [B.merged(a + b, ranks) == (ranks[a], ranks[b]) for a, b in sound]
    assert found == want and len(set(want)) == 2


def test_bounds_within_one_piece(codec, library, monkeypatch):
    """A single piece of 3 MB: states and settled tokens stay bounded, the result is the library's."""
    monkeypatch.setattr(B, "STATES", 500)
    rng = random.Random(11)
    small = B.Codec(PATH, public_tokenizers.PATTERN)
    word = "".join(rng.choice("abcdefgh") for _ in range(20_000))
    assert ids_of(small, word) == library.encode_ordinary(word) and len(small.transducer.states) <= 500
    text = ("".join(rng.choice("etaoin") for _ in range(3000)) * 1000)[: 3 << 20]
    ids = codec.ids(text)
    assert "".join(codec.decode(ids)) == text
    part = text[:30_000]  # the library is quadratic in one piece
    assert codec.ids(part)[:8000] == library.encode_ordinary(part)[:8000] == ids[:8000]


def test_decoding_any_ids(codec):
    rng = random.Random(5)
    for _ in range(2000):
        ids = [rng.randrange(50256) for _ in range(rng.randint(0, 12))]
        raw = b"".join(codec.stream.bytes_of[i] for i in ids)
        assert "".join(codec.decode(ids)) == raw.decode("utf-8", "replace")


def test_table(spark, library):
    texts = [None, "", " ", "a b", "a b", "The   end.\n\n", "x" * 100000, "<|endoftext|> über 中文 😀"]
    docs = spark.createDataFrame(
        [(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, n_tokens long"
    )
    got = {r.doc_id: r for r in B.codec_digest(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert len(got) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode_ordinary(text or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    whole = {r.doc_id: r for r in B.encoded_and_decoded(docs, PATH, public_tokenizers.PATTERN).collect()}
    assert all(whole[i].decoded == (t or "") and whole[i].ids == library.encode_ordinary(t or "") for i, t in enumerate(texts))
    assert B.codec_digest(docs.filter("doc_id < 0"), PATH, public_tokenizers.PATTERN).collect() == []
