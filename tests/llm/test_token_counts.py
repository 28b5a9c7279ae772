import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer
from wavelark.llm import token_counts as C

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(2)
    alphabet = " \n\t  abcdeéñ'stl129.,!?\x1c\x1f\x85\xa0 ß中😀-_/<|>"
    made = [None, "", " ", "a", "a", "<|endoftext|>", "x<|endoftext|>y <|endoftext|> <|endoftext", "one  two\n\n three  "]
    made += ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 300))) for _ in range(200)]
    made += ["x" * 3000, " " * 3000, "ab " * 1500, "a" * 1000 + " " * 1000 + "bc" * 700 + " d e f"]
    return made


@pytest.mark.parametrize("chunk, overlap", [(C.CHUNK, C.OVERLAP), (64, 16), (50, 1)])
def test_counts_equal_the_library(spark, library, chunk, overlap):
    made = texts()
    docs = spark.createDataFrame(
        [(i, t, 7, "clash") for i, t in enumerate(made)], "doc_id long, text string, n_chars long, row string"
    ).repartition(4)
    got = {r.doc_id: r for r in C.token_counts(docs, PATH, limit=20, chunk=chunk, overlap=overlap).collect()}
    for i, text in enumerate(made):
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((text or "").encode()), n > 20), repr(text)
    assert len(got) == len(made)


def test_widening_after_a_failed_alignment(spark, library, monkeypatch):
    """Marks that never agree at the first width force another cut."""
    plain, seen = C._spliced, []

    def first_fails(encoded, chunk):
        seen.append(chunk)
        out = plain(encoded, chunk)
        return out.selectExpr("row", "n_tokens", "true as odd", "doc") if len(seen) == 1 else out

    monkeypatch.setattr(C, "_spliced", first_fails)
    text = "the end of it all " * 100
    docs = spark.createDataFrame([(1, text), (2, "short")], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in C.token_counts(docs, PATH, chunk=100, overlap=8).collect()}
    assert len(seen) == 2
    assert got == {1: len(library.encode(text).ids), 2: len(library.encode("short").ids)}


def test_empty_table(spark):
    assert C.token_counts(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
