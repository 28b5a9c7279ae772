import random

import pytest
import xxhash
from wavelark.llm import simhash as S


def slow(text):
    words = (text or "").encode()
    words = bytes(c + 32 if 65 <= c <= 90 else c for c in words).split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    codes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(c >> k & 1 for c in codes) > len(codes))


def slow_components(prints):
    """prints: {node: fingerprint}; the least node reachable of each."""
    left, out = dict(prints), {}
    for node in sorted(prints):
        if node in out:
            continue
        group, todo = {node}, [node]
        while todo:
            x = todo.pop()
            near = [y for y in left if y not in group and bin(left[x] ^ left[y]).count("1") <= 2]
            group.update(near)
            todo += near
        out.update(dict.fromkeys(group, node))
    return out


def result(df):
    return {r.doc_id: (r.fingerprint, r.component_id) for r in df.collect()}


TEXTS = [
    None, "", "  \t", "one", "one two", "ONE two", "a b c", "A b\tc", "Ä b c d", "ä b c d", "x " * 40, "word " * 300000,
    "the quick brown fox jumps over the lazy dog near the river bank today",
    "the quick brown fox jumps over the lazy dog near the river bank today", "a b c", "a\x1cb c d",
]


def test_fingerprints_by_definition(spark):
    rows = list(enumerate(TEXTS))
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, fp string")
    got = result(S.simhash_groups(docs))
    want = {i: slow(t) for i, t in rows}
    parts = slow_components(want)
    assert got == {i: (f"{want[i]:016x}", parts[i]) for i in want}


def test_repeated_rows_and_empty_table(spark):
    schema = "doc_id long, text string"
    twice = S.simhash_groups(spark.createDataFrame([(5, "a b c d"), (5, "a b c d"), (None, "a b c d")], schema))
    assert [r.component_id for r in twice.collect()] == [5, 5, 5]
    assert S.simhash_groups(spark.createDataFrame([], schema)).collect() == []


@pytest.mark.parametrize("hot", [1, 2, 64])
def test_components_against_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rng = random.Random(hot)
    prints = set()
    for _ in range(8):
        at = rng.getrandbits(64)
        for _ in range(25):
            prints.add(at)
            for _ in range(rng.randint(1, 4)):
                at ^= 1 << rng.choice([rng.randrange(64), rng.randrange(32, 40), rng.randrange(4)])
    prints |= {0, 1, 3, 7, 15, 1 << 63, (1 << 64) - 1}
    signed = {x - (1 << 64) if x >> 63 else x: x for x in prints}
    edges = S.links(spark.createDataFrame([(x,) for x in signed], "fp long"))
    pairs = [(r.a, r.b) for r in edges.collect()]
    assert all(bin(signed[a] ^ signed[b]).count("1") <= 2 and a > b for a, b in pairs)
    got = {r.node: r.component for r in S.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert {x: got.get(x, x) for x in signed} == slow_components(signed)
