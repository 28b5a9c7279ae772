import hashlib
import random
import re

import pytest
from compare import connect, difference
from wavelark.llm import exact_dedup as E
from wavelark.llm import queries as Q

SCHEMA = "doc_id long, text string, name long, key string"


def expected(rows):
    groups = {}
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    for (d, _), text in zip(rows, norm, strict=True):
        groups.setdefault(text, []).append(d)
    best = {t: min((d is None, d or 0) for d in g) for t, g in groups.items()}
    out, seen = [], set()
    for (d, _), text in zip(rows, norm, strict=True):
        keep = None if best[text][0] else best[text][1]
        first = d == keep and text not in seen
        seen.update([text] if first else [])
        out.append((d, keep, len(groups[text]), first, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [1, 3, 16, E.BLOCK])
def test_against_dictionary(spark, block):
    rng = random.Random(block)
    texts = [None, "", " ", "\t\n", "a", "a ", "a  ", "ab", "ba", "é", "é", "x" * 50, "x" * 51, "x" * 100, "xy" * 50]
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(100 + i, "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 9)))) for i in range(120)]
    rows += [(7, "x" * 51), (None, "a"), (None, "only null"), (None, "only null"), (3, "q"), (3, "q"), (3, "r")]
    docs = spark.createDataFrame([(d, t, 1, "clash") for d, t in rows], SCHEMA).repartition(4)
    got = E.exact_dedup(docs, block=block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_very_long_texts(spark):
    long = "the end of it all " * 60000
    rows = [(2, long), (1, long.replace(" ", "\n ")), (3, long + "x"), (4, "y" + long)]
    docs = spark.createDataFrame([(d, t, 1, "k") for d, t in rows], SCHEMA)
    got = E.exact_dedup(docs).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted((tuple(r) for r in got.collect()), key=str) == expected(rows)


def test_names_follow_the_order(spark):
    keys = spark.createDataFrame([(i * 7 % 50,) for i in range(100)], "k long")
    names = [r.name for r in E.name_sorted(keys, ["k"]).orderBy("k").collect()]
    assert len(names) == 50 and names == sorted(set(names))


def test_two_blocks_of_one_key_are_an_error(spark):
    pieces = spark.createDataFrame([("k",), ("k",)], "key string")
    contents = spark.createDataFrame([("k", "a"), ("k", "b")], "key string, block string")
    with pytest.raises(Exception, match="share a key"):
        E._checked_keys(pieces, contents).collect()


def test_empty_table_and_sql(spark):
    assert E.exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []
    folder, name = "/root/testdata/sf0.001", "op5_block_naming_exact_dedup"
    assert difference(Q.QUERIES[name](spark, folder), connect(folder), Q.ORACLES[name]) is None
