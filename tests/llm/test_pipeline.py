import re

import corpus_pipeline
import public_tokenizers
import test_packing
import test_pii
import test_simhash
from pyspark.sql import functions as F
from wavelark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def without_copies(docs, group_of):
    """The row with the smallest id (null last) of each group."""
    best = {}
    for r in docs:
        key = group_of(r)
        if key not in best or (r[0] is None, r[0] or 0) < (best[key][0] is None, best[key][0] or 0):
            best[key] = r
    return sorted(best.values(), key=str)


def near_groups(docs):
    prints = {i: test_simhash.slow(r[1]) for i, r in enumerate(docs)}
    parts = test_simhash.slow_components(prints)
    return {r: parts[i] for i, r in enumerate(docs)}


def follow(spark, docs, folder):
    """Runs the stages one by one and compares each with brute force on its own input."""
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.written(stage(spark, docs, folder))
        before, after = rows(docs), rows(out)
        if name == "language_id":
            assert after == [r for r in before if any(c.isalpha() for c in r[1] or "")]
        elif name == "exact_dedup":
            assert after == without_copies(before, lambda r: re.sub("[\x20\x09-\x0d]+", " ", r[1] or ""))
        elif name == "simhash_near_dedup":
            groups = near_groups(before)
            assert after == without_copies(before, groups.get)
        elif name == "pii":
            assert [r[0] for r in after] == [r[0] for r in before]
            for old, new in zip(before, after, strict=True):
                assert (old[1] == new[1]) == (not test_pii.slow(old[1])) and not test_pii.slow(new[1])
                assert new[2:4] == old[2:4] and new[4] == len(new[1])
        else:
            test_packing.check(out.collect(), [(r[0], r[1]) for r in before], packing.CAPACITY)
            break
        assert out.columns == columns
        docs = out
    return out


def test_documents(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    followed = follow(spark, docs, folder)
    whole = corpus_pipeline.run(spark, folder)
    assert {tuple(r)[:5] for r in whole.collect()} == {tuple(r)[:5] for r in followed.collect()}


def test_edges(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()
    text = " ".join(words * 5)
    made = [(i, f"{text} {words[i]} end{i}", "en", "s", 0) for i in range(10)]
    made += [(3, made[3][1], "en", "s", 0), (30, made[3][1], "en", "t", 0), (None, made[4][1], "en", "s", 0)]
    made += [(40, None, "en", "s", 0), (41, "", None, "s", 0), (42, "12 !", "en", "s", 0), (43, "x@y.zz or +1 234 567 8901", "en", "s", 0)]
    made += [(44, "different words here", "en", "s", 0), (44, "other words of the same id", "en", "s", 0)]
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    follow(spark, corpus_pipeline.written(docs), "")


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert follow(spark, docs, "").collect() == []


def test_language_stage_uses_the_language(spark):
    """Most mislabelled texts go; rightly labelled, unlabelled ones and those of labels not learnt stay."""
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    long = docs.filter("char_length(text) between 300 and 3000 and lang in ('en', 'fr')").orderBy("doc_id").limit(40).collect()
    made = []
    for i, r in enumerate(long):
        # One text alone has the label xx, so the other half can't learn it.
        for j, lang in enumerate((r.lang, {"en": "fr", "fr": "en"}[r.lang], None, "xx")[: 3 + (i == 0)]):
            made.append({**r.asDict(), "doc_id": 10**6 + 5 * i + j, "lang": lang})
    more = spark.createDataFrame(made, docs.schema)
    got = {r.doc_id for r in corpus_pipeline.language_stage(spark, docs.unionByName(more), folder).collect()}
    wrong = {r["doc_id"] for r in made if (r["doc_id"] - 10**6) % 5 == 1}
    assert len(wrong) == 40 and len(wrong & got) < 20
    assert {r["doc_id"] for r in made} - wrong <= got
    letters = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}
    assert letters <= got
    bare = docs.limit(20).withColumn("lang", F.lit(None).cast("string")).union(spark.createDataFrame([made[0] | {"text": "12 !", "lang": None}], docs.schema))
    assert corpus_pipeline.language_stage(spark, bare, folder).count() == sum(any(c.isalpha() for c in r.text or "") for r in bare.collect())


def test_columns_of_any_name(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    made = [(i, f"{w} {w}x end{i} other words", "en", "s", 0) for i, w in enumerate(words)]
    made += [(3, made[3][1], "en", "t", 0), (42, "12 !", "en", "s", 0), (43, "words x@y.zz or more", "en", "s", 0)]
    own = "n score lang_pred kept _id _text _row _redacted mark a.b".split()
    docs = spark.createDataFrame(
        [(*r, *(f"{c}{r[0]}" for c in own)) for r in made],
        "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in own),
    )
    docs = corpus_pipeline.written(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs, columns = corpus_pipeline.written(stage(spark, docs, "")), docs.columns
        assert docs.columns == columns, name
        assert all(tuple(r)[5:] == tuple(f"{c}{r[0]}" for c in own) for r in docs.collect()), name
        assert docs.count()
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").count()
