"""Prefix scans against a plain loop, over many partitions and batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from wavelark.operators import scan as S


def slow(rows):
    """(key, t) -> (sum, max, last, first, index) of the rows before, by a loop."""
    out, state = {}, {}
    for k, t, v in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1])):
        s = state.setdefault(k, [0, None, None, None, 0])
        out[k, t] = tuple(s)
        s[0] += v or 0
        s[1] = v if s[1] is None else s[1] if v is None else max(s[1], v)
        s[2] = v
        s[3] = v if s[4] == 0 else s[3]
        s[4] += 1
    return out


def run(spark, rows, partitions, batch, kind="long"):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, f"k string, t long, v {kind}").repartition(3)
        v = F.col("v")
        found = S.prefix(df, ["k"], ["t"], {"s": ("sum", v), "m": ("max", v), "l": ("last", v), "f": ("first", v), "i": ("sum", F.lit(1).cast("long"))})
        return {(r.k, r.t): (r.s, r.m, r.l, r.f, r.i) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("partitions, batch", [(1, 3), (4, 2000), (9, 7), (40, 2)])
def test_folds(spark, partitions, batch):
    """One key of a third of all rows, short ones, a null key and null values."""
    rng = np.random.default_rng(partitions)
    rows = [("hot", t, None if rng.random() < 0.2 else int(rng.integers(-50, 50))) for t in range(120)]
    for k in [None, "", *[f"k{i}" for i in range(60)]]:
        rows += [(k, t, None if rng.random() < 0.2 else int(rng.integers(-50, 50))) for t in range(rng.integers(1, 8))]
    assert run(spark, rows, partitions, batch) == slow(rows)


def test_small_tables(spark):
    assert run(spark, [], 4, 10) == {}
    assert run(spark, [("a", 1, None)], 4, 10) == {("a", 1): (0, None, None, None, 0)}
    halves = [("a", t, t * 0.5) for t in range(30)]
    assert run(spark, halves, 5, 4, "double") == slow(halves)


def test_one_exchange_and_no_hot_task(spark):
    """Rows of one sensor in one minute spread over the partitions; sorting takes a single exchange."""
    df = spark.range(2_000_000).select(F.lit("one").alias("k"), (F.col("id") * 30).alias("micros"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        found = S.index(df, ["k"], ["micros"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "hashpartitioning" not in plan
        assert found.filter("idx <> id").count() == 0
        parts = found.select(F.input_file_name().alias("f")).groupBy("f").count().collect()
        assert len(parts) >= 4 and max(r["count"] for r in parts) < 1_000_000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_no_keys(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(50)], "t long, v long").repartition(5)
    assert all(r.idx == r.t for r in S.index(df, [], ["t"]).collect())


@pytest.mark.parametrize("few", [100_000, 50])
def test_quantiles_by_brackets(spark, monkeypatch, few):
    """Hot, tied, signed, tiny and huge values; keys above and below the size one aggregate takes."""
    from wavelark.operators import ordered as O

    monkeypatch.setattr(O, "FEW", few)
    monkeypatch.setattr(O, "ACCURACY", 20)
    rng = np.random.default_rng(8)
    data = {
        "hot": rng.normal(size=4001), "ties": rng.integers(0, 3, 900).astype(float), "same": np.full(300, 2.5),
        "signs": np.concatenate([-(10.0 ** rng.uniform(-300, 300, 200)), [0.0] * 90, 10.0 ** rng.uniform(-300, 300, 211)]),
        "most": np.concatenate([np.zeros(500), rng.normal(size=77)]), "one": np.array([7.0]), "two": np.array([1.0, 2.0]),
    }
    rows = [(k, float(v)) for k, values in data.items() for v in values] + [("hot", None), ("null", None)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(4)
    for q in (0.0, 0.013, 0.5, 0.9, 1.0):
        got = {r.k: r.quantile for r in O.exact_quantile(df, ["k"], "v", q).collect()}
        assert set(got) == set(data)
        for k, values in data.items():
            assert got[k] == pytest.approx(np.quantile(values, q), rel=1e-12, abs=1e-300), (k, q)
    every = np.concatenate(list(data.values()))
    assert O.exact_quantile(df, [], "v", 0.5).first().quantile == pytest.approx(np.quantile(every, 0.5), rel=1e-12)


def test_brackets_order_few_rows(spark, monkeypatch):
    """Of 200,000 different values of one key only a small share is ordered."""
    from wavelark.operators import ordered as O

    seen = []
    monkeypatch.setattr(O, "FEW", 5000)
    real = O._narrowed

    def narrowed(*given):
        made = real(*given)
        seen.append(made.first().n)
        return made

    monkeypatch.setattr(O, "_narrowed", narrowed)
    df = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    want = np.quantile([r.v for r in df.collect()], 0.37)
    assert O.exact_quantile(df, [], "v", 0.37).first().quantile == pytest.approx(want)
    assert seen[-1] < 1500
