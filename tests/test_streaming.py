"""Streams give what the batch operators give."""

import datetime as dt
import struct

import numpy as np
import pandas as pd
import pytest
from helpers import tone
from pyspark.sql import functions as F

from wavelark.operators import bands as B
from wavelark.operators import features as T
from wavelark.operators import packets as P
from wavelark.model import FeatureConfig
from wavelark.streaming import chunks as C
from wavelark.streaming import stateful as S
from wavelark.streaming.windows import session_rollup, windowed_stats

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture()
def run_stream(spark, tmp_path):
    """Feed data frames as successive micro-batches, return all output rows."""

    def run(parts, schema, build, mode="append"):
        source = tmp_path / f"in{len(list(tmp_path.iterdir()))}"
        for i, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            written = sorted(source.glob("part-*.parquet"), key=lambda p: p.stat().st_mtime)[-1]
            import os

            os.utime(written, (1_700_000_000 + i, 1_700_000_000 + i))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        name = f"out_{source.name}_{abs(hash(str(tmp_path))) % 10**8}"
        query = (
            build(stream).writeStream.format("memory").queryName(name).outputMode(mode)
            .option("checkpointLocation", str(tmp_path / f"cp_{name}")).trigger(availableNow=True).start()
        )
        query.awaitTermination(120)
        return spark.sql(f"select * from {name}")

    return run


def raw(x):
    return np.asarray(x, dtype="<f4").tobytes()


CHUNK = "sensor_id string, ts timestamp, audio binary"


def some_chunks():
    return [
        [("s1", T0, raw(tone(1000, 0.2, 44100))), ("s2", T0, raw(np.zeros(500)))],
        [("s1", T0 + dt.timedelta(seconds=1), raw(tone(1010, 0.2, 44100)))],
    ]


def test_chunk_messages(spark, run_stream):
    parts = some_chunks()
    live = run_stream(parts, CHUNK, C.featurise_stream)
    batch = C.featurise_stream(spark.createDataFrame(sum(parts, []), CHUNK))
    rows = sorted(map(tuple, live.collect()))
    assert rows == sorted(map(tuple, batch.collect()))
    assert [r[2:] for r in rows] == [(558, C.FEATURES_ONLY), (558, C.FEATURES_ONLY), (None, C.TOO_SHORT)]


def test_chunk_features_equal_batch_features(spark):
    rng = np.random.default_rng(0)
    rows = [("s", T0, raw(rng.normal(size=50000))), ("t", T0, raw(rng.normal(size=1200)))]
    signals = C.chunk_signals(spark.createDataFrame(rows, CHUNK))
    config = FeatureConfig(spectral_flux=True, stats=("mean", "std", "median", "skew", "kurtosis"))
    live = {r.recording_id: r.features for r in C.chunk_features(signals, config).collect()}
    batch = {r.recording_id: r.features for r in T.feature_vectors(signals, config).collect()}
    assert live.keys() == batch.keys() and len(live) == 2
    for name in live:
        assert np.allclose(live[name], batch[name], rtol=1e-6, atol=1e-6)


def test_hybrid_stream_equals_batch(spark, run_stream):
    parts = some_chunks()
    live = run_stream(parts, CHUNK, C.hybrid_stream)
    signals = C.chunk_signals(spark.createDataFrame(sum(parts, []), CHUNK)).filter("n_total >= 1024")
    batch = B.hybrid_classify(B.band_energy(signals))
    rows = live.collect()
    a = sorted((r.recording_id, r.first_guess) for r in rows if r.first_guess)
    assert a == sorted((r.recording_id, r.first_guess) for r in batch.collect()) and len(a) == 2
    assert all(abs(r.freq_hz - 1005) < 8 for r in rows if r.first_guess)
    assert [(r.method, r.freq_hz) for r in rows if not r.first_guess] == [(C.TOO_SHORT, None)]


def test_hybrid_stream_keeps_any_sensor_name(spark):
    chunk = (np.sin(np.arange(4096) / 5)).astype(np.float32)
    out = C.hybrid_stream(spark.createDataFrame([("a|b", T0, raw(chunk))], CHUNK)).first()
    assert out.sensor_id == "a|b" and out.freq_hz > 0


def test_score_stream_with_a_saved_model(spark, run_stream, tmp_path):
    from wavelark.ml import classify

    rng = np.random.default_rng(0)
    config = FeatureConfig.from_dict({n: n in ("zcr", "rms") for n in FeatureConfig.__dataclass_fields__ if n not in ("n_mfcc", "stats")})
    make = lambda loud: (loud * rng.normal(size=2048)).astype(np.float32)
    rows = [(f"s{i}", T0 + dt.timedelta(seconds=i), raw(make(0.1 if i % 2 else 0.9))) for i in range(40)]
    chunks = spark.createDataFrame(rows, CHUNK)
    known = C.chunk_features(C.chunk_signals(chunks), config).withColumn(
        "class_name", F.when(F.substring("sensor_id", 2, 9).cast("int") % 2 == 1, "quiet").otherwise("loud")
    )
    model, _ = classify.train(known.select("recording_id", "class_name", "features"), max_depth=4)
    model.save(str(tmp_path / "m"))
    loaded = classify.Classifier.load(spark, str(tmp_path / "m"))
    short = ("t", T0, raw(make(0.5)[:100]))
    live = run_stream([rows[:20], [*rows[20:], short]], CHUNK, lambda s: C.score_stream(s, loaded, config))
    out = {r.sensor_id: r.prediction for r in live.collect()}
    assert out["t"] is None and len(out) == 41
    assert all(out[f"s{i}"] == ("quiet" if i % 2 else "loud") for i in range(40))


def packets(n=60, seed=0):
    rng = np.random.default_rng(seed)
    seq = np.cumsum(rng.integers(1, 4, n))
    return [("s%d" % (i % 2), T0 + dt.timedelta(seconds=i), int(s)) for i, s in enumerate(seq)]


def test_packet_loss_stream_equals_batch(spark, run_stream):
    rows = packets()
    rows[20] = (rows[20][0], rows[20][1], 1)  # late
    schema = "sensor_id string, ts timestamp, seq long"
    live = run_stream([rows[:25], rows[25:40], rows[40:]], schema, S.packet_loss_stream)
    batch = P.packet_loss(spark.createDataFrame(rows, schema), ["ts", "seq"])
    names = ["sensor_id", "ts", "seq", "late", "gap", "dropped"]
    assert sorted(map(tuple, live.select(names).collect())) == sorted(map(tuple, batch.select(names).collect()))
    assert sum(r.late for r in live.collect()) == 1


def test_gap_golden(spark):
    rows = [("s", T0 + dt.timedelta(seconds=i), s) for i, s in enumerate([0, 1, 2, 5, 6])]
    df = spark.createDataFrame(rows, "sensor_id string, ts timestamp, seq long")
    out = sorted(P.packet_gaps(df, ["ts"]).collect(), key=lambda r: r.seq)
    assert [r.gap for r in out] == [0, 0, 0, 2, 0] and out[-1].dropped == 2


def test_spike_stream(spark, run_stream):
    rms = [1.0, 1.0, 3.0, 1.0, 1.0, 9.0, 0.001]
    rows = [("s", T0 + dt.timedelta(seconds=i), v) for i, v in enumerate(rms)]
    live = run_stream([rows[:3], rows[3:]], "sensor_id string, ts timestamp, rms double", S.energy_spike_stream)
    assert sorted(r.energy for r in live.collect()) == [3.0, 9.0]


def test_velocity_stream(spark, run_stream):
    rows = [("s", T0 + dt.timedelta(seconds=i), f) for i, f in enumerate([1000.0, 1001.0, 1050.0, 900.0])]
    live = run_stream([rows[:2], rows[2:]], "sensor_id string, ts timestamp, freq_hz double", S.velocity_stream)
    out = sorted(live.collect(), key=lambda r: r.ts)
    assert [r.direction for r in out] == ["stationary", "approaching", "receding"]
    assert out[1].velocity_m_s == pytest.approx(343 * 49 / 1050)


def test_rebuffer(spark, run_stream):
    schema = "sensor_id string, ts timestamp, seq long, frames array<array<double>>"
    sizes = [3, 5, 4, 1]
    rows, at = [], 0
    for i, n in enumerate(sizes):
        rows.append(("s", T0 + dt.timedelta(seconds=i), i, [[float(at + j), -float(at + j)] for j in range(n)]))
        at += n
    live = run_stream(
        [rows[:2], rows[2:]], schema, lambda s: S.rebuffer(s, sr=100, seconds=1.0, frames=4, channels=2)
    )
    out = sorted(live.collect(), key=lambda r: r.window)
    assert [r.window for r in out] == [0, 1, 2]
    values = np.concatenate([np.array(r.samples).reshape(-1, 2)[:, 0] for r in out])
    assert values.tolist() == list(range(12))
    # A small capacity bounds what waits, never what is sent: one, two or four micro-batches give the same.
    for parts in ([rows], [rows[:2], rows[2:]], [[r] for r in rows]):
        small = run_stream(parts, schema, lambda s: S.rebuffer(s, sr=6, seconds=1.0, frames=4, channels=2))
        cut = sorted((r.window, tuple(np.array(r.samples).reshape(-1, 2)[:, 0])) for r in small.collect())
        assert cut == [(i, tuple(float(4 * i + j) for j in range(4))) for i in range(3)]


def test_decode_packets(spark):
    ints = np.arange(-16, 19, dtype="<i2")  # 35 values: two frames of 16 and a rest
    good = struct.pack("<II", 4_000_000_000, 32) + ints.tobytes()
    floats = struct.pack("<II", 7, 16) + np.linspace(-1, 1, 16, dtype="<f4").tobytes()
    schema = "sensor_id string, ts timestamp, payload binary"
    df = spark.createDataFrame([("s", T0, good), ("s", T0, b"abc"), ("s", T0, struct.pack("<II", 1, 0) + b"\0\0")], schema)
    rows = P.decode_packets(df).collect()
    assert len(rows) == 1 and rows[0].seq == 4_000_000_000 and rows[0].n_samples == 32
    assert np.allclose(np.array(rows[0].frames).ravel(), np.arange(-16, 16) / 32768)
    one = P.packet_frames(P.decode_packets(spark.createDataFrame([("s", T0, floats)], schema), "float32"))
    values = [r["value"] for r in sorted(one.collect(), key=lambda r: r.ch)]
    assert np.allclose(values, np.linspace(-1, 1, 16, dtype="<f4"))
    with pytest.raises(ValueError):
        P.decode_packets(df, "int24")


def test_windows_drop_late_rows(spark, run_stream):
    schema = "sensor_id string, ts timestamp, value double"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    # A row counts as late against the watermark of the batch before its own.
    parts = [
        [("s", at(1), 1.0), ("s", at(40), 2.0)], [("s", at(80), 3.0)],
        [("s", at(2), 99.0), ("s", at(200), 4.0)], [("s", at(300), 5.0)],
    ]
    live = run_stream(parts, schema, lambda s: windowed_stats(s, "10 minutes", None, "10 minutes"))
    out = {r.started.replace(tzinfo=None): (r.n, r.max_value) for r in live.collect()}
    assert out[at(0)] == (1, 1.0) and out[at(40)] == (1, 2.0) and out[at(80)] == (1, 3.0)


def test_session_rollup_stream(spark, run_stream):
    schema = "sensor_id string, ts timestamp, latency double, detected boolean"
    at = lambda m: T0 + dt.timedelta(minutes=m)
    parts = [[("s", at(0), 10.0, True), ("s", at(20), 20.0, False)], [("s", at(100), 30.0, False)], [("s", at(500), 1.0, True)]]
    live = run_stream(parts, schema, session_rollup)
    out = sorted(live.collect(), key=lambda r: r.started)
    assert (out[0].processed, out[0].mean_latency, out[0].detections) == (2, 15.0, 1)
