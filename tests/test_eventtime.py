"""Event-time operators: late rows find their place, silent sensors are forgotten."""

import datetime as dt

import numpy as np
import pytest
from wavelark.operators import packets as P
from wavelark.streaming import eventtime as E

T0 = dt.datetime(2024, 1, 1)
SEQ = "sensor_id string, ts timestamp, seq long"


@pytest.fixture()
def run_stream(spark, tmp_path):
    """Feed lists of rows as micro-batches; the last two only move the watermark on."""
    states = []

    def run(parts, schema, build):
        source = tmp_path / "in"
        source.mkdir()
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
        query = None
        for rows in parts:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
            query = (
                build(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append")
                .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            )
            query.awaitTermination(180)
            states.append([o.numRowsTotal for p in query.recentProgress for o in p.stateOperators][-1])
        return sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str), states

    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield run
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    if kept:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def test_late_rows_give_the_batch_result(spark, run_stream):
    """Rows of neighbouring batches are mixed up, the query is stopped and started between all batches."""
    rng = np.random.default_rng(2)
    rows = [(f"s{i % 3}", at(i), int(s)) for i, s in enumerate(np.cumsum(rng.integers(1, 4, 60)))]
    rows[20] = (rows[20][0], rows[20][1], 1)
    mixed = sorted(rows, key=lambda r: (r[1] - T0).total_seconds() + rng.uniform(0, 8))
    ends = [[("clock", at(200), 1)], [("clock", at(400), 2)]]
    live, _ = run_stream([mixed[:22], mixed[22:41], mixed[41:], *ends], SEQ, lambda s: E.packet_loss(s, "10 seconds", "1 day"))
    batch = P.packet_loss(spark.createDataFrame(rows, SEQ), ["ts", "seq"]).select("sensor_id", "ts", "seq", "late", "gap", "dropped")
    assert [r for r in live if r[0] != "clock"] == sorted(map(tuple, batch.collect()), key=str)


def test_silent_sensors_expire(spark, run_stream):
    """State falls after the silence; a sensor that speaks again starts anew."""
    first = [(f"s{i}", at(i), 5) for i in range(20)]
    parts = [first, [("clock", at(60), 1)], [("clock", at(300), 2)], [("clock", at(500), 3)], [("s1", at(505), 50)], [("clock", at(700), 4)], [("clock", at(900), 5)]]
    live, states = run_stream(parts, SEQ, lambda s: E.packet_loss(s, "10 seconds", "1 minute"))
    assert min(states[:2]) > 20 > 10 > max(states[2:])
    assert [r[2:] for r in live if r[0] == "s1"] == [(5, False, 0, 0), (50, False, 0, 0)]


def test_spikes_and_velocities(spark, run_stream, tmp_path):
    rows = [("a", at(i), v) for i, v in enumerate([0.1, 0.1, 0.5, 0.1, 0.9])]
    mixed = [rows[1], rows[0], rows[3]], [rows[2], rows[4]], [("clock", at(100), 0.0)], [("clock", at(200), 0.0)]
    live, _ = run_stream(list(mixed), "sensor_id string, ts timestamp, rms double", E.energy_spikes)
    assert live == [("a", at(2), 0.5, "energy_spike"), ("a", at(4), 0.9, "energy_spike")]


def test_velocities(spark, run_stream):
    rows = [("a", at(i), v) for i, v in enumerate([100.0, 101.0, 110.0, 90.0])]
    parts = [[rows[2], rows[0]], [rows[1], rows[3]], [("clock", at(100), 1.0)], [("clock", at(200), 1.0)]]
    live, _ = run_stream(parts, "sensor_id string, ts timestamp, freq_hz double", E.velocities)
    assert [(r[2], r[3], r[5]) for r in live if r[0] == "a"] == [(100.0, 101.0, "stationary"), (101.0, 110.0, "approaching"), (110.0, 90.0, "receding")]
