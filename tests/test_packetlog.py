"""The packet log loses and repeats nothing, whatever is cut where."""

import datetime as dt
import struct

import pytest
from wavelark.operators import packets as P
from wavelark.sources import packetlog as L

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def record(i):
    payload = struct.pack("<II", i, 16) + struct.pack("<16h", *range(i, i + 16))
    return L.encode(f"s{i % 3}é", int(T0.timestamp() * 1_000_000) + i, payload)


def write(folder, name, data, mode="wb"):
    folder.mkdir(exist_ok=True)
    with open(folder / f"{name}{L.SUFFIX}", mode) as out:
        out.write(data)


@pytest.mark.parametrize("block", [1, 17, 1 << 20])
def test_records_of_any_block_size(tmp_path, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    data = b"".join(map(record, range(50)))
    write(tmp_path / "log", "a", data + record(50)[:-1])
    path = str(tmp_path / "log" / f"a{L.SUFFIX}")
    found = list(L.records(path, 0, len(data) + 20))
    assert len(found) == 50 and found[-1][0] == len(data) == L.whole_until(path, 0, len(data) + len(record(50)) - 1)
    assert b"".join(L.encode(n.decode(), t, p) for _, t, n, p in found) == data


def test_batch(spark, tmp_path):
    L.register(spark)
    write(tmp_path / "log", "1", b"".join(map(record, range(2500))))
    write(tmp_path / "log", "2", b"")
    write(tmp_path / "log", "3", record(2500) + b"\x01\x02")
    rows = spark.read.format("packet_log").load(str(tmp_path / "log"))
    got = P.decode_packets(rows).select("sensor_id", "seq", "ts").collect()
    assert sorted(r.seq for r in got) == list(range(2501))
    assert all(r.sensor_id == f"s{r.seq % 3}é" for r in got)
    assert got[0].ts == dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=got[0].seq)


def test_restart_from_checkpoint(spark, tmp_path):
    """The query ends between all appends: growing files, a record cut in two, new files."""
    L.register(spark)
    log = tmp_path / "log"
    half = record(40)

    def run():
        stream = P.decode_packets(spark.readStream.format("packet_log").load(str(log)))
        query = (
            stream.select("sensor_id", "seq").writeStream.format("parquet").option("path", str(tmp_path / "out"))
            .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        )
        query.awaitTermination(180)
        return sorted(r.seq for r in spark.read.parquet(str(tmp_path / "out")).collect())

    write(log, "001", b"".join(map(record, range(30))))
    assert run() == list(range(30))
    write(log, "001", b"".join(map(record, range(30, 40))) + half[:11], "ab")
    assert run() == list(range(40))
    assert run() == list(range(40))
    write(log, "001", half[11:] + b"".join(map(record, range(41, 45))), "ab")
    write(log, "002", b"".join(map(record, range(45, 60))))
    write(log, "003", b"".join(map(record, range(60, 61))))
    assert run() == list(range(61))
    write(log, "003", record(61), "ab")
    assert run() == list(range(62))
