"""Recorded sensor packets as a source that can be replayed, in batches or as a stream.

A recorder writes packets one after the other into files whose names rise, and
begins a new file when one is large enough; only the last one still grows.  A
record is

    long  time in microseconds, short  bytes of the sensor's name, int  bytes of the packet,
    the name in UTF-8, the packet

all numbers little-endian.  A stream's offset is (file, byte) behind the last
whole record, so that it stays small however many files there are, and a batch
is the records between two offsets: planned again after a failure it is the
same.  A record that is still being written is left for the next batch.  Files
before the offset are never read again.

    register(spark)
    packets = spark.readStream.format("packet_log").load("/data/packets")
    frames = packet_frames(decode_packets(packets))
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from wavelark.sources.ranges import open_file

SCHEMA = "sensor_id string, ts timestamp, payload binary"
HEAD = "<qHI"
HEAD_SIZE = struct.calcsize(HEAD)
SUFFIX = ".packets"
#: Records in an Arrow batch; bytes read at a time.
BATCH, BLOCK = 1000, 1 << 20


def encode(sensor: str, micros: int, payload: bytes) -> bytes:
    """One record."""
    name = sensor.encode()
    return struct.pack(HEAD, micros, len(name), len(payload)) + name + payload


@dataclass
class Stretch(InputPartition):
    """Whole records of a file from one byte to another."""

    path: str
    start: int
    stop: int


def files(folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the log's files, by name."""
    from pyarrow import fs

    if folder.startswith("file:"):
        system, root = fs.LocalFileSystem(), "/" + folder[len("file:") :].lstrip("/")
    elif "://" not in folder:
        system, root = fs.LocalFileSystem(), folder
    else:
        system, root = fs.FileSystem.from_uri(folder)
    found = system.get_file_info(fs.FileSelector(root, recursive=False))
    inside = [(f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(SUFFIX)]
    return [(f"{folder.rstrip('/')}/{name}", size) for name, size in sorted(inside)]


def records(path: str, start: int, stop: int) -> Iterator[tuple[int, int, bytes, bytes]]:
    """(byte behind it, time, name, packet) of every whole record; a block at a time is read."""
    with open_file(path) as file:
        at, held = start, b""
        place = 0
        while True:
            left = len(held) - place
            need = HEAD_SIZE + (sum(struct.unpack_from(HEAD, held, place)[1:]) if left >= HEAD_SIZE else 0)
            if left < need:
                ahead = at + left
                more = file.read_at(max(0, min(stop - ahead, max(BLOCK, need))), ahead)
                if not more:
                    return
                held, place = held[place:] + more, 0
                continue
            micros, name, size = struct.unpack_from(HEAD, held, place)
            body = place + HEAD_SIZE
            place = body + name + size
            at += HEAD_SIZE + name + size
            yield at, micros, held[body : body + name], held[body + name : place]


def whole_until(path: str, start: int, size: int) -> int:
    """Byte behind the last whole record of a file; only headers from ``start`` on are read."""
    with open_file(path) as file:
        at = start
        while at + HEAD_SIZE <= size:
            _, name, length = struct.unpack(HEAD, file.read_at(HEAD_SIZE, at))
            if at + HEAD_SIZE + name + length > size:
                break
            at += HEAD_SIZE + name + length
        return at


def _batches(part: Stretch) -> Iterator:
    import pyarrow as pa

    def batch(rows: list) -> pa.RecordBatch:
        times, names, packets = zip(*rows, strict=True)
        columns = [pa.array([n.decode() for n in names]), pa.array(times, pa.timestamp("us", "UTC")), pa.array(packets, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["sensor_id", "ts", "payload"])

    rows: list = []
    for _, micros, name, payload in records(part.path, part.start, part.stop):
        rows.append((micros, name, payload))
        if len(rows) == BATCH:
            yield batch(rows)
            rows = []
    if rows:
        yield batch(rows)


class PacketLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packet_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return LogReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return LogStream(self.options["path"])


class LogReader(DataSourceReader):
    """All whole records, a file a task."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Stretch]:
        return [Stretch(path, 0, size) for path, size in files(self.folder)]

    def read(self, partition: Stretch) -> Iterator:
        return _batches(partition)


class LogStream(DataSourceStreamReader):
    """Records behind an offset, a file a task.  Offsets are kept by the query's checkpoint."""

    def __init__(self, folder: str):
        self.folder = folder
        self.seen = ("", 0)  # the last offset given out, where looking for whole records goes on

    def initialOffset(self) -> dict:
        return {"file": "", "byte": 0}

    def latestOffset(self) -> dict:
        found = files(self.folder)
        if not found:
            return self.initialOffset()
        path, size = found[-1]
        name = path.rsplit("/", 1)[-1]
        start = self.seen[1] if self.seen[0] == name else 0
        self.seen = (name, whole_until(path, start, size))
        return {"file": name, "byte": self.seen[1]}

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        out = []
        for path, size in files(self.folder):
            name = path.rsplit("/", 1)[-1]
            if start["file"] <= name <= end["file"]:
                first = start["byte"] if name == start["file"] else 0
                stop = end["byte"] if name == end["file"] else size
                if stop > first:
                    out.append(Stretch(path, first, stop))
        return out

    def read(self, partition: Stretch) -> Iterator:
        return _batches(partition)

    def commit(self, end: dict) -> None:
        """Nothing to do: files stay, so that they can be replayed."""


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PacketLog)
