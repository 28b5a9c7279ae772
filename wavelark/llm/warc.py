"""WARC archives as seekable Zstandard bundles, written and read by Spark tasks.

A bundle is a file of independent Zstandard frames with whole WARC records,
then a skippable frame with the record map (record id -> frame, offset in the
frame's content, length) and the seek table of the public seekable format
(compressed and decompressed size of every frame), which ends the file.  A
reader takes the footer, the map and only the frames it needs.

Of records with equal payloads of at least ``least`` bytes the one with the
smallest id is a response and the others revisit it.  Payloads are equal if
their SHA-256 and length are.

A task writes files named after its attempt and returns their names; the list
of files is written by Spark, so it names only those of attempts that counted.
Files go to the shared folder through the file system its address names.

Defined results: a null payload counts as empty, a null address is left out,
rows that repeat the id and payload of a response are responses too, an empty
table gives no bundle and an empty result.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from wavelark.llm.tables import text_of, written
from wavelark.session import shared_folder

#: Content of a frame and payloads of a bundle before the next one begins, in bytes.
FRAME, BUNDLE = 1 << 18, 1 << 28
LEVEL = 3
DATE = "1970-01-01T00:00:00Z"
#: Fixed values of the seekable Zstandard format and of skippable frames.
SEEK_FRAME, MAP_FRAME, SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
#: Fixed value of the WARC 1.1 standard.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, record_id string"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id}/{digest}')}>"


def make_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[str, bytes]:
    """(record id, record)."""
    digest = payload_digest(payload)
    own = record_id(page_id, digest)
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {own}", f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
        f"X-Payload-Length: {len(payload)}",
    ]
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    else:
        body += payload
    head.append(f"Content-Length: {len(body)}")
    return own, "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple:
    """A row of ``READ``; an error where the payload and its digest differ."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    size = int(fields["X-Payload-Length"])
    if kind == "response":
        payload = body.partition(b"\r\n\r\n")[2]
        if len(payload) != size or payload_digest(payload) != digest:
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    url = fields.get("WARC-Target-URI")
    if url is not None:
        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    number = lambda name: int(fields[name]) if name in fields else None
    return number("X-Page-ID"), size, digest, kind, number("X-Refers-To-Page-ID"), url, fields["WARC-Record-ID"]


def _store(address: str):
    """(file system, path) of an address; a path without a scheme is local, see ``qualified``."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(address) if ":/" in address else (fs.LocalFileSystem(), address)


class BundleWriter:
    """Writes one bundle; records are buffered up to a frame."""

    def __init__(self, address: str):
        import zstandard

        store, path = _store(address)
        self.address, self.out = address, store.open_output_stream(path, compression=None)
        self.compress = zstandard.ZstdCompressor(level=LEVEL).compress
        self.frames: list[tuple[int, int]] = []
        self.places: list[str] = []
        self.frame = bytearray()
        self.content = 0

    def add(self, own: str, record: bytes) -> None:
        self.places.append(f"{own}\t{len(self.frames)}\t{len(self.frame)}\t{len(record)}\n")
        self.frame += record
        self.content += len(record)
        if len(self.frame) >= FRAME:
            self._end_frame()

    def _end_frame(self) -> None:
        packed = self.compress(bytes(self.frame))
        self.out.write(packed)
        self.frames.append((len(packed), len(self.frame)))
        self.frame.clear()

    def close(self) -> tuple[str, int, int]:
        """(address, frames, records)."""
        if self.frame:
            self._end_frame()
        places = self.compress("".join(self.places).encode())
        self.out.write(struct.pack("<II", MAP_FRAME, len(places) + 4) + places + struct.pack("<I", len(places)))
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SEEK_FRAME, len(table) + len(footer)) + table + footer)
        self.out.close()
        return self.address, len(self.frames), len(self.places)


class BundleReader:
    """Random access to the records of a bundle."""

    def __init__(self, address: str):
        store, path = _store(address)
        self.file = store.open_input_file(path)
        size = self.file.size()
        n, _, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE:
            raise ValueError(f"{address} has no seek table")
        begin = size - 9 - 8 * n
        flat = struct.unpack(f"<{2 * n}I", self._at(begin, 8 * n))
        self.frames, at = [], 0
        for packed, content in zip(flat[::2], flat[1::2], strict=True):
            self.frames.append((at, packed, content))
            at += packed
        end = begin - 8  # of the record map
        (length,) = struct.unpack("<I", self._at(end - 4, 4))
        lines = self._unpacked(self._at(end - 4 - length, length)).decode().splitlines()
        self.places = [(own, int(f), int(o), int(s)) for own, f, o, s in (line.split("\t") for line in lines)]
        self.place_of = {own: place for own, *place in reversed(self.places)}  # the first of equal ids

    def _at(self, start: int, length: int) -> bytes:
        self.file.seek(start)
        return self.file.read(length)

    @staticmethod
    def _unpacked(data: bytes) -> bytes:
        import zstandard

        return zstandard.ZstdDecompressor().decompress(data)

    def frame(self, number: int) -> bytes:
        at, packed, _ = self.frames[number]
        return self._unpacked(self._at(at, packed))

    def record(self, own: str) -> bytes:
        """The record with an id, from the one frame that holds it."""
        number, offset, length = self.place_of[own]
        return self.frame(number)[offset : offset + length]

    def records(self) -> Iterator[bytes]:
        last, data = -1, b""
        for _, number, offset, length in self.places:
            if number != last:
                last, data = number, self.frame(number)
            yield data[offset : offset + length]


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` on the file system that Spark writes it to, learnt from one written file; local ones stay plain."""
    if ":/" in folder:
        return folder
    place = f"{folder}/place"
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(place)
    address = spark.read.parquet(place).inputFiles()[0]
    return folder if address.startswith("file:") else address[: address.rindex("/place/")]


def write_bundles(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least: int = 0
) -> DataFrame:
    """Writes a record per row; (address, frames, records) of every bundle."""
    folder = qualified(pages.sparkSession, folder)
    payload = text_of(payload_col).cast("binary")
    base = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
        F.unhex(F.sha2(payload, 256)).alias("key"), F.octet_length(payload).alias("size"),
    )
    firsts = base.groupBy("key", "size").agg(F.min("page_id").alias("first"))
    own = F.col("page_id").eqNullSafe(F.col("first")) | (F.col("size") < least)
    rows = base.join(firsts, ["key", "size"]).select("page_id", "url", "payload", "first", (~own).alias("revisit"))

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        task = TaskContext.get()
        name = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        done, writer = [], None
        for batch in batches:
            for row in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                writer = writer or BundleWriter(f"{name}-{len(done):04d}.warc.zst")
                writer.add(*make_record(*row))
                if writer.content >= BUNDLE:
                    done.append(writer.close())
                    writer = None
        if writer:
            done.append(writer.close())
        if done:
            columns = [list(c) for c in zip(*done, strict=True)]
            yield pa.RecordBatch.from_pydict(dict(zip(("address", "frames", "records"), columns, strict=True)))

    return written(rows.mapInArrow(write, "address string, frames long, records long"))


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Rows of ``READ`` from all bundles, a bundle's frames one at a time."""

    schema = to_arrow_schema(StructType.fromDDL(READ))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for address in batch.column(0).to_pylist():
                rows = []
                for record in BundleReader(address).records():
                    rows.append(parse_record(record))
                    if len(rows) == 4096:
                        yield _batch(pa, rows, schema)
                        rows = []
                if rows:
                    yield _batch(pa, rows, schema)

    parts = bundles.sparkSession.sparkContext.defaultParallelism
    dealt = bundles.select("address").repartition(max(parts, 2), "address")
    return dealt.mapInArrow(read, READ)


def _batch(pa, rows, schema):
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def new_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"


def warc_round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes the pages to bundles in the shared folder and reads them back."""
    return read_bundles(write_bundles(pages, new_folder(pages.sparkSession), least=least))
