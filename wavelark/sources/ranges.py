"""WAV recordings of any size, read by byte ranges.

``scan_headers`` reads the headers alone, a few hundred bytes a file, and says
which files are sound.  ``read_ranges`` turns every recording into chunk rows of
``signals``: each chunk with its halo is one range of bytes, so a recording is
as many tasks as it has chunks and no task holds more than one of them.  The
ranges, not the files, are dealt to the tasks, in order, so that a task opens
few files.

Paths are opened with ``pyarrow.fs``: a folder all nodes mount, or an object
store it knows.  For a file system only Spark can open there is ``decode``.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.model import SIGNAL_SCHEMA
from wavelark.session import materialise
from wavelark.sources.recordings import CHUNK, HALO, _to_float, scan_recordings

HEADER_SCHEMA = (
    "recording_id string, path string, class_name string, bytes long, channels int, sr int, kind int, bits int, "
    "data_start long, frames long, error string"
)
#: Bytes of samples a task reads, about.
TASK_BYTES = 128 << 20
#: Most chunks of a RIFF file that are looked at before its samples.
RIFF_CHUNKS = 10_000


def open_file(path: str):
    """A file of a shared folder or an object store, for reading at any place."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[len("file:") :].lstrip("/"))
    if "://" not in path:
        return fs.LocalFileSystem().open_input_file(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def read_header(file, length: int) -> tuple[int, int, int, int, int, int]:
    """(channels, rate, kind, bits, first byte of the samples, frames) of a WAV file.

    Files above 4 GB carry their sizes in a ``ds64`` chunk; a data chunk that
    claims more than there is ends with the file.
    """
    start = file.read_at(min(12, length), 0)
    if len(start) < 12 or start[:4] not in (b"RIFF", b"RF64") or start[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, layout, long_size = 12, None, None
    for _ in range(RIFF_CHUNKS):
        if at + 8 > length:
            break
        tag, size = struct.unpack("<4sI", file.read_at(8, at))
        body = at + 8
        if tag == b"ds64":
            long_size = struct.unpack("<Q", file.read_at(16, body)[8:16])[0]
        elif tag == b"fmt ":
            head = file.read_at(min(max(size, 16), 40), body)
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", head)
            if kind == 0xFFFE:  # extensible: the real kind is in the sub-format
                kind = struct.unpack_from("<H", head, 24)[0]
            layout = channels, rate, kind, bits
        elif tag == b"data":
            if layout is None:
                raise ValueError("data before format")
            channels, rate, kind, bits = layout
            _to_float(b"", kind, bits)  # an unknown encoding is an error here already
            if size == 0xFFFFFFFF and long_size is not None:
                size = long_size
            values = min(size, length - body) // (bits // 8)
            if channels == 0 or values % channels:
                raise ValueError("incomplete frame")
            if values == 0:
                raise ValueError("no samples")
            return channels, rate, kind, bits, body, values // channels
        at = body + size + size % 2
    raise ValueError("no data chunk")


def headers(files: DataFrame) -> DataFrame:
    """Layout of every file of ``scan_recordings``, or ``error``; no samples are read."""
    names = [c.split()[0] for c in HEADER_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                known = (row.recording_id, row.path, row.class_name, row.bytes)
                try:
                    with open_file(row.path) as file:
                        found = read_header(file, row.bytes)
                    out.append((*known, *found, None))
                except (ValueError, struct.error) as error:
                    out.append((*known, 0, 0, 0, 0, 0, 0, str(error)))
            yield pd.DataFrame(out, columns=names)

    columns = ["recording_id", "path", "class_name", "bytes"]
    return files.select(*columns).mapInPandas(run, HEADER_SCHEMA)


def scan_headers(spark: SparkSession, path: str) -> DataFrame:
    return headers(scan_recordings(spark, path))


def _range(file, row, mono: bool, target_sr: int | None, halo: int) -> np.ndarray:
    """Samples (channels × places) of one chunk with its halo, at the rate asked for."""
    step = 1.0 if row.rate == row.sr else row.sr / row.rate
    stop = min(row.start + row.own + halo, row.n_total)
    if step == 1.0:
        first, last = row.start, stop
    else:
        places = np.arange(row.start, stop) * row.sr / row.rate
        first = min(int(places[0]), row.frames - 1)
        last = min(int(places[-1]) + 2, row.frames)
    width = row.bits // 8 * row.channels
    raw = file.read_at((last - first) * width, row.data_start + first * width)
    samples = _to_float(raw, row.kind, row.bits).reshape(-1, row.channels)
    if len(samples) < last - first:
        raise OSError(f"{row.path} is shorter than its header said")
    samples = samples.mean(axis=1, keepdims=True) if mono else samples
    if step == 1.0:
        return samples.T
    grid = np.arange(first, last)
    return np.stack([np.interp(places, grid, c) for c in samples.T])


def plan_ranges(known: DataFrame, target_sr: int | None = None, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk of every sound file: rate, n_total, start and own at the rate asked for."""
    rate = F.col("sr") if target_sr is None else F.lit(target_sr)
    length = F.when(rate == F.col("sr"), F.col("frames")).otherwise(
        F.floor(F.col("frames") * rate / F.col("sr")).cast("long")
    )
    sized = known.filter("error IS NULL").withColumn("rate", rate).withColumn("n_total", length).filter("n_total > 0")
    step = F.lit(chunk).cast("long")
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_total") - 1, step))
    return sized.withColumn("start", starts).withColumn("own", F.least(step, F.col("n_total") - F.col("start")).cast("int"))


def read_ranges(
    known: DataFrame, mono: bool = True, target_sr: int | None = None, chunk: int = CHUNK, halo: int = HALO,
    task_bytes: int = TASK_BYTES,
) -> DataFrame:
    """``decode`` of files of any size, from their ``headers``; sound files only.

    The rows are those of ``valid_signals(decode(...))``.
    """
    known = materialise(known)  # headers are read once: for the number of tasks and for the ranges
    size = known.filter("error IS NULL").agg(F.sum(F.col("frames") * F.col("channels") * F.col("bits") / 8)).first()[0]
    spark = known.sparkSession
    tasks = max(int((size or 0) / task_bytes) + 1, spark.sparkContext.defaultParallelism)
    ranges = plan_ranges(known, target_sr, chunk)
    # Contiguous ranges of a file share a task; a fixed number of tasks, as these rows are small but not their work.
    dealt = ranges.repartitionByRange(tasks, "path", "start").sortWithinPartitions("path", "start")
    names = [c.split()[0] for c in SIGNAL_SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        path, file = None, None
        try:
            for batch in batches:
                for row in batch.itertuples(index=False):
                    if row.path != path:
                        if file is not None:
                            file.close()
                        path, file = row.path, open_file(row.path)
                    for c, signal in enumerate(_range(file, row, mono, target_sr, halo)):
                        one = (row.recording_id, row.class_name, c, row.rate, row.n_total, row.start, row.own, signal)
                        yield pd.DataFrame([one], columns=names)
        finally:
            if file is not None:
                file.close()

    return dealt.mapInPandas(run, SIGNAL_SCHEMA)


def wav_bytes(samples: np.ndarray, sr: int) -> bytes:
    """A single-channel WAV file of 32-bit floats."""
    body = np.asarray(samples, dtype="<f4").tobytes()
    layout = struct.pack("<4sIHHIIHH", b"fmt ", 16, 3, 1, sr, sr * 4, 4, 32)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVE" + layout + struct.pack("<4sI", b"data", len(body)) + body


def save_wav(recordings: DataFrame, folder: str) -> DataFrame:
    """Write one WAV file per row (recording_id, class_name, sr, samples) below ``folder``; returns their paths.

    A file takes its name only when it is whole, and a repeated task writes the
    same one again.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        from pyarrow import fs

        system, root = (
            (fs.LocalFileSystem(), folder.removeprefix("file://").removeprefix("file:"))
            if folder.startswith("file:") or "://" not in folder
            else fs.FileSystem.from_uri(folder)
        )
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                home = os.path.join(root, row.class_name)
                system.create_dir(home, recursive=True)
                path, draft = f"{home}/{row.recording_id}.wav", f"{home}/.{uuid.uuid4().hex}"
                with system.open_output_stream(draft) as file:
                    file.write(wav_bytes(row.samples, row.sr))
                system.move(draft, path)
                out.append((row.recording_id, path))
            yield pd.DataFrame(out, columns=["recording_id", "path"])

    columns = ["recording_id", "class_name", "sr", "samples"]
    return recordings.select(*columns).mapInPandas(run, "recording_id string, path string")
