"""Scan folders of recordings and decode WAV files into signal chunks."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavelark.model import AUDIO_EXTENSIONS, SIGNAL_SCHEMA
from wavelark.operators.dataset import is_audio

# A chunk is 2 MB of samples.  The halo, a quarter of it, is long enough for
# the widest block any operator cuts with its defaults (features: 50,688).
CHUNK = 1 << 18
HALO = 1 << 16


def scan_recordings(spark: SparkSession, path: str, exts: Iterable[str] = AUDIO_EXTENSIONS, content: bool = False) -> DataFrame:
    """List files below ``path``; file bytes are read only with ``content``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    parts = F.split("path", "/")
    columns = [
        F.col("path").alias("recording_id"),
        "path",
        F.element_at(parts, -1).alias("file_name"),
        F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"),
        F.element_at(parts, -2).alias("class_name"),
        F.col("length").alias("bytes"),
    ]
    if content:
        columns.append(F.col("content"))
    return files.filter(is_audio(F.col("path"), exts)).select(*columns)


def read_wav(data: bytes) -> tuple[np.ndarray, int]:
    """Samples (frames × channels, floats in [-1, 1]) and rate of a RIFF file."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise ValueError("not a WAV file")
    at, layout = 12, None
    while at + 8 <= len(data):
        tag, size = struct.unpack_from("<4sI", data, at)
        body = at + 8
        if tag == b"fmt ":
            kind, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, body)
            if kind == 0xFFFE:  # extensible: the real kind is in the sub-format
                kind = struct.unpack_from("<H", data, body + 24)[0]
            layout = (kind, channels, rate, bits)
        elif tag == b"data":
            if layout is None:
                raise ValueError("data before format")
            kind, channels, rate, bits = layout
            raw = data[body : body + size]
            return _to_float(raw, kind, bits).reshape(-1, channels), rate
        at = body + size + size % 2
    raise ValueError("no data chunk")


def _to_float(raw: bytes, kind: int, bits: int) -> np.ndarray:
    width = bits // 8
    raw = raw[: len(raw) // width * width] if width else raw
    if kind == 3 and bits in (32, 64):
        return np.frombuffer(raw, dtype=f"<f{width}").astype(np.float64)
    if kind != 1 or bits not in (8, 16, 24, 32):
        raise ValueError(f"unsupported encoding {kind}/{bits}")
    if bits == 8:
        return (np.frombuffer(raw, dtype=np.uint8).astype(np.float64) - 128) / 128
    if bits == 24:
        padded = np.zeros((len(raw) // 3, 4), dtype=np.uint8)
        padded[:, 1:] = np.frombuffer(raw, dtype=np.uint8).reshape(-1, 3)
        return padded.view("<i4").reshape(-1) / 2.0**31
    return np.frombuffer(raw, dtype=f"<i{width}") / 2.0 ** (bits - 1)


def decode(
    recordings: DataFrame, mono: bool = True, target_sr: int | None = None, chunk: int = CHUNK, halo: int = HALO
) -> DataFrame:
    """Signal chunks of every file, or one row with ``error`` where decoding fails.

    ``recordings`` comes from ``scan_recordings(content=True)``.  A file is read
    by one task and leaves it as bounded chunk rows.
    """

    def chunks(row) -> Iterator[tuple]:
        samples, rate = read_wav(row.content)
        if len(samples) == 0:
            raise ValueError("no samples")
        channels = samples.mean(axis=1, keepdims=True) if mono else samples
        if target_sr and target_sr != rate:
            places = np.arange(int(len(channels) * target_sr / rate)) * rate / target_sr
            grid = np.arange(len(channels))
            channels = np.stack([np.interp(places, grid, c) for c in channels.T], axis=1)
            rate = target_sr
        n = len(channels)
        for c, signal in enumerate(channels.T):
            for start in range(0, n, chunk):
                own = min(chunk, n - start)
                yield (
                    row.recording_id, row.class_name, c, rate, n, start, own,
                    signal[start : start + own + halo], None,
                )

    names = ["recording_id", "class_name", "channel", "sr", "n_total", "start", "own", "samples", "error"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                # A file fails before its first chunk or not at all, so chunks leave as they are cut.
                try:
                    for chunk_row in chunks(row):
                        yield pd.DataFrame([chunk_row], columns=names)
                except (ValueError, struct.error) as error:
                    failed = (row.recording_id, row.class_name, 0, 0, 0, 0, 0, None, str(error))
                    yield pd.DataFrame([failed], columns=names)

    return recordings.select("recording_id", "class_name", "content").mapInPandas(
        run, SIGNAL_SCHEMA + ", error string"
    )


def valid_signals(decoded: DataFrame) -> DataFrame:
    return decoded.filter(F.col("error").isNull()).drop("error")


def invalid_files(decoded: DataFrame) -> DataFrame:
    """Report of files that could not be decoded; nothing is deleted."""
    return decoded.filter(F.col("error").isNotNull()).select("recording_id", "class_name", "error")


def ingest_report(decoded: DataFrame) -> DataFrame:
    """Decoded and failed files per class."""
    first = (F.col("start") == 0) & (F.col("channel") == 0)
    return decoded.groupBy("class_name").agg(
        F.count_if(first & F.col("error").isNull()).alias("decoded"),
        F.count_if(F.col("error").isNotNull()).alias("failed"),
    )
