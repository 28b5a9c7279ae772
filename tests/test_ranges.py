"""Recordings by byte ranges: equal to ``decode``, whatever their size."""

import os
import struct

import numpy as np
import pytest
from compare import connect, difference
from wavelark.plans import all_queries
from wavelark.sources import ranges as R
from wavelark.sources import recordings as W


def riff(path, body, kind=1, channels=1, rate=8000, bits=16, before=b"", size=None, name=b"RIFF"):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, kind, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    data = struct.pack("<4sI", b"data", len(body) if size is None else size)
    with open(path, "wb") as out:
        out.write(name + struct.pack("<I", 0xFFFFFFFF if name == b"RF64" else 36 + len(body)) + b"WAVE" + before + fmt + data + body)


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("ranges"))
    rng = np.random.default_rng(4)
    pcm = lambda n: rng.integers(-32768, 32767, n).astype("<i2").tobytes()
    riff(f"{root}/a/mono.wav", pcm(10_007))
    riff(f"{root}/a/stereo.wav", pcm(9000), channels=2)
    riff(f"{root}/a/bytes.wav", rng.integers(0, 255, 5001).astype(np.uint8).tobytes(), bits=8)
    riff(f"{root}/b/three.wav", rng.integers(0, 255, 3 * 4321).astype(np.uint8).tobytes(), bits=24)
    riff(f"{root}/b/float.wav", rng.normal(size=3000).astype("<f4").tobytes(), kind=3, bits=32, rate=11025)
    riff(f"{root}/b/double.wav", rng.normal(size=1).astype("<f8").tobytes(), kind=3, bits=64)
    riff(f"{root}/b/odd list.wav", pcm(50), before=struct.pack("<4sI", b"LIST", 3) + b"abc\0")
    riff(f"{root}/b/cut.wav", pcm(700), size=0xFFFFFFFF)
    riff(f"{root}/c/empty.wav", b"")
    riff(f"{root}/c/law.wav", pcm(50), kind=7, bits=8)
    riff(f"{root}/c/half.wav", pcm(7), channels=2)
    for name, data in (("text", b"hello"), ("short", b"RIFF\0\0\0\0WAVE"), ("fmt", b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0\x01\0"), ("late", b"RIFF\0\0\0\0WAVEdata\2\0\0\0ab")):
        with open(f"{root}/c/{name}.wav", "wb") as out:
            out.write(data)
    return root


def rows(df):
    key = ["recording_id", "class_name", "channel", "sr", "n_total", "start", "own"]
    return sorted((*[r[k] for k in key], tuple(r.samples)) for r in df.collect())


@pytest.mark.parametrize("mono, target", [(True, None), (False, None), (True, 6000), (False, 11025)])
def test_equal_to_decode(spark, folder, mono, target):
    whole = W.valid_signals(W.decode(W.scan_recordings(spark, folder, content=True), mono, target, 1000, 250))
    known = R.scan_headers(spark, folder)
    assert rows(R.read_ranges(known, mono, target, 1000, 250, task_bytes=4000)) == rows(whole)


def test_headers_find_the_same_invalid_files(spark, folder):
    whole = W.invalid_files(W.decode(W.scan_recordings(spark, folder, content=True)))
    known = R.scan_headers(spark, folder)
    assert {r.recording_id for r in W.invalid_files(known).collect()} == {r.recording_id for r in whole.collect()}
    assert known.count() == 15 and known.filter("error IS NULL").count() == 8
    layout = {os.path.basename(r.path): (r.channels, r.sr, r.bits, r.frames) for r in known.collect()}
    assert layout["stereo.wav"] == (2, 8000, 16, 4500) and layout["float.wav"] == (1, 11025, 32, 3000)


def test_huge_file_by_ranges(spark, tmp_path):
    """Over 5 GB, sparse: every chunk is a range, none is the file; headers read none of it."""
    frames = 2_700_000_000
    ds64 = struct.pack("<4sIQQQI", b"ds64", 28, 2 * frames + 72, 2 * frames, frames, 0)
    path = f"{tmp_path}/big/long.wav"
    riff(path, b"", before=ds64, size=0xFFFFFFFF, name=b"RF64")
    head = os.path.getsize(path)
    marks = {0: 1000, 262_143: -7, 262_144: 9, 1_500_000_000: 12_345, frames - 1: -32_768}
    with open(path, "r+b") as out:
        for place, value in marks.items():
            out.seek(head + 2 * place)
            out.write(struct.pack("<h", value))
    known = R.scan_headers(spark, str(tmp_path))
    assert [(r.frames, r.error) for r in known.collect()] == [(frames, None)]
    ranges = R.plan_ranges(known)
    assert ranges.count() == -(-frames // W.CHUNK)
    assert ranges.selectExpr("sum(own)").first()[0] == frames
    wanted = ranges.filter(ranges.start.isin([p // W.CHUNK * W.CHUNK for p in marks]))
    found = {}
    with R.open_file(path) as file:
        for row in wanted.collect():
            signal = R._range(file, row, True, None, W.HALO)[0]
            assert len(signal) <= W.CHUNK + W.HALO
            for place, value in marks.items():
                if row.start <= place < row.start + row.own:
                    found[place] = signal[place - row.start]
    assert found == {p: v / 32768 for p, v in marks.items()}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    queries, sql = all_queries()
    assert difference(queries["recording_ranges"](spark, sf), connect(sf), sql["recording_ranges"]) is None
