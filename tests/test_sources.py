"""Scanning, decoding, labelling and writing of files."""

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelark.model import FilterConfig
from wavelark.operators import dataset as S
from wavelark.operators import quality as Q
from wavelark.operators import runs as R
from wavelark.functions.text import normalise_class, variant_name
from wavelark.sources import metadata as M
from wavelark.sources import recordings as W
from wavelark.sources.sinks import write_partitioned


def write_wav(path, samples, sr=8000, width=2, channels=1):
    path.parent.mkdir(parents=True, exist_ok=True)
    with wave.open(str(path), "wb") as out:
        out.setnchannels(channels)
        out.setsampwidth(width)
        out.setframerate(sr)
        if width == 2:
            out.writeframes((np.asarray(samples) * 32767).astype("<i2").tobytes())
        elif width == 1:
            out.writeframes((np.asarray(samples) * 127 + 128).astype(np.uint8).tobytes())
        else:
            raw = (np.asarray(samples) * 8388607).astype("<i4")
            out.writeframes(b"".join(struct.pack("<i", int(v))[:3] for v in raw.ravel()))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("audio")
    t = np.arange(20000) / 8000
    x = 0.5 * np.sin(2 * np.pi * 440 * t)
    write_wav(root / "siren" / "a.wav", x)
    write_wav(root / "siren" / "b.WAV", x[:8000], width=3)
    write_wav(root / "dog" / "a.wav", np.column_stack([x, -x])[:4000], channels=2)
    write_wav(root / "dog" / "c.wav", x[:4000], width=1)
    (root / "dog" / "broken.wav").write_bytes(b"RIFFnonsense")
    (root / "dog" / "empty.wav").write_bytes(b"RIFF")
    (root / "notes.txt").write_text("x")
    (root / "meta").mkdir()
    (root / "meta" / "esc50.csv").write_text("filename,category,fold\n a.wav ,Dog Bark,1\nb.WAV,Siren,2\nmissing.wav,Siren,3\n")
    return root


def test_scan_and_decode(spark, folder):
    files = W.scan_recordings(spark, str(folder))
    assert files.count() == 6 and "content" not in files.columns
    assert "content" not in files._jdf.queryExecution().optimizedPlan().toString().split("Relation")[0]
    decoded = W.decode(W.scan_recordings(spark, str(folder), content=True), mono=False, chunk=3000, halo=100)
    bad = {r.recording_id.rsplit("/", 1)[1]: r.error for r in W.invalid_files(decoded).collect()}
    assert set(bad) == {"broken.wav", "empty.wav"}
    good = W.valid_signals(decoded)
    shapes = {(r.recording_id.rsplit("/", 2)[-2:][0], r.recording_id.rsplit("/", 1)[1], r.channel): r.n for r in good.groupBy("recording_id", "channel").agg(F.sum("own").alias("n")).collect()}
    assert shapes[("siren", "a.wav", 0)] == 20000 and shapes[("dog", "a.wav", 1)] == 4000
    rows = good.filter("class_name = 'siren' and n_total = 20000").orderBy("start").collect()
    x = np.concatenate([r.samples[: r.own] for r in rows])
    assert np.allclose(x, 0.5 * np.sin(2 * np.pi * 440 * np.arange(20000) / 8000), atol=1e-4)
    assert len(rows[0].samples) == 3100
    report = {r.class_name: (r.decoded, r.failed) for r in W.ingest_report(decoded).collect()}
    assert report == {"siren": (2, 0), "dog": (2, 2)}


def test_mono_and_resampling(spark, folder):
    files = W.scan_recordings(spark, str(folder), content=True)
    mono = W.valid_signals(W.decode(files, target_sr=4000)).filter("class_name = 'dog'")
    rows = {r.recording_id.rsplit("/", 1)[1]: r for r in mono.collect()}
    assert rows["a.wav"].n_total == 2000 and rows["a.wav"].sr == 4000 and np.allclose(rows["a.wav"].samples, 0, atol=1e-4)


def test_float_and_extensible_wav():
    x = np.array([0.25, -0.5], dtype="<f4")
    fmt = struct.pack("<HHIIHH", 3, 1, 8000, 32000, 4, 32)
    body = b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", 8) + x.tobytes()
    data, sr = W.read_wav(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)
    assert sr == 8000 and data[:, 0].tolist() == [0.25, -0.5]
    fmt = struct.pack("<HHIIHH", 0xFFFE, 1, 8000, 16000, 2, 16) + struct.pack("<HHI", 22, 16, 0) + struct.pack("<H", 1) + b"\0" * 14
    body = b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", len(fmt)) + fmt + b"data" + struct.pack("<I", 2) + struct.pack("<h", -32768)
    assert W.read_wav(b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body)[0][0, 0] == -1.0
    with pytest.raises(ValueError):
        W.read_wav(b"RIFF0000WAVEfmt ")


def test_homogenise_from_files(spark, folder):
    path = M.find_metadata(spark, str(folder))
    assert path.endswith("meta/esc50.csv")
    meta = M.read_metadata(spark, path)
    recordings = W.scan_recordings(spark, str(folder))
    labelled = S.homogenise(recordings, meta)
    assert {(r.file_name, r.class_name) for r in labelled.collect()} == {("a.wav", "Dog Bark"), ("b.WAV", "Siren")}
    assert labelled.filter("file_name = 'a.wav'").first().path.endswith("dog/a.wav")  # first by path
    assert S.duplicate_names(recordings).count() == 1
    assert [r.file_name for r in S.unmatched(meta, recordings).collect()] == ["missing.wav"]
    with pytest.raises(FileNotFoundError):
        M.find_metadata(spark, str(folder / "dog"))
    with pytest.raises(ValueError, match="file column"):
        S.detect_columns(["x", "class"])
    assert S.detect_columns(["label", "file", "class"]) == ("file", "class")


def test_quality_gate_from_files(spark, folder):
    decoded = W.decode(W.scan_recordings(spark, str(folder), content=True))
    gated = Q.quality_gate(W.valid_signals(decoded), FilterConfig(min_snr_db=None), W.invalid_files(decoded))
    report = {r.class_name: (r.accepted, r.rejected) for r in Q.quality_report(gated).collect()}
    assert report["siren"] == (2, 0) and sum(report["dog"]) == 4


def test_partitioned_sink_is_idempotent(spark, tmp_path):
    df = spark.createDataFrame([("a", "f1", 1), ("b", "f2", 2)], "class_name string, file_name string, x int")
    more = df.unionByName(spark.createDataFrame([("a", "f3", 3)], df.schema))
    path = str(tmp_path / "out")
    for rows in (df, df, more, more):
        write_partitioned(rows, path, ["class_name"], ["class_name", "file_name"])
    assert spark.read.parquet(path).count() == 3
    split = S.assign_splits(more.withColumn("recording_id", F.col("file_name")))
    write_partitioned(split, path + "2", ["split", "class_name"], ["split", "class_name", "file_name"])
    assert (tmp_path / "out2" / "split=test" / "class_name=a").is_dir()


def test_url_list(spark, tmp_path):
    (tmp_path / "urls.txt").write_text("http://a\n\n  http://b  \n")
    rows = M.url_list(spark, str(tmp_path / "urls.txt")).orderBy("line_no").collect()
    assert [(r.url, r.output_name) for r in rows] == [("http://a", "urls_1.wav"), ("http://b", "urls_3.wav")]


@pytest.mark.parametrize("n,sizes", [(5, (3, 1, 1)), (20, (14, 3, 3)), (7, (4, 1, 2)), (1, (0, 0, 1))])
def test_split_sizes(spark, n, sizes):
    df = spark.range(n).select(F.col("id").cast("string").alias("recording_id"), F.lit("c").alias("class_name"))
    out = S.assign_splits(df)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert tuple(counts.get(s, 0) for s in ("train", "validation", "test")) == sizes
    again = {r.recording_id: r.split for r in S.assign_splits(df.repartition(3)).collect()}
    assert again == {r.recording_id: r.split for r in out.collect()} and len(again) == n


def test_names(spark):
    df = spark.createDataFrame([(" Air  Conditioner ",)], "c string")
    assert df.select(normalise_class("c")).first()[0] == "air_conditioner"
    kinds = {"pitch": "_ps+2.0", "stretch": "_ts2.0", "noise": "_noise2dB", "volume": "_vol+2dB", "pitch_hz": "_+2Hz", "reversed": "_reversed"}
    for kind, suffix in kinds.items():
        assert df.select(variant_name(F.lit("x"), F.lit(kind), F.lit(2.0))).first()[0] == "x" + suffix


def test_experiment_log(spark):
    log = spark.createDataFrame(
        [(1, 1, "draft", "{}", None), (1, 2, "running", None, None), (2, 1, "draft", "{}", None), (2, 2, None, None, True)],
        "id int, version int, status string, config string, deleted boolean",
    )
    rows = R.latest_values(log, ["status", "config"]).collect()
    assert [(r.id, r.status, r.config) for r in rows] == [(1, "running", "{}")]
    bad = spark.createDataFrame([("not json",), ('{"k": 3}',), (None,)], "t string")
    assert [r[0] for r in bad.select(R.json_number("t", "k")).collect()] == [None, 3.0, None]
