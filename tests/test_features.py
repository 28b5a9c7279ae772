"""Feature families on tones and against direct formulas."""

import numpy as np
import pytest
from helpers import make_signals, tone

from wavelark.functions import descriptors as D
from wavelark.model import FeatureConfig
from wavelark.operators import features as T

SR = 16000


def collect(rows):
    return {(r.recording_id, r.frame_idx): np.array(r["values"], dtype=float) for r in rows.collect()}


def split(values, config):
    out, at = {}, 0
    for name, width in T.layout(config):
        out[name] = values[at : at + width]
        at += width
    return out


def test_default_length_is_558():
    assert T.vector_length(FeatureConfig()) == 558
    assert T.vector_length(FeatureConfig(stats=("mean", "std", "nonsense"))) == 558
    with pytest.raises(ValueError):
        FeatureConfig.from_dict({"bogus": True})


def test_custom_config_length():
    config = FeatureConfig.from_dict(
        {"n_mfcc": 13, "chroma": False, "mel": False, "contrast": False, "tonnetz": False}
    )
    assert T.vector_length(config) == 2 * (13 * 3 + 4 + 2)


def test_tone_lands_where_it_should(spark):
    config = FeatureConfig()
    signals = make_signals(spark, {"a": tone(440, 3.0)}, chunk=48000)
    rows = collect(T.frame_features(signals, config))
    assert len(rows) == 48000 // 512 + 1
    mid = split(rows[("a", 40)], config)
    assert mid["chroma"].argmax() == 9  # A
    centres = D.mel_to_hz(np.linspace(0, D.hz_to_mel(SR / 2), 130))[1:-1]
    assert abs(centres[mid["mel"].argmax()] - 440) < 40
    assert abs(mid["centroid"][0] - 440) < 20
    assert abs(mid["rms"][0] - 0.5 / np.sqrt(2)) < 0.01
    assert abs(mid["zcr"][0] - 2 * 440 / SR) < 0.003
    assert np.abs(mid["delta"]).max() < 0.1
    assert mid["flatness"][0] < 0.01


def test_blocks_do_not_change_features(spark):
    x = np.random.default_rng(0).normal(size=90000)
    config = FeatureConfig(spectral_flux=True)
    one = collect(T.frame_features(make_signals(spark, {"a": x}, chunk=90000), config))
    many = collect(T.frame_features(make_signals(spark, {"a": x}, chunk=9000, halo=60000), config))
    assert one.keys() == many.keys() and len(one) == 90000 // 512 + 1
    for key, values in one.items():
        assert np.allclose(values, many[key], equal_nan=True)


def test_against_whole_signal_formulas(spark):
    x = np.random.default_rng(1).normal(size=70000) * np.linspace(0, 1, 70000) ** 3
    config = FeatureConfig(spectral_flux=True)
    rows = collect(T.frame_features(make_signals(spark, {"a": x}, chunk=70000), config))
    padded = np.pad(x, 1024)
    n = 70000 // 512 + 1
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(2048) / 2048)
    mag = np.abs(np.array([np.fft.rfft(padded[i * 512 : i * 512 + 2048] * window) for i in range(n)]))
    mel = mag**2 @ D.mel_matrix(SR, 2048).T
    db = 10 * np.log10(np.maximum(mel, 1e-10))
    mfcc = np.maximum(db, db.max() - 80) @ D.dct_matrix(40, 128).T
    edge = np.pad(mfcc, ((4, 4), (0, 0)), mode="edge")
    k = np.arange(-4, 5)
    delta = np.array([(edge[i : i + 9] * k[:, None]).sum(axis=0) / (k**2).sum() for i in range(n)])
    flux = np.sqrt((np.diff(mag, axis=0) ** 2).sum(axis=1))
    for i in (0, 1, 30, 63, 64, 65, 100, n - 1):
        got = split(rows[("a", i)], config)
        assert np.allclose(got["mel"], mel[i]) and np.allclose(got["mfcc"], mfcc[i])
        assert np.allclose(got["delta"], delta[i])
        if i:
            assert np.isclose(got["flux"][0], flux[i - 1])
        frame = padded[i * 512 : i * 512 + 2048]
        assert np.isclose(got["rms"][0], np.sqrt(np.mean(frame**2)))


def test_vectors_equal_statistics_of_frames(spark):
    rng = np.random.default_rng(2)
    signals = make_signals(spark, {"a": rng.normal(size=40000), "b": rng.normal(size=1500), "tiny": np.ones(50)}, chunk=40000)
    config = FeatureConfig()
    frames = T.frame_features(signals, config)
    by_frame = collect(frames)
    made = T.feature_vectors(signals, config).collect()
    vectors = {r.recording_id: np.array(r.features) for r in made if r.features is not None}
    assert set(vectors) == {"a", "b"} and {r.recording_id: r.reason for r in made}["tiny"] == "too short"
    for name, got in vectors.items():
        matrix = np.array([v for (rec, _), v in sorted(by_frame.items()) if rec == name])
        expected, at = [], 0
        for _, width in T.layout(config):
            part = matrix[:, at : at + width]
            expected += [part.mean(axis=0), part.std(axis=0)]
            at += width
        assert got.shape == (558,) and np.allclose(got, np.concatenate(expected), rtol=1e-6, atol=1e-6)


def test_all_statistics(spark):
    x = np.random.default_rng(3).normal(size=40000)
    config = FeatureConfig.from_dict(
        {n: n in ("rms", "spectral_flux") for n in FeatureConfig.__dataclass_fields__ if n not in ("n_mfcc", "stats")}
        | {"stats": ["mean", "std", "skew", "kurtosis", "median"]}
    )
    signals = make_signals(spark, {"a": x}, chunk=40000)
    matrix = np.array([v for _, v in sorted(collect(T.frame_features(signals, config)).items())])
    got = T.feature_vectors(signals, config).first().features
    expected = []
    for i in range(2):
        v = matrix[:, i][~np.isnan(matrix[:, i])]
        z = (v - v.mean()) / v.std()
        expected += [v.mean(), v.std(), (z**3).mean(), (z**4).mean() - 3, np.median(v)]
    assert np.allclose(got, expected)


def test_mel_db_is_relative_to_the_loudest(spark):
    rows = T.mel_db(make_signals(spark, {"a": tone(440, 1.0)}, chunk=16000)).collect()
    matrix = np.array([r.mel_db for r in rows])
    assert matrix.max() == 0 and matrix.min() >= -80


def test_value_buckets_keep_the_order_of_all_doubles(spark):
    from pyspark.sql import functions as F
    from wavelark.operators.ordered import distinct_counts, counted, value_bucket

    sizes = [5e-324, *(10.0**e for e in range(-300, 301, 5))]
    values = sorted([0.0, *sizes, *(-x for x in sizes)])
    df = spark.createDataFrame([(1, x) for x in values], "k int, x double")
    rows = sorted(tuple(r) for r in df.select("x", value_bucket(F.col("x"))).collect())
    assert [b for _, b in rows] == sorted(b for _, b in rows)
    below = counted(distinct_counts(df, ["k"], "x"), ["k"], "x").orderBy("x").collect()
    assert [r.below for r in below] == list(range(len(values)))
