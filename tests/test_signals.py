"""Framing, spectra, Doppler, direction and quality on golden signals."""

import numpy as np
import pytest
from helpers import assemble, make_signals, tone
from pyspark.sql import functions as F

from wavelark.functions import register
from wavelark.functions.sql import decode_float32, decode_pcm16
from wavelark.model import BANDS, FilterConfig
from wavelark.operators import bands as B
from wavelark.operators import direction as D
from wavelark.operators import doppler as V
from wavelark.operators import events as E
from wavelark.operators import quality as Q
from wavelark.operators import segment as G
from wavelark.operators.framing import chunked, frames, sliding_windows, stft_frames, with_halo
from wavelark.operators.ordered import exact_quantile, previous, row_index, running, top_k
from wavelark.operators.spectrogram import waveform_envelope

SR = 16000


def test_noise_pair_lag(spark):
    x = np.random.default_rng(0).normal(size=16000)
    signals = make_signals(spark, {("a", 0): x, ("a", 1): np.roll(x, 5)}, chunk=16000)
    row = D.doa_array(signals.withColumn("frame_idx", F.lit(0)), [(0.0, 0.0), (0.5, 0.0)]).first()
    assert row.tdoa_s == pytest.approx(-5 / SR) and row.distance_m == 0.5
    assert row.angle_deg == pytest.approx(np.degrees(np.arcsin(-343 * 5 / SR / 0.5)))


def test_coinciding_microphones_are_skipped(spark):
    x = np.random.default_rng(0).normal(size=200)
    signals = make_signals(spark, {("a", c): x for c in range(3)}, chunk=200).withColumn("frame_idx", F.lit(0))
    rows = D.doa_array(signals, [(0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.1, 0.0, 0.0)]).collect()
    assert [r.channel for r in rows] == [2]
    assert not D.has_channel(signals, 5).first().present
    with pytest.raises(ValueError):
        D.channel(signals, -1)


def test_chirp_doppler(spark):
    t = np.arange(2 * SR) / SR
    hz = 1000 + 50 * np.sin(2 * np.pi * 0.5 * t)  # a swing of 50 Hz around 1 kHz
    x = np.sin(np.cumsum(hz) * 2 * np.pi / SR).astype(np.float32)
    track = V.frequency_track(make_signals(spark, {"a": x}, chunk=5000, halo=2000))
    row = V.doppler_summary(V.doppler_track(track, source_frequency=1000.0, distance_m=50.0)).first()
    assert row.n_frames == 39 and row.duration_s == 2.0
    assert row.mean_velocity_m_s == pytest.approx(-0.441293, abs=1e-5)
    assert row.max_velocity_m_s == pytest.approx(18.038571, abs=1e-5)
    rows = V.doppler_track(track, source_frequency=1000.0).groupBy("direction").count().collect()
    assert {r.direction: r["count"] for r in rows} == {"approaching": 19, "receding": 19, "stationary": 1}
    first = V.doppler_track(track, source_frequency=1000.0).orderBy("frame_idx").filter("direction <> 'stationary'").first()
    assert row.dominant_direction == first.direction


def test_band_tone(spark):
    x = np.sin(2 * np.pi * 1000 * np.arange(SR) / SR).astype(np.float32)
    profile = B.first_frame_energy(make_signals(spark, {"a": x}, chunk=SR))
    energy = {r["name"]: r.energy for r in B.band_rows(profile).collect()}
    assert energy["low_mid"] == pytest.approx(0.166748, abs=1e-6)
    assert energy["mid"] == pytest.approx(0.833252, abs=1e-6)
    assert max(v for k, v in energy.items() if k not in ("mid", "low_mid")) < 1e-12
    guess = B.hybrid_classify(profile).first()
    assert guess.first_guess == "fixed_wing" and guess.method == "frequency_band" and guess.is_moving is None
    assert [c["class"] for c in guess.candidates] == ["human_voice", "fixed_wing", "siren"] or [
        c["class"] for c in guess.candidates
    ] == ["fixed_wing", "human_voice", "siren"]


def test_band_energy_hears_the_whole_recording(spark):
    """Energy at the end of a long recording, or in a last partial frame, changes the profile."""
    quiet = tone(200, seconds=4.0)
    late = quiet.copy()
    late[-2000:] += 5 * tone(5000, seconds=2000 / SR)
    signals = make_signals(spark, {"quiet": quiet, "late": late}, chunk=20000, halo=4096)
    strongest = {r.recording_id: max(r.bands, key=lambda b: b.energy)["name"] for r in B.band_energy(signals).collect()}
    assert strongest == {"quiet": "bass", "late": "upper_mid"}
    first = {r.recording_id: max(r.bands, key=lambda b: b.energy)["name"] for r in B.first_frame_energy(signals).collect()}
    assert first == {"quiet": "bass", "late": "bass"}


def test_silence(spark):
    signals = make_signals(spark, {"a": np.zeros(SR)}, chunk=SR)
    assert {r.energy for r in B.band_rows(B.band_energy(signals)).collect()} == {0.0}
    row = Q.quality_gate(signals).first()
    assert row.reason == "too_quiet (-inf dBFS)" and row.rms_db == float("-inf")
    guess = B.hybrid_classify(B.band_energy(signals)).first()
    assert guess.first_guess == BANDS[0].sources[0]


def test_motion_needs_a_direction(spark):
    signals = make_signals(spark, {"a": tone(200), "b": tone(200)}, chunk=SR)
    still = V.doppler_summary(V.doppler_track(V.frequency_track(signals.filter("recording_id = 'a'"))))
    rows = {r.recording_id: r for r in B.hybrid_classify(B.band_energy(signals), still).collect()}
    assert rows["a"].is_moving is False and rows["a"].method == "frequency_band+doppler"
    assert rows["b"].is_moving is None and rows["b"].method == "frequency_band"


def test_exact_fit_window_is_dropped(spark):
    signals = make_signals(spark, {"a": np.arange(100.0)}, sr=100, chunk=30, halo=120)
    assert sliding_windows(signals, 1.0, 0.5).count() == 0
    assert sliding_windows(signals, 1.0, 0.5, inclusive=True).count() == 1
    assert sliding_windows(signals, 1.0, 0.5, rate=44100).count() == 0
    assert sorted(r.start for r in sliding_windows(signals, 0.5, 0.25).collect()) == [0, 25]
    assert sorted(r.start for r in chunked(signals, 0.25).collect()) == [0, 25, 50, 75]
    with pytest.raises(ValueError):
        chunked(signals, 1.0, 1.0)
    assert E.scene_windows(signals, 0.5).count() == 1


def test_frames_equal_slices_for_any_chunking(spark):
    x = np.random.default_rng(0).normal(size=1003)
    padded = np.pad(x, 64)
    for chunk, halo in ((1003, 0), (100, 128), (37, 200)):
        rows = stft_frames(make_signals(spark, {"a": x}, chunk=chunk, halo=halo), 128, 32).collect()
        assert sorted(r.frame_idx for r in rows) == list(range(1003 // 32 + 1))
        for r in rows:
            want = padded[r.frame_idx * 32 : r.frame_idx * 32 + 128]
            assert np.array_equal(r.samples, np.pad(want, (0, 128 - len(want))))


def test_short_halo_is_an_error_and_can_be_added(spark):
    x = np.arange(100.0)
    signals = make_signals(spark, {"a": x}, chunk=10)
    with pytest.raises(Exception, match="with_halo"):
        frames(signals, 25, 25, F.lit(4)).collect()
    rows = frames(with_halo(signals, 24), 25, 25, F.lit(4)).orderBy("frame_idx").collect()
    assert np.array_equal(np.concatenate([r.samples for r in rows]), x)
    assert np.array_equal(assemble(with_halo(signals, 24), "a"), x)


def test_snr_and_gate_order(spark):
    rng = np.random.default_rng(0)
    burst = np.concatenate([0.01 * rng.normal(size=8000), 0.3 * rng.normal(size=8000)])
    signals = make_signals(
        spark, {"good": burst, "flat": 0.1 * np.ones(16000), "short": burst[:4000], "loud": np.full(16000, 1.2)},
        chunk=4000, halo=400,
    )
    rows = {r.recording_id: r for r in Q.quality_gate(signals).collect()}
    assert rows["good"].reason == "ok" and rows["short"].reason == "too_short (0.25s)"
    assert rows["flat"].reason == "low_snr (0.0 dB)" and rows["loud"].reason == "clipped (1.6 dBFS)"
    cut = np.array([burst[i * 160 : i * 160 + 400] for i in range((16000 - 400) // 160 + 1)])
    energy = np.sort((cut**2).sum(axis=1))
    expected = 10 * np.log10(energy.mean() / energy[: int(len(energy) * 0.1)].mean())
    assert rows["good"].snr_db == pytest.approx(expected)
    free = Q.quality_gate(signals, FilterConfig(min_snr_db=None))
    assert {r.recording_id for r in free.filter("passed").collect()} == {"good", "flat"}
    errors = spark.createDataFrame([("bad", "c", "not a WAV file")], "recording_id string, class_name string, error string")
    gated = Q.quality_gate(signals, errors=errors)
    assert gated.filter("recording_id = 'bad'").first().reason == "load_error: not a WAV file"
    report = Q.quality_report(gated).first()
    assert (report.accepted, report.rejected) == (1, 4)
    assert Q.accepted(signals, gated).select("recording_id").distinct().count() == 1


def test_clicks_and_segments_follow_the_definition(spark):
    rng = np.random.default_rng(0)
    x = 0.01 * rng.normal(size=20000)
    x[[3000, 9000, 9100]] += 1
    signals = make_signals(spark, {"a": x}, sr=1000, chunk=700, halo=10)
    jumps = np.abs(np.diff(x))
    expected = np.flatnonzero(jumps > jumps.mean() + 2 * jumps.std())
    got = sorted(r.idx for r in G.clicks(signals).collect())
    assert got == expected.tolist()
    bounds = np.concatenate([[0], expected, [len(x)]])
    want = [
        (int(a), int(b - a)) for a, b in zip(bounds[:-1], bounds[1:])
        if b - a >= 2000 and 20 * np.log10(np.sqrt(np.mean(x[a:b] ** 2))) > -50
    ]
    rows = G.segments(signals, min_ms=2000).orderBy("number").collect()
    assert [(r.first_idx, r.n_samples) for r in rows] == want and [r.number for r in rows] == list(range(1, len(want) + 1))


def test_envelope(spark):
    x = np.random.default_rng(0).normal(size=1000)
    rows = waveform_envelope(make_signals(spark, {"a": x}, chunk=77), 8).orderBy("bucket").collect()
    place = np.arange(1000) * 8 // 1000
    assert [(r.low, r.high) for r in rows] == [(x[place == b].min(), x[place == b].max()) for b in range(8)]


def test_ordered_helpers(spark):
    rng = np.random.default_rng(0)
    values = rng.integers(0, 50, 3000).astype(float)
    rows = [("hot" if i % 3 else f"k{i % 7}", i, float(v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k string, t long, v double").repartition(5)
    out = row_index(df, ["k"], F.floor(F.col("t") / 100), ["t"])
    out = running(out, ["k"], F.floor(F.col("t") / 100), ["t"], {"before": F.col("v")})
    out = previous(out, ["k"], "idx", {"last": "v"}, block=64)
    got = {(r.k, r.t): (r.idx, r.before, r["last"]) for r in out.collect()}
    state = {}
    for k, t, v in rows:
        n, total, last = state.get(k, (0, 0.0, None))
        assert got[(k, t)] == (n, total, last)
        state[k] = (n + 1, total + v, v)
    for q in (0.0, 0.1, 0.5, 0.77, 1.0):
        for r in exact_quantile(df, ["k"], "v", q).collect():
            assert r.quantile == pytest.approx(np.quantile([v for k, _, v in rows if k == r.k], q))
    assert exact_quantile(df, [], "v", 0.5).first().quantile == np.median(values)
    best = top_k(df, ["k"], ["v", "t"], 3, "t").collect()
    for k in {r.k for r in best}:
        want = sorted((v, t) for kk, t, v in rows if kk == k)[:3]
        assert [(r.v, r.t) for r in sorted((r for r in best if r.k == k), key=lambda r: r["rank"])] == want


def test_sql_functions(spark):
    register(spark)
    x = tone(1000, 0.1)
    spark.createDataFrame([(x.tolist(), SR, (x * 32767).astype("<i2").tobytes())], "s array<double>, sr int, raw binary").createOrReplaceTempView("t")
    row = spark.sql(
        "SELECT dominant_freq(s, sr) AS f, size(power_spectrum(s)) AS n, gcc_phat(s, s, 10) AS d, decode_pcm(raw) AS p FROM t"
    ).first()
    assert abs(row.f - 1000) < 2 and row.n == 801 and row.d == 0 and np.allclose(row.p, x, atol=1e-3)


def test_raw_decoding(spark):
    x = np.array([0.5, -0.25], dtype="<f4")
    df = spark.createDataFrame([(x.tobytes() + b"\x01",), (None,)], "audio binary")
    rows = df.select(decode_float32("audio").alias("s")).collect()
    assert [r.s for r in rows] == [[0.5, -0.25], None]
    pcm = spark.createDataFrame([(np.array([-32768, 16384], dtype="<i2").tobytes(),)], "audio binary")
    assert pcm.select(decode_pcm16("audio").alias("s")).first().s == [-1.0, 0.5]
