"""Augmentation transforms, filters and separation on synthetic signals."""

import numpy as np
import pytest
from helpers import assemble, make_signals, peak_hz, tone
from pyspark.sql import functions as F

from wavelark.model import AugmentConfig
from wavelark.operators import augment as A
from wavelark.operators import filters as X
from wavelark.operators import vocoder as V

SR = 16000


def test_reverse_twice_is_identity(spark):
    x = np.random.default_rng(0).normal(size=9001)
    once = A.reverse_signal(make_signals(spark, {"a": x}, halo=10))
    assert np.array_equal(assemble(once, "a"), x[::-1])
    assert np.array_equal(assemble(A.reverse_signal(once), "a"), x)


def test_volume_up_and_down(spark):
    x = tone(440)
    up = A.scale_volume(make_signals(spark, {"a": x}), 6.0)
    assert np.allclose(assemble(up, "a"), x * 10 ** (6 / 20))
    assert np.allclose(assemble(A.scale_volume(up, -6.0), "a"), x)


def test_noise_has_the_wanted_ratio_and_ignores_partitioning(spark):
    x = tone(440, 2.0)
    signals = make_signals(spark, {"a": x, "silent": np.zeros(5000)})
    noisy = A.add_noise(signals, 15.0)
    y = assemble(noisy, "a")
    measured = 20 * np.log10(np.sqrt(np.mean(x**2)) / np.std(y - x))
    assert abs(measured - 15) < 0.5
    assert np.array_equal(y, assemble(A.add_noise(signals.repartition(7), 15.0), "a"))
    assert not assemble(noisy, "silent").any()


@pytest.mark.parametrize("rate", [0.8, 1.25])
def test_stretch_changes_length_not_pitch(spark, rate):
    x = tone(1000, 6.0)
    out = assemble(V.time_stretch(make_signals(spark, {"a": x}, chunk=40000, halo=40000), rate), "a")
    assert len(out) == round(len(x) / rate)
    assert abs(peak_hz(out) - 1000) < 2
    inner = out[4000:-4000]
    assert abs(np.sqrt(np.mean(inner**2)) / np.sqrt(np.mean(x**2)) - 1) < 0.15  # a vocoder loses some phase coherence


def _slow_vocoder(x, rate, n_fft, hop):
    """Phase vocoder of a whole signal, one frame after the other."""
    n, half = len(x), n_fft // 2
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n_fft) / n_fft)
    padded = np.concatenate([np.zeros(half), x, np.zeros(n_fft + hop)])
    spectra = [np.fft.rfft(window * padded[f * hop : f * hop + n_fft]) for f in range(n // hop + 1)]
    spectra.append(np.zeros(half + 1, dtype=complex))
    bins = 2 * np.pi * hop * np.arange(half + 1) / n_fft
    phase, size = np.angle(spectra[0]), round(n / rate)
    total, weight = np.zeros(size + 4 * n_fft), np.zeros(size + 4 * n_fft)
    t = 0
    while t * rate < len(spectra) - 1:
        low = int(np.floor(t * rate))
        share = t * rate - low
        magnitude = (1 - share) * np.abs(spectra[low]) + share * np.abs(spectra[low + 1])
        frame = np.fft.irfft(magnitude * np.exp(1j * phase), n=n_fft) * window
        for j in range(n_fft):
            if 0 <= t * hop - half + j < size:
                total[t * hop - half + j] += frame[j]
                weight[t * hop - half + j] += window[j] ** 2
        turn = np.angle(spectra[low + 1]) - np.angle(spectra[low]) - bins
        phase = phase + bins + turn - 2 * np.pi * np.round(turn / (2 * np.pi))
        t += 1
    return np.where(weight > 1e-8, total / np.maximum(weight, 1e-8), total)[:size]


@pytest.mark.parametrize("rate", [0.8, 1.3])
def test_stretch_frame_by_frame(spark, rate):
    """The blocks' phases, summed along the recording, give the samples of a plain vocoder."""
    rng = np.random.default_rng(3)
    signals = {"long": rng.normal(size=1500), "short": rng.normal(size=9), "tone": tone(50, 1.0, 700)}
    out = V.time_stretch(make_signals(spark, signals, sr=700, chunk=400, halo=400), rate, 16, 4)
    for name, x in signals.items():
        assert np.allclose(assemble(out, name), _slow_vocoder(x, rate, 16, 4), atol=1e-6), name


def test_shift_frame_by_frame(spark):
    x = np.random.default_rng(4).normal(size=900)
    out = assemble(V.pitch_shift(make_signals(spark, {"a": x}, sr=700, chunk=400, halo=400), 2.0, 16, 4), "a")
    rate = 2.0 ** (-2.0 / 12)
    slow = _slow_vocoder(x, rate, 16, 4)
    assert np.allclose(out, np.interp(np.arange(len(x)) / rate, np.arange(len(slow)), slow), atol=1e-6)


@pytest.mark.parametrize("semitones", [-2.0, 1.0])
def test_pitch_shift_keeps_length(spark, semitones):
    x = tone(1000, 6.0)
    out = assemble(V.pitch_shift(make_signals(spark, {"a": x}, chunk=40000, halo=40000), semitones), "a")
    assert len(out) == len(x)
    assert abs(peak_hz(out) - 1000 * 2 ** (semitones / 12)) < 3
    assert V.hz_to_semitones(-150) == -1.5


def _butter_reference(x, sr, low, high, order=5):
    """Direct recursion of the same filter through its poles, for comparison."""
    nyq = sr / 2
    w1, w2 = np.tan(np.pi * max(low / nyq, 0.001) / 2), np.tan(np.pi * min(high / nyq, 0.999) / 2)
    proto = np.exp(1j * np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order))
    half = proto * (w2 - w1) / 2
    root = np.sqrt(half**2 - w1 * w2 + 0j)
    poles = np.concatenate([half + root, half - root])
    z = (1 + poles) / (1 - poles)
    y = np.asarray(x, dtype=complex)
    # Each stage is (z - 1) or (z + 1) over (z - pole).
    for pole, zero in zip(z, [1] * order + [-1] * order):
        out = np.zeros_like(y)
        prev_in = prev_out = 0
        for i, v in enumerate(y):
            prev_out = v - zero * prev_in + pole * prev_out
            prev_in = v
            out[i] = prev_out
        y = out
    centre = np.exp(1j * 2 * np.arctan(np.sqrt(w1 * w2)))
    gain = np.abs(np.prod((centre - 1) ** order * (centre + 1) ** order) / np.prod(centre - z))
    return y.real / gain


def test_bandpass_matches_recursion(spark):
    x = np.random.default_rng(1).normal(size=6000)
    signals = make_signals(spark, {"a": x}, sr=SR, chunk=6000)
    out = assemble(X.bandpass(signals, 300, 3000, block=1024), "a")
    assert np.max(np.abs(out - _butter_reference(x, SR, 300, 3000))) < 1e-6


def test_bandpass_default_cut_and_inverted_bounds(spark):
    x = np.random.default_rng(1).normal(size=6000)
    signals = make_signals(spark, {"a": x}, sr=44100, chunk=6000)
    assert np.max(np.abs(assemble(X.bandpass(signals), "a") - _butter_reference(x, 44100, 50, 16000))) < 1e-4
    assert np.allclose(assemble(X.bandpass(signals, 5000, 100), "a"), x)
    assert X.bandpass(signals, None, 100) is signals


def test_bandpass_longer_than_its_response(spark):
    x = np.random.default_rng(5).normal(size=60000)
    signals = make_signals(spark, {"a": x}, sr=44100, chunk=60000)
    out = assemble(X.bandpass(signals), "a")
    assert np.max(np.abs(out - _butter_reference(x, 44100, 50, 16000))) < 1e-6


def test_bandpass_across_chunks(spark):
    x = np.random.default_rng(2).normal(size=30000)
    whole = assemble(X.bandpass(make_signals(spark, {"a": x}, chunk=30000), 300, 3000, block=2048), "a")
    parts = assemble(X.bandpass(make_signals(spark, {"a": x}, chunk=7000, halo=12000), 300, 3000, block=2048), "a")
    assert np.allclose(whole, parts)


def test_noise_reduction_lowers_noise_floor(spark):
    rng = np.random.default_rng(3)
    clean = np.where((np.arange(SR * 6) // 8000) % 4 == 0, tone(1000, 6.0), 0)
    x = clean + 0.02 * rng.normal(size=SR * 6)
    signals = make_signals(spark, {"a": x, "tiny": np.ones(100)}, chunk=40000, halo=40000)
    out = X.reduce_noise(signals)
    y = assemble(out, "a")
    assert len(y) == len(x)
    quiet = slice(10000, 28000)
    assert np.std(y[quiet]) < 0.6 * np.std(x[quiet])
    assert abs(np.std(y[2000:6000]) / np.std(clean[2000:6000]) - 1) < 0.1
    # Shorter than a frame: padded to one, in which every bin is at its own level.
    assert np.array_equal(assemble(out, "tiny"), np.zeros(100))


def test_separation_loss_falls_and_sources_sum_to_mixture(spark):
    n = SR * 3
    t = np.arange(n)
    a = np.where(t // 6000 % 2 == 0, tone(500, 3.0), 0)
    b = np.where(t // 9000 % 2 == 0, tone(3000, 3.0), 0)
    signals = make_signals(spark, {"mix": a + b}, chunk=n)
    _, history, losses = X.fit_dictionary(signals, 2, iters=12, n_fft=512, hop=128)
    assert all(y <= x * (1 + 1e-9) for x, y in zip(losses, losses[1:]))
    parts = X.separate(signals, history, n_fft=512, hop=128)
    low, high = assemble(parts, "mix_source_0"), assemble(parts, "mix_source_1")
    assert abs(peak_hz(low) - 500) < 40 and abs(peak_hz(high) - 3000) < 40
    error = np.std(low + high - a - b) / np.std(a + b)
    assert error < 0.2


def test_plan_counts(spark):
    files = spark.createDataFrame([("c", f"r{i}", f"f{i}.wav") for i in range(10)], "class_name string, recording_id string, file_name string")
    plan = A.augmentation_plan(files)
    rows = plan.collect()
    assert len(rows) == 50
    assert {(r.kind, r.param) for r in rows} == {("pitch", -2.0), ("pitch", -1.0), ("pitch", 1.0), ("pitch", 2.0), ("stretch", 0.8)}
    assert {r.out_name for r in rows if r.recording_id == "r3"} == {
        "f3_ps-2.0.wav", "f3_ps-1.0.wav", "f3_ps+1.0.wav", "f3_ps+2.0.wav", "f3_ts0.8.wav"
    }
    small = A.augmentation_plan(files, AugmentConfig(target_samples_per_class=17))
    assert small.count() == 7 and A.augmentation_counts(small).first().created == 7
    assert A.augmentation_plan(files, AugmentConfig(target_samples_per_class=10)).count() == 0
    wide = A.augmentation_plan(files, AugmentConfig(max_augments_per_file=15))
    assert {r.kind for r in wide.select("kind").distinct().collect()} == {"pitch", "stretch", "noise", "volume"}


def test_apply_plan_makes_every_kind(spark):
    x = tone(1000, 3.0)
    signals = make_signals(spark, {"r0": x}, chunk=len(x))
    files = spark.createDataFrame([("c", "r0", "f0.wav")], "class_name string, recording_id string, file_name string")
    plan = A.augmentation_plan(files, AugmentConfig(max_augments_per_file=15))
    out = A.apply_plan(signals, plan)
    names = {r.recording_id for r in out.select("recording_id").distinct().collect()}
    assert names == {r.out_name for r in plan.collect()} and len(names) == 15
    assert len(assemble(out, "f0_ts0.8.wav")) == round(len(x) / 0.8)
    assert abs(peak_hz(assemble(out, "f0_ps+2.0.wav")) - 1000 * 2 ** (2 / 12)) < 3
    assert np.allclose(assemble(out, "f0_vol-6dB.wav"), x * 10 ** (-6 / 20))


def test_spectrum_mask(spark):
    rows = spark.createDataFrame(
        [("a", 0, i, 8, [1.0] * 20) for i in range(8)], "recording_id string, channel int, frame_idx int, n_frames int, power array<double>"
    )
    masked = A.mask_spectrum(rows, freq_width=5, time_width=2).collect()
    dark = [r.frame_idx for r in masked if sum(r.power) == 0]
    assert len(dark) == 2 and dark[1] == dark[0] + 1
    holes = {tuple(i for i, v in enumerate(r.power) if v == 0) for r in masked if sum(r.power)}
    assert len(holes) == 1 and len(next(iter(holes))) == 5
