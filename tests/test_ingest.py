"""Files of 30 s through ``decode`` with its defaults feed every operator."""

import numpy as np
import pytest
from helpers import assemble, make_signals
from test_sources import write_wav
from wavelark.operators import bands as B
from wavelark.operators import doppler as V
from wavelark.operators import features as T
from wavelark.operators import filters as X
from wavelark.operators import quality as Q
from wavelark.operators import vocoder
from wavelark.sources import recordings as W

SR = 22050


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    """The same half minute as decoded chunks and as one chunk."""
    root = tmp_path_factory.mktemp("long")
    t = np.arange(30 * SR) / SR
    rng = np.random.default_rng(0)
    x = 0.4 * np.sin(2 * np.pi * (300 + 20 * t) * t) + 0.05 * rng.normal(size=len(t))
    write_wav(root / "siren" / "a.wav", x, sr=SR)
    chunks = W.valid_signals(W.decode(W.scan_recordings(spark, str(root), content=True))).cache()
    name = chunks.first().recording_id
    samples = assemble(chunks, name)
    assert chunks.count() > 1 and len(samples) == len(t)
    return name, chunks, make_signals(spark, {name: samples}, sr=SR, chunk=len(samples), class_name="siren")


TRANSFORMS = {
    "bandpass": lambda s: X.bandpass(s, 100.0, 8000.0),
    "reduce_noise": X.reduce_noise,
    "time_stretch": lambda s: vocoder.time_stretch(s, 0.8),
    "pitch_shift": lambda s: vocoder.pitch_shift(s, 2.0),
    "separate": lambda s: X.separate(s, [np.random.default_rng(1).uniform(0.1, 1, (1025, 2))]),
}


@pytest.mark.parametrize("name", TRANSFORMS)
def test_transforms(both, name):
    recording, chunks, whole = both
    out = recording + "_source_0" if name == "separate" else recording
    a, b = (assemble(TRANSFORMS[name](s), out) for s in (chunks, whole))
    assert len(a) == len(b) and np.allclose(a, b, atol=1e-6)


def test_features(both):
    _, chunks, whole = both
    a, b = (T.feature_vectors(s).first() for s in (chunks, whole))
    assert a.reason is None and np.allclose(a.features, b.features, rtol=1e-6, atol=1e-6)


def test_profiles(both):
    _, chunks, whole = both
    for run in (B.band_energy, lambda s: V.doppler_summary(V.full_doppler(s)), Q.quality_gate):
        a, b = (run(s).drop("class_name").first() for s in (chunks, whole))
        assert str(a)[:60] == str(b)[:60]


def test_short_recordings_keep_a_row(spark):
    rows = T.feature_vectors(make_signals(spark, {"a": np.ones(63), "b": np.ones(64)})).collect()
    assert {r.recording_id: (r.features is None, r.reason) for r in rows} == {"a": (True, "too short"), "b": (False, None)}
