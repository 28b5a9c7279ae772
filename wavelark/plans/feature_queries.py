"""Frame descriptors, their statistics, and augmentation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from wavelark.model import AugmentConfig, FeatureConfig
from wavelark.operators import augment as G
from wavelark.operators import features as T
from wavelark.operators import filters as X
from wavelark.operators import vocoder as V
from wavelark.operators.framing import own_samples
from wavelark.plans.registry import query, rounded
from wavelark.plans.signal_queries import SIG
from wavelark.sources import adapters as A

N_FFT, HOP, SR = 32, 16, 16384

# Centred frames, periodic Hann, 17 bins of 512 Hz.
FRAMES = f"""{SIG}, fr AS (SELECT recording_id, f, i - (16 * f - 16) AS j, x FROM smp, range(5) t(f)
  WHERE i >= 16 * f - 16 AND i < 16 * f + 16),
mag AS (SELECT recording_id, f, k, sqrt(pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 32)) * cos(2 * pi() * k * j / 32)), 2)
  + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * j / 32)) * sin(2 * pi() * k * j / 32)), 2)) AS m
  FROM fr, range(17) t(k) GROUP BY ALL),
cen AS (SELECT recording_id, f, sum(k * 512.0 * m) / sum(m) AS centroid, exp(avg(ln(greatest(m * m, 1e-10)))) / avg(greatest(m * m, 1e-10)) AS flatness
  FROM mag GROUP BY ALL),
bw AS (SELECT recording_id, f, sqrt(sum(m * pow(k * 512.0 - centroid, 2)) / sum(m)) AS bandwidth FROM mag JOIN cen USING (recording_id, f) GROUP BY ALL),
cum AS (SELECT recording_id, f, k, sum(m) OVER (PARTITION BY recording_id, f ORDER BY k) AS c,
  sum(m) OVER (PARTITION BY recording_id, f) AS total FROM mag),
roll AS (SELECT recording_id, f, min(k) FILTER (WHERE c >= 0.85 * total) * 512.0::DOUBLE AS rolloff FROM cum GROUP BY ALL),
flx AS (SELECT a.recording_id, a.f, sqrt(sum(pow(a.m - b.m, 2))) AS flux FROM mag a
  JOIN mag b ON b.recording_id = a.recording_id AND b.f = a.f - 1 AND b.k = a.k GROUP BY ALL)"""


def _off(**on):
    base = {n: False for n in FeatureConfig.__dataclass_fields__ if n not in ("n_mfcc", "stats")}
    return FeatureConfig.from_dict(base | on)


SHAPE = _off(spectral_centroid=True, spectral_bandwidth=True, spectral_rolloff=True, spectral_flatness=True)
FLUX = _off(spectral_flux=True)


def _signals(spark, folder):
    return A.signals_from_embeddings(spark, folder, SR)


@query(
    "spectral_shape",
    f"""WITH {FRAMES} SELECT recording_id, f AS frame_idx, round(centroid, 4) AS centroid, round(bandwidth, 4) AS bandwidth,
  round(rolloff, 4) AS rolloff, round(flatness, 6) AS flatness FROM cen JOIN bw USING (recording_id, f) JOIN roll USING (recording_id, f)""",
)
def shape(spark, folder):
    rows = T.frame_features(_signals(spark, folder), SHAPE, N_FFT, HOP)
    names = ("centroid", "bandwidth", "rolloff", "flatness")
    digits = (4, 4, 4, 6)
    return rows.select(
        "recording_id", "frame_idx", *[F.round(F.col("values")[i], d).alias(n) for i, (n, d) in enumerate(zip(names, digits))]
    )


@query(
    "spectral_flux",
    f"WITH {FRAMES} SELECT recording_id, f AS frame_idx, round(flux, 6) AS flux FROM flx",
)
def flux(spark, folder):
    rows = T.frame_features(_signals(spark, folder), FLUX, N_FFT, HOP)
    return rows.filter(F.col("values")[0].isNotNull()).select(
        "recording_id", "frame_idx", F.round(F.col("values")[0], 6).alias("flux")
    )


@query(
    "frame_statistics",
    f"""WITH {FRAMES}, v AS (SELECT recording_id, 0 AS pos, centroid AS x FROM cen UNION ALL SELECT recording_id, 1, bandwidth FROM bw
    UNION ALL SELECT recording_id, 2, rolloff FROM roll UNION ALL SELECT recording_id, 3, flatness FROM cen),
  m AS (SELECT *, avg(x) OVER (PARTITION BY recording_id, pos) AS mu FROM v),
  c AS (SELECT recording_id, pos, any_value(mu) AS mean, sqrt(avg(pow(x - mu, 2))) AS std, avg(pow(x - mu, 3)) AS m3,
    avg(pow(x - mu, 4)) AS m4, median(x) AS median FROM m GROUP BY ALL)
  SELECT recording_id, pos::INTEGER AS pos, round(mean, 4) AS mean, round(std, 4) AS std,
    CASE WHEN std > 1e-9 THEN round(m3 / pow(std, 3), 6) + 0.0 END AS skew,
    CASE WHEN std > 1e-9 THEN round(m4 / pow(std, 4) - 3, 6) + 0.0 END AS kurtosis, round(median, 4) AS median FROM c""",
)
def statistics(spark, folder):
    rows = T.frame_features(_signals(spark, folder), SHAPE, N_FFT, HOP)
    stats = T.coefficient_stats(rows, ["mean", "std", "skew", "kurtosis", "median"])
    spread = F.col("std") > 1e-9
    return stats.select(
        "recording_id", "pos", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"),
        F.when(spread, rounded("skew", 6)).alias("skew"), F.when(spread, rounded("kurtosis", 6)).alias("kurtosis"),
        F.round("median", 4).alias("median"),
    )


@query(
    "spectral_feature_vector",
    f"""WITH {FRAMES} SELECT recording_id, 8 AS length, round(avg(centroid), 4) AS mean_centroid, round(stddev_pop(centroid), 4) AS std_centroid,
  round(avg(bandwidth), 4) AS mean_bandwidth, round(stddev_pop(bandwidth), 4) AS std_bandwidth
  FROM cen JOIN bw USING (recording_id, f) GROUP BY recording_id""",
)
def short_vector(spark, folder):
    rows = T.feature_vectors(_signals(spark, folder), SHAPE, N_FFT, HOP)
    names = ("mean_centroid", "std_centroid", "mean_bandwidth", "std_bandwidth")
    return rows.select(
        "recording_id", F.size("features").alias("length"),
        *[F.round(F.col("features")[i], 4).alias(n) for i, n in enumerate(names)],
    )


@query(
    "feature_vector_length",
    "SELECT vec_id::VARCHAR AS recording_id, 'class_' || label AS class_name, 558 AS length FROM embeddings",
)
def full_vector(spark, folder):
    rows = T.feature_vectors(_signals(spark, folder), FeatureConfig(), N_FFT, HOP)
    return rows.select("recording_id", "class_name", F.size("features").alias("length"))


@query("feature_vectors")
def vectors(spark, folder):
    rows = T.feature_vectors(_signals(spark, folder), FeatureConfig(), N_FFT, HOP)
    return rows.select("recording_id", "class_name", F.posexplode("features").alias("pos", "value"))


# Slaney's mel scale: 130 edges up to half the rate, triangles of equal area over 17 bins of 512 Hz.
MEL = f"""{FRAMES}, ed AS (SELECT e, CASE WHEN mel < 15 THEN mel * 200 / 3 ELSE 1000 * exp(ln(6.4) / 27 * (mel - 15)) END AS hz
  FROM (SELECT e, e * (15 + ln(8192 / 1000.0) / (ln(6.4) / 27)) / 129 AS mel FROM range(130) t(e))),
fil AS (SELECT a.e AS mel, k, greatest(0, least((k * 512 - a.hz) / (b.hz - a.hz), (c.hz - k * 512) / (c.hz - b.hz))) * 2 / (c.hz - a.hz) AS w
  FROM ed a JOIN ed b ON b.e = a.e + 1 JOIN ed c ON c.e = a.e + 2, range(17) t(k)),
mp AS (SELECT recording_id, f, mel, sum(w * m * m) AS p FROM mag JOIN fil USING (k) GROUP BY ALL),
db AS (SELECT *, 10 * log10(greatest(p, 1e-10)) AS own, 10 * log10(greatest(max(p) OVER (PARTITION BY recording_id), 1e-10)) AS peak FROM mp)"""


@query(
    "mel_spectrogram_db",
    f"""WITH {MEL} SELECT recording_id, f AS frame_idx, mel::INTEGER AS mel, round(greatest(own - peak, -80), 4) + 0.0 AS level_db FROM db""",
)
def mel_rows(spark, folder):
    rows = T.mel_db(_signals(spark, folder), N_FFT, HOP)
    return rows.select("recording_id", "frame_idx", F.posexplode("mel_db").alias("mel", "level_db")).withColumn(
        "level_db", rounded("level_db", 4)
    )


@query(
    "mfcc_and_mel_vector",
    f"""WITH {MEL}, mf AS (SELECT recording_id, f, q, sum(greatest(own, peak - 80) * cos(pi() * q * (2 * mel + 1) / 256.0))
    * sqrt(2 / 128.0) * CASE WHEN q = 0 THEN sqrt(0.5) ELSE 1 END AS x FROM db, range(40) t(q) GROUP BY recording_id, f, q),
  v AS (SELECT recording_id, q AS place, 40 AS width, x FROM mf UNION ALL SELECT recording_id, 80 + mel, 128, p FROM mp),
  st AS (SELECT recording_id, place, width, avg(x) AS mean, stddev_pop(x) AS std FROM v GROUP BY ALL)
  SELECT recording_id, place::INTEGER AS pos, round(mean, 4) + 0.0 AS value FROM st
  UNION ALL SELECT recording_id, (place + width)::INTEGER, round(std, 4) + 0.0 FROM st""",
)
def mfcc_mel(spark, folder):
    """Mean and deviation of 40 cepstral and 128 mel coefficients."""
    rows = T.feature_vectors(_signals(spark, folder), _off(mfcc=True, mel=True), N_FFT, HOP)
    return rows.select("recording_id", F.posexplode("features").alias("pos", "value")).withColumn("value", rounded("value", 4))


PLAN_SQL = """n AS (SELECT doc_id, lang || '_' || source AS class_name, 'rec_' || (doc_id % 500) || '.wav' AS file_name,
    'rec_' || (doc_id % 500) AS base, row_number() OVER (PARTITION BY lang || '_' || source
      ORDER BY 'rec_' || (doc_id % 500) || '.wav', doc_id::VARCHAR) - 1 AS place,
    count(*) OVER (PARTITION BY lang || '_' || source) AS existing FROM documents),
v AS (SELECT * FROM (VALUES (0, 'pitch', -2.0, '_ps-2.0'), (1, 'pitch', -1.0, '_ps-1.0'), (2, 'pitch', 1.0, '_ps+1.0'),
  (3, 'pitch', 2.0, '_ps+2.0'), (4, 'stretch', 0.8, '_ts0.8')) t(variant_idx, kind, param, suffix)),
plan AS (SELECT class_name, doc_id::VARCHAR AS recording_id, file_name, kind, param::DOUBLE AS param,
    place * 5 + variant_idx AS created_idx, base || suffix || '.wav' AS out_name FROM n, v
  WHERE place * 5 + variant_idx < 120 - existing)"""
PLAN = AugmentConfig(target_samples_per_class=120)


def _files(spark, folder):
    return A.recordings_from_documents(spark, folder).withColumn("class_name", F.concat_ws("_", "class_name", "source"))


@query(
    "augmentation_plan",
    f"WITH {PLAN_SQL} SELECT class_name, recording_id, kind, param, created_idx, out_name FROM plan",
)
def plan(spark, folder):
    rows = G.augmentation_plan(_files(spark, folder), PLAN)
    return rows.select("class_name", "recording_id", "kind", "param", "created_idx", "out_name")


@query("augmentation_counts", f"WITH {PLAN_SQL} SELECT class_name, count(*) AS created FROM plan GROUP BY 1")
def plan_counts(spark, folder):
    return G.augmentation_counts(G.augmentation_plan(_files(spark, folder), PLAN))


@query(
    "originals_and_variants",
    f"""WITH {PLAN_SQL} SELECT class_name, file_name AS out_name, 'original' AS kind FROM n
  UNION ALL SELECT class_name, out_name, kind FROM plan""",
)
def everything(spark, folder):
    files = _files(spark, folder)
    return G.with_originals(files, G.augmentation_plan(files, PLAN))


@query(
    "parameter_grid",
    """SELECT doc_id::VARCHAR AS recording_id, p AS param, 'rec_' || (doc_id % 500) || printf('_noise%.0fdB', p) || '.wav' AS out_name
  FROM documents, (VALUES (20.0::DOUBLE), (15.0::DOUBLE), (10.0::DOUBLE)) t(p)""",
)
def grid(spark, folder):
    rows = G.parameter_grid(A.recordings_from_documents(spark, folder), "noise", [20.0, 15.0, 10.0])
    return rows.select("recording_id", "param", "out_name")


@query(
    "volume_scaled",
    """SELECT vec_id::VARCHAR AS recording_id, i AS idx, round(embedding[i + 1]::DOUBLE * pow(10, -6 / 20.0::DOUBLE), 7) + 0.0 AS value
  FROM embeddings, range(64) t(i)""",
)
def volume(spark, folder):
    rows = own_samples(G.scale_volume(_signals(spark, folder), -6.0))
    return rows.select("recording_id", "idx", rounded("value", 7).alias("value"))


EV_REV = """SELECT user_id::VARCHAR AS recording_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) - 1 AS idx, value FROM events"""


@query("reversed_signal", EV_REV)
def reversed_rows(spark, folder):
    signals = A.signals_from_events(spark, folder, 16, 16)
    return own_samples(G.reverse_signal(signals)).select("recording_id", "idx", "value")


NEAR = "SELECT vec_id::VARCHAR AS recording_id, true AS near FROM embeddings"


@query("noise_injected", NEAR)
def noisy(spark, folder):
    """The measured ratio of 64 samples is within 4 dB, five deviations, of the wanted one."""
    clean = own_samples(_signals(spark, folder)).select("recording_id", "idx", F.col("value").alias("clean"))
    noisy = own_samples(G.add_noise(_signals(spark, folder), 20.0)).select("recording_id", "idx", "value")
    added = F.col("value") - F.col("clean")
    ratio = 10 * F.log10(F.sum(F.col("clean") * F.col("clean")) / F.sum(added * added))
    rows = clean.join(noisy, ["recording_id", "idx"]).groupBy("recording_id").agg(ratio.alias("ratio"))
    return rows.select("recording_id", (F.abs(F.col("ratio") - 20) < 4).alias("near"))


def _lengths(signals):
    return signals.groupBy("recording_id").agg(F.sum("own").alias("n_samples"))


EV_LEN = "SELECT user_id::VARCHAR AS recording_id, {} AS n_samples FROM events GROUP BY user_id"


@query("time_stretched_length", EV_LEN.format("round(count(*) / 0.8::DOUBLE)::BIGINT"))
def stretched(spark, folder):
    return _lengths(V.time_stretch(A.signals_from_events(spark, folder, 4096, 2048), 0.8, 16, 4))


@query("pitch_shifted_length", EV_LEN.format("count(*)"))
def shifted(spark, folder):
    return _lengths(V.pitch_shift(A.signals_from_events(spark, folder, 4096, 2048), 2.0, 16, 4))


@query("noise_reduced_length", EV_LEN.format("count(*)"))
def denoised(spark, folder):
    return _lengths(X.reduce_noise(A.signals_from_events(spark, folder, 4096, 2048), n_fft=16, hop=4))


EV_SAME = """SELECT user_id::VARCHAR AS recording_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx,
  round(value, 5) + 0.0 AS value FROM events"""


def _values(signals, digits=5):
    return own_samples(signals).select("recording_id", "idx", rounded("value", digits).alias("value"))


@query("time_stretch_unit_rate", EV_SAME)
def unit_stretch(spark, folder):
    """At rate 1 the vocoder's phases are those of the input, so it gives the input back."""
    return _values(V.time_stretch(A.signals_from_events(spark, folder, 4096, 2048), 1.0, 16, 4))


@query("pitch_shift_zero", EV_SAME)
def zero_shift(spark, folder):
    return _values(V.pitch_shift(A.signals_from_events(spark, folder, 4096, 2048), 0.0, 16, 4))


@query("noise_gate_open", EV_SAME)
def open_gate(spark, folder):
    """A gate that takes nothing away gives the input back."""
    signals = A.signals_from_events(spark, folder, 4096, 2048)
    return _values(X.reduce_noise(signals, prop_decrease=0.0, n_fft=16, hop=4))


# Centred frames of 16 with hop 4, periodic Hann, nine bins; direct Fourier sums both ways.
EV_GATE = """WITH s AS (SELECT user_id::VARCHAR AS r, value AS x, count(*) OVER (PARTITION BY user_id) AS n,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
fr AS (SELECT r, i, x, (i + 8) // 4 - d AS f, i - 4 * ((i + 8) // 4 - d) + 8 AS j FROM s, range(4) t(d)
  WHERE (i + 8) // 4 - d BETWEEN 0 AND n // 4),
win AS (SELECT *, 0.5 - 0.5 * cos(2 * pi() * j / 16) AS w FROM fr),
sp AS (SELECT r, f, k, sum(x * w * cos(2 * pi() * k * j / 16)) AS re, -sum(x * w * sin(2 * pi() * k * j / 16)) AS im
  FROM win, range(9) t(k) GROUP BY ALL),
db AS (SELECT *, 20 * log10(sqrt(re * re + im * im) + 1e-10) AS level FROM sp),
lim AS (SELECT r, k, avg(level) + 1.5 * sqrt(greatest(avg(level * level) - avg(level) * avg(level), 0)) AS usual FROM db GROUP BY ALL),
loud AS (SELECT r, f, k, CASE WHEN level > usual THEN re ELSE 0 END AS re, CASE WHEN level > usual THEN im ELSE 0 END AS im
  FROM db JOIN lim USING (r, k)),
back AS (SELECT r, i, f, any_value(w) AS w, sum(CASE WHEN k IN (0, 8) THEN re * cos(2 * pi() * k * j / 16)
  ELSE 2 * (re * cos(2 * pi() * k * j / 16) - im * sin(2 * pi() * k * j / 16)) END) / 16 AS y
  FROM win JOIN loud USING (r, f) GROUP BY r, i, f)
SELECT r AS recording_id, i AS idx, round(CASE WHEN sum(w * w) > 1e-8 THEN sum(y * w) / sum(w * w) ELSE sum(y * w) END, 5) + 0.0 AS value
FROM back GROUP BY r, i"""


@query("noise_gate_closed", EV_GATE)
def closed_gate(spark, folder):
    """The gate at its defaults: bins not above their usual level are taken away."""
    return _values(X.reduce_noise(A.signals_from_events(spark, folder, 4096, 2048), n_fft=16, hop=4))


@query("time_stretched")
def stretched_values(spark, folder):
    """Samples at rate 0.8; tests/test_transforms.py follows the vocoder frame by frame."""
    return _values(V.time_stretch(A.signals_from_events(spark, folder, 4096, 2048), 0.8, 16, 4))


@query("pitch_shifted")
def shifted_values(spark, folder):
    """Samples two semitones up; tested as ``time_stretched``."""
    return _values(V.pitch_shift(A.signals_from_events(spark, folder, 4096, 2048), 2.0, 16, 4))


def _recursion(sr: float, low: float, high: float, order: int, n: int) -> list[float]:
    """Impulse response of a Butterworth band-pass by its difference equation."""
    w1, w2 = (np.tan(np.pi * f / sr) for f in (low, high))
    width, centre = w2 - w1, w1 * w2
    b, a = np.array([width**order], dtype=complex), np.array([1.0 + 0j])
    for k in range(order):
        pole = np.exp(1j * np.pi * (2 * k + order + 1) / (2 * order))
        b = np.convolve(b, [1, 0, -1])
        a = np.convolve(a, [1 - pole * width + centre, 2 * centre - 2, 1 + pole * width + centre])
    b, a = (b / a[0]).real, (a / a[0]).real
    out: list[float] = []
    for i in range(n):
        x = b[i] if i < len(b) else 0.0
        out.append(float(x - sum(a[j] * out[i - j] for j in range(1, min(i, len(a) - 1) + 1))))
    return out


TAPS = ", ".join(f"{x!r}::DOUBLE" for x in _recursion(SR, 500, 4000, 5, 64))


@query(
    "bandpassed_signal",
    f"""WITH {SIG}, h AS (SELECT unnest([{TAPS}]) AS w, unnest(range(64)) AS j)
  SELECT recording_id, (i + j)::BIGINT AS idx, round(sum(x * w), 6) + 0.0 AS value FROM smp, h WHERE i + j < 64 GROUP BY ALL""",
)
def filtered(spark, folder):
    return _values(X.bandpass(_signals(spark, folder), 500, 4000, block=1024), 6)


@query(
    "separated_sources",
    EV_SAME.replace("round(value, 5) + 0.0 AS value", "true AS parts_make_model"),
)
def sources(spark, folder):
    """The sources add up to the modelled mixture: what one component alone gives, summed."""
    signals = A.signals_from_events(spark, folder, 4096, 2048)
    w, history, losses = X.fit_dictionary(signals, 2, n_fft=16, hop=4)
    assert all(b <= a * (1 + 1e-9) for a, b in zip(losses, losses[1:]))
    parts = own_samples(X.separate(signals, history, 16, 4)).select(
        F.regexp_extract("recording_id", "^(.*)_source_", 1).alias("recording_id"), "idx", "value"
    )
    summed = parts.groupBy("recording_id", "idx").agg(F.sum("value").alias("value"))
    whole = own_samples(X.separate(signals, history, 16, 4, together=True)).select("recording_id", "idx", F.col("value").alias("model"))
    return summed.join(whole, ["recording_id", "idx"]).select(
        "recording_id", "idx", (F.abs(F.col("value") - F.col("model")) < 1e-6).alias("parts_make_model")
    )


@query(
    "masked_spectrum",
    """SELECT vec_id::VARCHAR AS recording_id, 5 AS hidden, true AS in_one_run, true AS rest_unchanged FROM embeddings""",
)
def masked(spark, folder):
    """Five neighbouring bins are silent and the others are as before."""
    from wavelark.functions.spectral import power_spectrum

    spectra = _signals(spark, folder).withColumn("power", power_spectrum("samples", 64)).withColumn("before", F.col("power"))
    rows = G.mask_spectrum(spectra, freq_width=5)
    silent = F.filter(F.transform("power", lambda p, i: F.when(p == 0.0, i)), lambda i: i.isNotNull())
    same = F.forall(F.zip_with("power", "before", lambda a, b: (a == 0.0) | (a == b)), lambda x: x)
    return rows.select(
        "recording_id", F.size(silent).alias("hidden"),
        (F.array_max(silent) - F.array_min(silent) == F.size(silent) - 1).alias("in_one_run"), same.alias("rest_unchanged"),
    )
