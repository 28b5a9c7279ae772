"""Spectra, bands, Doppler, direction of arrival, quality and simple transforms."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelark.functions.spectral import power_spectrum
from wavelark.model import BANDS
from wavelark.operators import bands as B
from wavelark.operators import direction as D
from wavelark.operators import doppler as V
from wavelark.operators.framing import frames
from wavelark.plans.registry import query, rounded
from wavelark.sources import adapters as A

SR = 16384
N_FFT = 64
FRAME_S, HOP_S = 16 / SR, 8 / SR

# Shared SQL: samples, spectra by direct Fourier sums, bands.
SIG = """sig AS (SELECT vec_id::VARCHAR AS recording_id, 'class_' || label AS class_name, embedding AS e
  FROM embeddings),
smp AS (SELECT recording_id, class_name, i, e[i + 1]::DOUBLE AS x FROM sig, range(64) t(i))"""
SPEC = (
    SIG
    + """,
spec AS (SELECT recording_id, k,
    pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 63)) * cos(2 * pi() * k * i / 64)), 2)
  + pow(sum(x * (0.5 - 0.5 * cos(2 * pi() * i / 63)) * sin(2 * pi() * k * i / 64)), 2) AS p
  FROM smp, range(33) t(k) GROUP BY ALL)"""
)
BAND_ROWS = ", ".join(
    f"({i}, '{b.name}', {float(b.low_hz)}::DOUBLE, {float(b.high_hz)}::DOUBLE)" for i, b in enumerate(BANDS)
)
BAND_SQL = (
    SPEC
    + f""",
bands AS (SELECT * FROM (VALUES {BAND_ROWS}) v(band_idx, name, low_hz, high_hz)),
raw AS (SELECT s.recording_id, b.band_idx, b.name, b.low_hz, b.high_hz,
    coalesce(sum(s.p) FILTER (WHERE s.k * 256.0 >= b.low_hz AND s.k * 256.0 < b.high_hz), 0) AS e
  FROM spec s, bands b GROUP BY ALL),
energy AS (SELECT *, CASE WHEN sum(e) OVER (PARTITION BY recording_id) > 0
    THEN e / sum(e) OVER (PARTITION BY recording_id) ELSE 0 END AS energy FROM raw)"""
)
SOURCE_ROWS = ", ".join(
    f"({i}, {100 * i + j}, '{s}')" for i, b in enumerate(BANDS) for j, s in enumerate(b.sources)
)
SCORE_SQL = (
    BAND_SQL
    + f""",
src AS (SELECT * FROM (VALUES {SOURCE_ROWS}) v(band_idx, pos, source)),
sums AS (SELECT recording_id, source, sum(energy) AS s, min(pos) AS pos
  FROM energy JOIN src USING (band_idx) GROUP BY ALL),
scored AS (SELECT recording_id, source, pos, s / max(s) OVER (PARTITION BY recording_id) AS score FROM sums),
ranked AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY score DESC, pos) AS rank FROM scored)"""
)
TRACK = """fr AS (SELECT s.recording_id, f, s.i - 8 * f AS j,
    s.x * (0.5 - 0.5 * cos(2 * pi() * (s.i - 8 * f) / 15)) AS y
  FROM smp s, range(7) t(f) WHERE s.i >= 8 * f AND s.i < 8 * f + 16),
fspec AS (SELECT recording_id, f, k,
    sqrt(pow(sum(y * cos(2 * pi() * k * j / 16)), 2) + pow(sum(y * sin(2 * pi() * k * j / 16)), 2)) AS m
  FROM fr, range(1, 9) t(k) GROUP BY ALL),
near AS (SELECT *, lag(m) OVER w AS a, lead(m) OVER w AS c,
    row_number() OVER (PARTITION BY recording_id, f ORDER BY m DESC, k) AS rn
  FROM fspec WINDOW w AS (PARTITION BY recording_id, f ORDER BY k)),
track AS (SELECT recording_id, f AS frame_idx, (f * 16 + 16) / 2.0 / 16384 AS time_s,
    1024.0 * (k + CASE WHEN a IS NULL OR c IS NULL OR a - 2 * m + c = 0 THEN 0
      ELSE 0.5 * (a - c) / (a - 2 * m + c) END) AS freq_hz
  FROM near WHERE rn = 1)"""
DOPPLER = (
    TRACK
    + """,
moved AS (SELECT t.*, t.freq_hz - r.freq_hz AS shift, 343.0 * (t.freq_hz - r.freq_hz) / t.freq_hz AS v
  FROM track t JOIN track r ON r.recording_id = t.recording_id AND r.frame_idx = 0),
dop AS (SELECT *, CASE WHEN abs(shift) < 2 THEN 'stationary' WHEN shift > 0 THEN 'approaching'
    ELSE 'receding' END AS direction, CASE WHEN abs(v) > 0.1 THEN 100.0 / abs(v) END AS travel FROM moved),
votes AS (SELECT recording_id, direction, count(*) AS n, min(frame_idx) AS early FROM dop GROUP BY ALL),
lead_dir AS (SELECT recording_id, direction FROM votes
  QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, early) = 1),
summary AS (SELECT recording_id, avg(v) AS mean_v, max(abs(v)) AS max_v, count(*) AS n_frames,
    avg(travel) AS mean_travel FROM dop GROUP BY ALL)"""
)


def _signals(spark, folder):
    return A.signals_from_embeddings(spark, folder, SR)


def _profiles(spark, folder):
    return B.band_energy(_signals(spark, folder), n_fft=N_FFT)


def _doppler(spark, folder):
    return V.full_doppler(_signals(spark, folder), frame_s=FRAME_S, hop_s=HOP_S, distance_m=100.0)


@query(
    "power_spectrum",
    f"WITH {SPEC} SELECT recording_id, k::INTEGER AS bin, round(p, 6) + 0.0 AS power FROM spec",
)
def spectrum_rows(spark, folder):
    rows = _signals(spark, folder).withColumn("power", power_spectrum("samples", N_FFT))
    return rows.select("recording_id", F.posexplode("power").alias("bin", "power")).select(
        "recording_id", "bin", rounded("power").alias("power")
    )


@query(
    "dominant_frequency",
    f"WITH {SIG}, {TRACK} SELECT recording_id, frame_idx, round(time_s, 9) AS time_s, "
    "round(freq_hz, 4) AS freq_hz FROM track",
)
def dominant(spark, folder):
    track = V.frequency_track(_signals(spark, folder), FRAME_S, HOP_S)
    return track.select(
        "recording_id", "frame_idx", F.round("time_s", 9).alias("time_s"), F.round("freq_hz", 4).alias("freq_hz")
    )


@query(
    "frequency_track_frames",
    f"""WITH {SIG} SELECT recording_id, f AS frame_idx, f * 8 AS start, round(sum(x), 6) + 0.0 AS total
  FROM smp, range(7) t(f) WHERE i >= 8 * f AND i < 8 * f + 16 GROUP BY ALL""",
)
def track_frames(spark, folder):
    cut = frames(_signals(spark, folder), 16, 8, F.lit(7))
    return cut.select("recording_id", "frame_idx", "start", rounded(B.array_sum(F.col("samples"))).alias("total"))


@query(
    "doppler_track",
    f"""WITH {SIG}, {DOPPLER} SELECT recording_id, frame_idx, round(freq_hz, 4) AS freq_hz,
  round(v, 5) + 0.0 AS velocity_m_s, direction, round(travel, 5) AS travel_time_s FROM dop""",
)
def doppler_rows(spark, folder):
    return _doppler(spark, folder).select(
        "recording_id", "frame_idx", F.round("freq_hz", 4).alias("freq_hz"),
        rounded("velocity_m_s", 5).alias("velocity_m_s"), "direction",
        F.round("travel_time_s", 5).alias("travel_time_s"),
    )


@query(
    "doppler_summary",
    f"""WITH {SIG}, {DOPPLER} SELECT recording_id, round(mean_v, 5) + 0.0 AS mean_velocity_m_s,
  round(max_v, 5) AS max_velocity_m_s, direction AS dominant_direction, n_frames,
  64 / 16384.0::DOUBLE AS duration_s, round(mean_travel, 5) AS mean_travel_time_s
  FROM summary JOIN lead_dir USING (recording_id)""",
)
def doppler_totals(spark, folder):
    return V.doppler_summary(_doppler(spark, folder)).select(
        "recording_id", rounded("mean_velocity_m_s", 5).alias("mean_velocity_m_s"),
        F.round("max_velocity_m_s", 5).alias("max_velocity_m_s"), "dominant_direction", "n_frames",
        "duration_s", F.round("mean_travel_time_s", 5).alias("mean_travel_time_s"),
    )


@query(
    "doppler_reference_frequency",
    f"""WITH {SIG}, {TRACK} SELECT recording_id,
  round(CASE WHEN freq_hz > 0 THEN freq_hz ELSE 1000 END, 4) AS reference_hz FROM track WHERE frame_idx = 0""",
)
def doppler_reference(spark, folder):
    rows = _doppler(spark, folder).filter(F.col("frame_idx") == 0)
    return rows.select("recording_id", F.round("reference_hz", 4).alias("reference_hz"))


@query(
    "doppler_known_source",
    f"""WITH {SIG}, {TRACK} SELECT recording_id, frame_idx,
  round(1500.0 * (freq_hz - 3000) / freq_hz, 5) + 0.0 AS velocity_m_s,
  CASE WHEN abs(freq_hz - 3000) < 2 THEN 'stationary' WHEN freq_hz > 3000 THEN 'approaching'
    ELSE 'receding' END AS direction FROM track""",
)
def doppler_known(spark, folder):
    track = V.frequency_track(_signals(spark, folder), FRAME_S, HOP_S)
    rows = V.doppler_track(track, source_frequency=3000.0, speed=1500.0)
    return rows.select("recording_id", "frame_idx", rounded("velocity_m_s", 5).alias("velocity_m_s"), "direction")


@query(
    "chunk_velocity",
    f"""WITH {SIG}, {TRACK}, pairs AS (SELECT recording_id, frame_idx, freq_hz AS f2,
    lag(freq_hz) OVER (PARTITION BY recording_id ORDER BY frame_idx) AS f1 FROM track)
  SELECT recording_id, frame_idx, round(f1, 4) AS f1_hz, round(f2, 4) AS f2_hz,
    round(343.0 * (f2 - f1) / f2, 5) + 0.0 AS velocity_m_s,
    CASE WHEN abs(f2 - f1) < 2 THEN 'stationary' WHEN f2 > f1 THEN 'approaching' ELSE 'receding' END AS direction
  FROM pairs WHERE f1 IS NOT NULL""",
)
def velocity_between_chunks(spark, folder):
    rows = V.chunk_velocity(V.frequency_track(_signals(spark, folder), FRAME_S, HOP_S))
    return rows.select(
        "recording_id", "frame_idx", F.round("f1_hz", 4).alias("f1_hz"), F.round("f2_hz", 4).alias("f2_hz"),
        rounded("velocity_m_s", 5).alias("velocity_m_s"), "direction",
    )


@query(
    "sensor_value_velocity",
    """WITH s AS (SELECT user_id::VARCHAR AS recording_id,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value,
    lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS f1 FROM events)
  SELECT recording_id, idx, round(value - f1, 6) + 0.0 AS delta_f_hz,
    round(343.0 * (value - f1) / value, 5) + 0.0 AS velocity_m_s,
    CASE WHEN abs(value - f1) < 2 THEN 'stationary' WHEN value > f1 THEN 'approaching' ELSE 'receding' END AS direction
  FROM s WHERE f1 IS NOT NULL""",
)
def sensor_velocity(spark, folder):
    samples = A.samples_from_events(spark, folder).withColumnRenamed("value", "freq_hz")
    rows = V.chunk_velocity(samples, order_by="idx")
    return rows.select(
        "recording_id", "idx", rounded("delta_f_hz").alias("delta_f_hz"),
        rounded("velocity_m_s", 5).alias("velocity_m_s"), "direction",
    )


@query(
    "sensor_doppler_summary",
    """WITH s AS (SELECT user_id::VARCHAR AS recording_id, value,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx FROM events),
  d AS (SELECT s.recording_id, s.idx, s.value - r.value AS shift, 343.0 * (s.value - r.value) / s.value AS v
    FROM s JOIN s r ON r.recording_id = s.recording_id AND r.idx = 0),
  c AS (SELECT *, CASE WHEN abs(shift) < 2 THEN 'stationary' WHEN shift > 0 THEN 'approaching'
    ELSE 'receding' END AS direction FROM d),
  votes AS (SELECT recording_id, direction, count(*) AS n, min(idx) AS early FROM c GROUP BY ALL),
  best AS (SELECT * FROM votes QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY n DESC, early) = 1)
  SELECT recording_id, round(avg(v), 4) + 0.0 AS mean_velocity_m_s, round(max(abs(v)), 4) AS max_velocity_m_s,
    any_value(best.direction) AS dominant_direction, count(*) AS n_frames
  FROM c JOIN best USING (recording_id) GROUP BY recording_id""",
)
def sensor_doppler(spark, folder):
    samples = A.samples_from_events(spark, folder)
    track = samples.select(
        "recording_id", "channel", "sr", F.col("idx").alias("frame_idx"), F.col("value").alias("freq_hz"),
        F.lit(1).cast("long").alias("n_total"),
    )
    rows = V.doppler_summary(V.doppler_track(track))
    return rows.select(
        "recording_id", rounded("mean_velocity_m_s", 4).alias("mean_velocity_m_s"),
        F.round("max_velocity_m_s", 4).alias("max_velocity_m_s"), "dominant_direction", "n_frames",
    )


@query(
    "band_energy",
    f"""WITH {BAND_SQL} SELECT recording_id, name, low_hz, high_hz, round(energy, 6) AS energy,
  round(10 * log10(e + 1e-10), 5) + 0.0 AS energy_db FROM energy""",
)
def band_profile(spark, folder):
    return B.band_rows(_profiles(spark, folder)).select(
        "recording_id", "name", "low_hz", "high_hz", F.round("energy", 6).alias("energy"),
        rounded("energy_db", 5).alias("energy_db"),
    )


@query(
    "band_energy_all_frames",
    f"""WITH {SIG}, fr AS (SELECT recording_id, i // 16 AS f, i % 16 AS j,
      x * (0.5 - 0.5 * cos(2 * pi() * (i % 16) / 15)) AS y FROM smp),
  sp AS (SELECT recording_id, f, k, pow(sum(y * cos(2 * pi() * k * j / 16)), 2)
      + pow(sum(y * sin(2 * pi() * k * j / 16)), 2) AS p FROM fr, range(9) t(k) GROUP BY ALL),
  bands AS (SELECT * FROM (VALUES {BAND_ROWS}) v(band_idx, name, low_hz, high_hz)),
  raw AS (SELECT recording_id, name, coalesce(sum(p) FILTER (WHERE k * 1024.0 >= low_hz AND k * 1024.0 < high_hz), 0)
      / count(DISTINCT f) AS e FROM sp, bands GROUP BY ALL)
  SELECT recording_id, name, round(e / sum(e) OVER (PARTITION BY recording_id), 6) AS energy FROM raw""",
)
def band_profile_all_frames(spark, folder):
    rows = B.band_rows(B.band_energy(_signals(spark, folder), n_fft=16))
    return rows.select("recording_id", "name", F.round("energy", 6).alias("energy"))


@query(
    "source_scores",
    f"WITH {SCORE_SQL} SELECT recording_id, source, round(score, 6) AS score FROM scored",
)
def score_rows(spark, folder):
    rows = B.source_scores(_profiles(spark, folder)).select("recording_id", F.explode_outer("scores").alias("s"))
    return rows.select("recording_id", "s.source", F.round("s.score", 6).alias("score"))


@query(
    "top_candidate_sources",
    f"WITH {SCORE_SQL} SELECT recording_id, rank, source, round(score, 6) AS score FROM ranked WHERE rank <= 3",
)
def top_sources(spark, folder):
    rows = B.source_scores(_profiles(spark, folder)).select(
        "recording_id", F.posexplode_outer(F.slice("scores", 1, 3)).alias("pos", "s")
    )
    return rows.select(
        "recording_id", (F.col("pos") + 1).cast("long").alias("rank"), "s.source", F.round("s.score", 6).alias("score")
    )


@query(
    "band_candidate_rows",
    f"WITH {BAND_SQL}, src AS (SELECT * FROM (VALUES {SOURCE_ROWS}) v(band_idx, pos, source)) "
    "SELECT recording_id, name, source, round(energy, 6) AS energy FROM energy JOIN src USING (band_idx)",
)
def band_candidates(spark, folder):
    sources = F.array(*[F.array(*[F.lit(s) for s in b.sources]) for b in BANDS])
    rows = B.band_rows(_profiles(spark, folder))
    return rows.select(
        "recording_id", "name", F.explode_outer(F.get(sources, F.col("band_idx"))).alias("source"),
        F.round("energy", 6).alias("energy"),
    )


MOVING = "'drone', 'car_truck', 'fixed_wing', 'helicopter', 'marine_vessel'"
HYBRID_SQL = f"""WITH {SCORE_SQL}, {DOPPLER},
top3 AS (SELECT recording_id, rank, source, round_even(score, 3) AS conf FROM ranked WHERE rank <= 3),
boost AS (SELECT t.recording_id, t.rank, t.source, d.direction, CASE WHEN d.direction = 'stationary' THEN t.conf
    WHEN t.source IN ({MOVING}) THEN least(1.0, t.conf * 1.3) ELSE t.conf * 0.7 END AS conf
  FROM top3 t JOIN lead_dir d USING (recording_id)),
again AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY conf DESC, rank) AS place FROM boost)"""


@query(
    "hybrid_first_guess",
    HYBRID_SQL
    + """ SELECT recording_id, source AS first_guess, round(conf, 6) AS confidence, a.direction,
  a.direction <> 'stationary' AS is_moving, round(mean_v, 5) + 0.0 AS velocity_m_s,
  'frequency_band+doppler' AS method FROM again a JOIN summary USING (recording_id) WHERE place = 1""",
)
def hybrid(spark, folder):
    guess = B.hybrid_classify(_profiles(spark, folder), V.doppler_summary(_doppler(spark, folder)))
    return guess.select(
        "recording_id", "first_guess", F.round(F.col("candidates")[0]["confidence"], 6).alias("confidence"),
        "direction", "is_moving", rounded("velocity_m_s", 5).alias("velocity_m_s"), "method",
    )


@query(
    "motion_boosted_candidates",
    HYBRID_SQL
    + " SELECT recording_id, place, source, round(conf, 6) AS confidence FROM again",
)
def boosted(spark, folder):
    guess = B.hybrid_classify(_profiles(spark, folder), V.doppler_summary(_doppler(spark, folder)))
    rows = guess.select("recording_id", F.posexplode_outer("candidates").alias("pos", "c"))
    return rows.select(
        "recording_id", (F.col("pos") + 1).cast("long").alias("place"), F.col("c.class").alias("source"),
        F.round("c.confidence", 6).alias("confidence"),
    )


@query(
    "band_first_guess",
    f"""WITH {SCORE_SQL} SELECT recording_id, source AS first_guess, round_even(score, 3) AS confidence,
  'frequency_band' AS method FROM ranked WHERE rank = 1""",
)
def first_guess(spark, folder):
    return B.hybrid_classify(_profiles(spark, folder)).select(
        "recording_id", "first_guess", F.col("candidates")[0]["confidence"].alias("confidence"), "method"
    )


# Every vector 2k is channel 0 of recording k and 2k+1 channel 1.
PAIR_SQL = f"""WITH {SIG}, pos AS (SELECT recording_id::BIGINT AS v, i, x FROM smp),
dft AS (SELECT v, k, sum(x * cos(2 * pi() * k * i / 128)) AS re, -sum(x * sin(2 * pi() * k * i / 128)) AS im
  FROM pos, range(128) t(k) GROUP BY ALL),
cross_spec AS (SELECT a.v // 2 AS rec, a.k, a.re * b.re + a.im * b.im AS re, a.im * b.re - a.re * b.im AS im
  FROM dft a JOIN dft b ON b.v = a.v + 1 AND a.v % 2 = 0 AND a.k = b.k),
phat AS (SELECT rec, k, re / greatest(sqrt(re * re + im * im), 1e-10) AS re,
    im / greatest(sqrt(re * re + im * im), 1e-10) AS im FROM cross_spec),
cc AS (SELECT rec, s, abs(sum(re * cos(2 * pi() * k * s / 128) - im * sin(2 * pi() * k * s / 128)) / 128) AS c
  FROM phat, range({{lo}}, {{hi}}) t(s) GROUP BY ALL),
best AS (SELECT rec, s FROM cc QUALIFY row_number() OVER (PARTITION BY rec ORDER BY c DESC, s) = 1)"""


@query(
    "gcc_phat_delay",
    PAIR_SQL.format(lo=-64, hi=64) + " SELECT rec::VARCHAR AS recording_id, s::INTEGER AS delay FROM best",
)
def delays(spark, folder):
    cut = A.stereo_from_embeddings(spark, folder, SR).withColumn("frame_idx", F.lit(0))
    from wavelark.functions.spectral import gcc_phat

    return D.channel_pairs(cut).select("recording_id", gcc_phat("first", "second", F.lit(None)).alias("delay"))


@query(
    "doa_two_microphones",
    PAIR_SQL.format(lo=-9, hi=10)
    + """ SELECT rec::VARCHAR AS recording_id, 1 AS channel, 0.2::DOUBLE AS distance_m,
  round(s / 16384.0, 9) + 0.0 AS tdoa_s,
  round(degrees(asin(greatest(-1, least(1, 343.0 * (s / 16384.0) / 0.2)))), 5) + 0.0 AS angle_deg FROM best""",
)
def arrival(spark, folder):
    cut = A.stereo_from_embeddings(spark, folder, SR).withColumn("frame_idx", F.lit(0))
    rows = D.doa_array(cut, [(0.0, 0.0), (0.2, 0.0)])
    return rows.select(
        "recording_id", "channel", "distance_m", rounded("tdoa_s", 9).alias("tdoa_s"),
        rounded("angle_deg", 5).alias("angle_deg"),
    )


@query(
    "tdoa_to_angle",
    """SELECT event_id, round(degrees(asin(greatest(-1, least(1, 343.0 * ((value - 50) / 100000) / 0.1)))), 6) + 0.0
  AS angle_deg FROM events""",
)
def tdoa_angle(spark, folder):
    events = A.table(spark, folder, "events")
    tdoa = (F.col("value") - 50) / 100000
    return events.select("event_id", rounded(D.angle(tdoa, F.lit(0.1))).alias("angle_deg"))


@query(
    "channel_extraction",
    """SELECT (vec_id // 2)::VARCHAR AS recording_id, round(list_sum(embedding::DOUBLE[]), 6) + 0.0 AS total
  FROM embeddings WHERE vec_id % 2 = 1""",
)
def one_channel(spark, folder):
    rows = D.channel(A.stereo_from_embeddings(spark, folder, SR), 1)
    return rows.select("recording_id", rounded(B.array_sum(F.col("samples"))).alias("total"))


@query(
    "channel_range_check",
    """SELECT (vec_id // 2)::VARCHAR AS recording_id, max(vec_id % 2)::INTEGER AS last_channel,
  count(*) FILTER (WHERE vec_id % 2 = 1) > 0 AS present FROM embeddings GROUP BY 1""",
)
def channel_check(spark, folder):
    return D.has_channel(A.stereo_from_embeddings(spark, folder, SR), 1)
