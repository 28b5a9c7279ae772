"""Levels, quality gate and per-frame numbers."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelark.functions import levels as L
from wavelark.functions.text import variant_name
from wavelark.model import FilterConfig
from wavelark.operators import quality as Q
from wavelark.operators.framing import frames
from wavelark.operators.ordered import counted, distinct_counts
from wavelark.plans.registry import query, rounded
from wavelark.sources import adapters as A

# Recordings of three rates and eight levels, so that every verdict occurs.
VARIED = """sig AS (SELECT vec_id, vec_id::VARCHAR AS recording_id, 'class_' || label AS class_name,
    CASE WHEN vec_id % 7 = 0 THEN 2048 WHEN vec_id % 5 = 0 THEN 128 ELSE 1024 END AS sr,
    list_transform(embedding, lambda x: x::DOUBLE * 10 * pow(10.0, -(vec_id % 8))) AS e FROM embeddings),
smp AS (SELECT recording_id, class_name, sr, i, e[i + 1] AS x FROM sig, range(64) t(i)),
lvl AS (SELECT recording_id, class_name, sr, sqrt(sum(x * x) / 64) AS rms FROM smp GROUP BY ALL)"""
SNR = """,
fr AS (SELECT recording_id, f, sum(x * x) AS en FROM smp, range(62) t(f)
  WHERE i >= f * floor(0.010 * sr) AND i < f * floor(0.010 * sr) + floor(0.025 * sr)
    AND f <= floor((64 - floor(0.025 * sr)) / floor(0.010 * sr)) GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY recording_id ORDER BY en) AS r,
    count(*) OVER (PARTITION BY recording_id) AS n FROM fr),
ns AS (SELECT recording_id, avg(en) FILTER (WHERE r <= greatest(1, floor(n * 0.1))) AS noise, avg(en) AS mean
  FROM rk GROUP BY 1),
snr AS (SELECT recording_id, CASE WHEN noise < 1e-10 THEN 100 ELSE 10 * log10(mean / noise) END AS snr_db FROM ns)"""
CONFIG = FilterConfig(min_duration_s=0.05, max_duration_s=0.4, min_rms_db=-100.0, max_rms_db=0.0, min_snr_db=2.5)
GATE = f"""WITH {VARIED}{SNR},
gate AS (SELECT l.recording_id, l.class_name, 64.0 / l.sr AS d,
    CASE WHEN rms < 1e-10 THEN '-inf'::DOUBLE ELSE 20 * log10(rms) END AS db, s.snr_db
  FROM lvl l JOIN snr s USING (recording_id)),
verdict AS (SELECT *, CASE WHEN d < 0.05 THEN 'too_short (' || printf('%.2f', d) || 's)'
    WHEN d > 0.4 THEN 'too_long (' || printf('%.2f', d) || 's)'
    WHEN db < -100 THEN 'too_quiet (' || printf('%.1f', db) || ' dBFS)'
    WHEN db > 0 THEN 'clipped (' || printf('%.1f', db) || ' dBFS)'
    WHEN snr_db < 2.5 THEN 'low_snr (' || printf('%.1f', snr_db) || ' dB)' ELSE 'ok' END AS reason FROM gate)"""


def varied(spark, folder):
    vec = F.col("recording_id").cast("long")
    rows = A.signals_from_embeddings(spark, folder)
    scale = 10 * F.pow(F.lit(10.0), -(vec % 8))
    return rows.withColumns(
        {
            "sr": F.when(vec % 7 == 0, 2048).when(vec % 5 == 0, 128).otherwise(1024),
            "samples": F.transform("samples", lambda x: x * scale),
        }
    )


@query(
    "duration_bounds",
    """SELECT doc_id::VARCHAR AS recording_id, n_chars / 100.0::DOUBLE AS duration_s,
  CASE WHEN n_chars / 100.0::DOUBLE < 0.5 THEN 'too_short' WHEN n_chars / 100.0::DOUBLE > 30 THEN 'too_long' END AS verdict
  FROM documents""",
)
def durations(spark, folder):
    duration = Q.duration_s(F.col("n_chars"), F.lit(100.0))
    verdict = F.regexp_extract(Q.duration_verdict(duration, FilterConfig()), r"^\w+", 0)
    return A.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("recording_id"), duration.alias("duration_s"), verdict.alias("verdict")
    )


@query(
    "rms_level",
    f"""WITH {VARIED} SELECT recording_id, round(rms, 9) AS rms, round(20 * log10(rms), 5) + 0.0 AS rms_db FROM lvl""",
)
def rms_levels(spark, folder):
    return Q.with_rms_dbfs(varied(spark, folder)).select(
        "recording_id", F.round("rms", 9).alias("rms"), rounded("rms_db", 5).alias("rms_db")
    )


@query(
    "sensor_rms_level",
    """SELECT user_id::VARCHAR AS recording_id, round(20 * log10(sqrt(avg(value * value))), 5) AS rms_db
  FROM events GROUP BY user_id""",
)
def sensor_rms(spark, folder):
    events = A.table(spark, folder, "events")
    return (
        events.groupBy(F.col("user_id").cast("string").alias("recording_id"))
        .agg(F.sqrt(F.avg(F.col("value") * F.col("value"))).alias("rms"))
        .select("recording_id", F.round(L.dbfs(F.col("rms")), 5).alias("rms_db"))
    )


@query(
    "audio_level_check",
    f"WITH {VARIED} SELECT recording_id, 20 * log10(rms + 1e-6) > -110 AS level_ok, "
    "20 * log10(rms + 1e-6) > -60 AS loud FROM lvl",
)
def level_check(spark, folder):
    rows = Q.with_rms_dbfs(varied(spark, folder))
    return rows.select(
        "recording_id", L.level_ok(F.col("rms")).alias("level_ok"), L.level_ok(F.col("rms"), -60.0).alias("loud")
    )


@query("snr_estimate", f"WITH {VARIED}{SNR} SELECT recording_id, round(snr_db, 5) + 0.0 AS snr_db FROM snr")
def snr(spark, folder):
    return Q.snr_db(varied(spark, folder)).select("recording_id", rounded("snr_db", 5).alias("snr_db"))


@query(
    "quietest_frames",
    f"""WITH {VARIED}{SNR} SELECT recording_id, count(*) FILTER (WHERE r <= greatest(1, floor(n * 0.1))) AS n_noise
  FROM rk GROUP BY 1""",
)
def quietest(spark, folder):
    signals = varied(spark, folder)
    length, hop = Q.seconds_to_samples(0.025), Q.seconds_to_samples(0.010)
    cut = frames(signals, length, hop, F.floor((F.col("n_total") - length) / hop) + 1)
    levels = cut.select("recording_id", L.energy(F.col("samples")).alias("energy"))
    sizes = levels.groupBy("recording_id").agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) * 0.1)).alias("k"))
    ranked = counted(distinct_counts(levels, ["recording_id"], "energy"), ["recording_id"], "energy").join(sizes, "recording_id")
    taken = F.greatest(F.least(F.col("n"), F.col("k") - F.col("below")), F.lit(0))
    return ranked.groupBy("recording_id").agg(F.sum(taken).alias("n_noise"))


@query("quality_gate", GATE + " SELECT recording_id, reason, reason = 'ok' AS passed FROM verdict")
def gate(spark, folder):
    return Q.quality_gate(varied(spark, folder), CONFIG).select("recording_id", "reason", "passed")


@query(
    "quality_report",
    GATE + """ SELECT class_name, count(*) FILTER (WHERE reason = 'ok') AS accepted,
  count(*) FILTER (WHERE reason <> 'ok') AS rejected FROM verdict GROUP BY 1""",
)
def gate_report(spark, folder):
    return Q.quality_report(Q.quality_gate(varied(spark, folder), CONFIG))


@query(
    "frame_rms_zcr",
    """WITH smp AS (SELECT vec_id::VARCHAR AS recording_id, i, embedding[i + 1]::DOUBLE AS x FROM embeddings, range(64) t(i)),
  fr AS (SELECT recording_id, f, i, x, lag(x) OVER (PARTITION BY recording_id, f ORDER BY i) AS p
    FROM smp, range(7) t(f) WHERE i >= 8 * f AND i < 8 * f + 16)
  SELECT recording_id, f AS frame_idx, round(sqrt(avg(x * x)), 7) AS rms,
    count(*) FILTER (WHERE (x < 0) <> (p < 0)) / 16.0::DOUBLE AS zcr FROM fr GROUP BY ALL""",
)
def frame_numbers(spark, folder):
    cut = frames(A.signals_from_embeddings(spark, folder), 16, 8, F.lit(7))
    return Q.frame_levels(cut).select("recording_id", "frame_idx", F.round("rms", 7).alias("rms"), "zcr")


@query(
    "chunk_length_guard",
    """SELECT doc_id, n_chars, CASE WHEN n_chars < 1024 THEN 'too_short' ELSE 'featurise' END AS route FROM documents""",
)
def guard(spark, folder):
    return A.table(spark, folder, "documents").select(
        "doc_id", "n_chars", Q.length_guard(F.col("n_chars")).alias("route")
    )


@query(
    "variant_names",
    """SELECT event_id, 'rec_' || user_id || CASE event_type WHEN 'view' THEN printf('_ps%+.1f', (event_id % 9 - 4)::DOUBLE)
    WHEN 'click' THEN printf('_ts%.1f', (event_id % 9 - 4)::DOUBLE) WHEN 'error' THEN printf('_noise%.0fdB', (event_id % 9 - 4)::DOUBLE)
    WHEN 'signup' THEN printf('_vol%+.0fdB', (event_id % 9 - 4)::DOUBLE) ELSE '_reversed' END AS name FROM events""",
)
def names(spark, folder):
    kind = F.create_map(
        *[F.lit(x) for pair in (("view", "pitch"), ("click", "stretch"), ("error", "noise"), ("signup", "volume"), ("purchase", "reversed")) for x in pair]
    )
    events = A.table(spark, folder, "events")
    base = F.concat(F.lit("rec_"), F.col("user_id").cast("string"))
    param = (F.col("event_id") % 9 - 4).cast("double")
    return events.select("event_id", variant_name(base, kind[F.col("event_type")], param).alias("name"))


@query(
    "pcm_scaling",
    """SELECT event_id, greatest(-32768, least(32767, trunc((value - 50) * 500)))::INTEGER AS pcm,
  greatest(-32768, least(32767, trunc((value - 50) * 500)))::INTEGER / 32768.0::DOUBLE AS sample FROM events""",
)
def pcm(spark, folder):
    value = L.float_to_pcm16((F.col("value") - 50) * 500)
    return A.table(spark, folder, "events").select("event_id", value.alias("pcm")).withColumn(
        "sample", L.pcm16_to_float(F.col("pcm"))
    )
