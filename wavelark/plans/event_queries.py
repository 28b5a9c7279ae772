"""Sensor values as samples: windows, clicks, spikes, packets, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from wavelark.functions.levels import energy
from wavelark.operators import bands as B
from wavelark.operators import events as E
from wavelark.operators import packets as P
from wavelark.operators import runs as R
from wavelark.operators import segment as G
from wavelark.operators.framing import chunked, own_samples, sliding_windows, with_halo
from wavelark.operators.ordered import exact_quantile
from wavelark.plans.registry import query, rounded
from wavelark.plans.signal_queries import BAND_SQL
from wavelark.sources import adapters as A

EV = """ev AS (SELECT user_id::VARCHAR AS recording_id,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, value, ts,
  count(*) OVER (PARTITION BY user_id) AS n FROM events)"""


def _signals(spark, folder, chunk=16, halo=16):
    return A.signals_from_events(spark, folder, chunk, halo)


def _total(cut):
    total = F.aggregate("samples", F.lit(0.0), lambda a, x: a + x)
    return cut.select("recording_id", "frame_idx", "start", rounded(total, 4).alias("total"))


def windows_sql(width: int, step: int, bound: str) -> str:
    return f"""WITH {EV}, w AS (SELECT recording_id, f, n FROM (SELECT DISTINCT recording_id, n FROM ev), range(1000000) t(f)
    WHERE f <= n // {step} AND f * {step} {bound} n - {width})
  SELECT w.recording_id, f AS frame_idx, f * {step} AS start, round(sum(value), 4) + 0.0 AS total
  FROM w JOIN ev ON ev.recording_id = w.recording_id AND idx >= f * {step} AND idx < f * {step} + {width} GROUP BY ALL"""


@query("sliding_windows", windows_sql(10, 5, "<").replace("range(1000000)", "range(20000)"))
def windows(spark, folder):
    return _total(sliding_windows(_signals(spark, folder), 10.0, 5.0))


@query("sliding_windows_inclusive", windows_sql(10, 5, "<=").replace("range(1000000)", "range(20000)"))
def windows_inclusive(spark, folder):
    return _total(sliding_windows(_signals(spark, folder), 10.0, 5.0, inclusive=True))


@query("chunks_with_overlap", windows_sql(8, 6, "<=").replace("range(1000000)", "range(20000)"))
def overlap_chunks(spark, folder):
    return _total(chunked(_signals(spark, folder), 8.0, 0.25))


@query("chunks_tumbling", windows_sql(8, 8, "<=").replace("range(1000000)", "range(20000)"))
def tumbling_chunks(spark, folder):
    return _total(chunked(_signals(spark, folder), 8.0))


@query("halo_exchange", f"WITH {EV} SELECT recording_id, idx, value FROM ev")
def halo_round_trip(spark, folder):
    signals = with_halo(_signals(spark, folder, 16, 0), 24)
    return own_samples(signals).select("recording_id", "idx", "value")


SCENE = f"""{EV}, win AS (SELECT recording_id, idx // 5 AS frame_idx, any_value(n) AS n, sqrt(avg(value * value)) AS rms
  FROM ev WHERE idx // 5 * 5 < n - 5 GROUP BY ALL)"""


@query(
    "scene_windows",
    f"WITH {SCENE} SELECT recording_id, frame_idx, (frame_idx * 5)::DOUBLE AS time_s, round(rms, 5) AS rms FROM win",
)
def scene_rms(spark, folder):
    return E.scene_windows(_signals(spark, folder), 5.0).select(
        "recording_id", "frame_idx", "time_s", F.round("rms", 5).alias("rms")
    )


@query(
    "energy_spikes",
    f"""WITH {SCENE}, prev AS (SELECT *, avg(rms) OVER (PARTITION BY recording_id ORDER BY frame_idx
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM win)
  SELECT recording_id, frame_idx, (frame_idx * 5)::DOUBLE AS time_s, round_even(rms, 4) AS energy, 'energy_spike' AS type
  FROM prev WHERE before IS NOT NULL AND rms > 2 * before AND rms > 0.01""",
)
def spikes(spark, folder):
    windows = E.scene_windows(_signals(spark, folder), 5.0)
    return E.energy_spikes(windows, 5.0).select("recording_id", "frame_idx", "time_s", "energy", "type")


@query(
    "scene_totals",
    f"WITH {SCENE} SELECT recording_id, count(*) AS n_windows, round_even(any_value(n)::DOUBLE, 2) AS duration_s FROM win GROUP BY 1",
)
def totals(spark, folder):
    return E.scene_totals(E.scene_windows(_signals(spark, folder), 5.0)).drop("channel")


@query(
    "scene_analysis",
    f"""WITH {BAND_SQL}, top AS (SELECT recording_id, name FROM energy
    QUALIFY row_number() OVER (PARTITION BY recording_id ORDER BY energy DESC, band_idx) = 1),
  win AS (SELECT recording_id, i // 16 AS f, sqrt(avg(x * x)) AS rms FROM smp WHERE i < 48 GROUP BY ALL),
  prev AS (SELECT *, avg(rms) OVER (PARTITION BY recording_id ORDER BY f
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM win),
  ev AS (SELECT recording_id, count(*) AS n_windows, count(*) FILTER (WHERE rms > 1.2 * before AND rms > 0.01) AS n_loud,
    count(*) FILTER (WHERE rms > 2 * before AND rms > 0.01) AS n_events FROM prev GROUP BY 1)
  SELECT recording_id, name AS scene_label, n_windows, n_events, 0.0::DOUBLE AS duration_s FROM top JOIN ev USING (recording_id)""",
)
def scene(spark, folder):
    signals = A.signals_from_embeddings(spark, folder, 16384)
    rows = E.scene(signals, B.band_energy(signals, n_fft=64), 16 / 16384)
    return rows.select("recording_id", "scene_label", "n_windows", "n_events", "duration_s")


JUMP = f"""{EV}, j AS (SELECT recording_id, idx, value,
    abs(lead(value) OVER (PARTITION BY recording_id ORDER BY idx) - value) AS jump FROM ev),
thr AS (SELECT recording_id, avg(jump) + 2 * stddev_pop(jump) AS threshold FROM j GROUP BY 1),
clk AS (SELECT j.*, coalesce(jump > threshold, false) AS click FROM j JOIN thr USING (recording_id))"""


@query(
    "clicks",
    f"WITH {JUMP} SELECT recording_id, idx, idx::DOUBLE AS time_s, round(jump, 6) AS amplitude FROM clk WHERE click",
)
def click_rows(spark, folder):
    rows = G.clicks(_signals(spark, folder))
    return rows.select("recording_id", "idx", "time_s", F.round("amplitude", 6).alias("amplitude"))


@query(
    "click_segments",
    f"""WITH {JUMP}, cut AS (SELECT *, sum(click::INTEGER) OVER (PARTITION BY recording_id ORDER BY idx) AS segment FROM clk),
  seg AS (SELECT recording_id, segment, min(idx) AS first_idx, count(*) AS n_samples,
    20 * log10(sqrt(avg(value * value))) AS level FROM cut GROUP BY ALL),
  kept AS (SELECT * FROM seg WHERE n_samples * 1000 >= 2000 AND level > 32)
  SELECT recording_id, row_number() OVER (PARTITION BY recording_id ORDER BY segment) AS number, first_idx, n_samples,
    n_samples * 1000.0::DOUBLE AS length_ms, round(level, 5) AS level_db FROM kept""",
)
def segment_rows(spark, folder):
    rows = G.segments(_signals(spark, folder), min_ms=2000, min_dbfs=32)
    return rows.select(
        "recording_id", "number", "first_idx", "n_samples", "length_ms", F.round("level_db", 5).alias("level_db")
    )


def _packets(spark, folder):
    return A.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("sensor_id"), "ts", "event_id",
        # Every third packet is numbered as if it had been sent 500 earlier.
        (F.col("event_id") - F.when(F.col("event_id") % 3 == 0, 500).otherwise(0)).alias("seq"),
    )


PKT = """pk AS (SELECT user_id::VARCHAR AS sensor_id, event_id, ts,
    event_id - CASE WHEN event_id % 3 = 0 THEN 500 ELSE 0 END AS seq FROM events)"""


@query(
    "packet_gaps",
    f"""WITH {PKT}, g AS (SELECT sensor_id, event_id, seq, ts,
    coalesce(seq - lag(seq) OVER (PARTITION BY sensor_id ORDER BY ts, event_id) - 1, 0) AS gap FROM pk)
  SELECT sensor_id, event_id, seq, gap,
    sum(gap) OVER (PARTITION BY sensor_id ORDER BY ts, event_id)::BIGINT AS dropped FROM g""",
)
def gaps(spark, folder):
    rows = P.packet_gaps(_packets(spark, folder), ["ts", "event_id"])
    return rows.select("sensor_id", "event_id", "seq", "gap", "dropped")


@query(
    "packet_loss",
    f"""WITH {PKT}, t AS (SELECT *, max(seq) OVER (PARTITION BY sensor_id ORDER BY ts, event_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM pk),
  g AS (SELECT *, coalesce(seq <= top, false) AS late,
    CASE WHEN top IS NULL OR seq <= top THEN 0 ELSE seq - top - 1 END AS gap FROM t)
  SELECT sensor_id, event_id, late, gap, sum(gap) OVER (PARTITION BY sensor_id ORDER BY ts, event_id)::BIGINT AS dropped FROM g""",
)
def losses(spark, folder):
    rows = P.packet_loss(_packets(spark, folder), ["ts", "event_id"])
    return rows.select("sensor_id", "event_id", "late", "gap", "dropped")


@query(
    "waveform_envelope",
    f"""WITH {EV} SELECT recording_id, (idx * 8 // n) AS bucket, min(value) AS low, max(value) AS high FROM ev GROUP BY ALL""",
)
def envelope(spark, folder):
    from wavelark.operators.spectrogram import waveform_envelope

    return waveform_envelope(_signals(spark, folder), 8).select("recording_id", "bucket", "low", "high")


@query(
    "sensor_windows_sliding",
    """WITH w AS (SELECT user_id::VARCHAR AS sensor_id, value,
    unnest([time_bucket(INTERVAL 1 hour, ts), time_bucket(INTERVAL 1 hour, ts) - INTERVAL 1 hour]) AS started FROM events)
  SELECT sensor_id, started, started + INTERVAL 2 hour AS ended, count(*) AS n, round(avg(value), 4) AS mean_value,
    max(value) AS max_value FROM w GROUP BY ALL""",
)
def sensor_windows(spark, folder):
    from wavelark.streaming.windows import windowed_stats

    events = A.table(spark, folder, "events").withColumn("sensor_id", F.col("user_id").cast("string"))
    rows = windowed_stats(events, "2 hours", "1 hour")
    return rows.select("sensor_id", "started", "ended", "n", F.round("mean_value", 4).alias("mean_value"), "max_value")


@query(
    "session_summary",
    """WITH s AS (SELECT user_id::VARCHAR AS sensor_id, ts, value, event_type,
    coalesce(ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 6 hour, true)::INTEGER AS fresh FROM events),
  n AS (SELECT *, sum(fresh) OVER (PARTITION BY sensor_id ORDER BY ts) AS session FROM s)
  SELECT sensor_id, min(ts) AS started, max(ts) + INTERVAL 6 hour AS ended, count(*) AS processed,
    sum(value::DECIMAL(18,4))::DOUBLE / count(value) AS mean_latency, count(*) FILTER (WHERE event_type = 'error') AS detections
  FROM n GROUP BY sensor_id, session""",
)
def sessions(spark, folder):
    events = A.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("sensor_id"), "ts", F.col("value").cast("decimal(18,4)").alias("latency"),
        (F.col("event_type") == "error").alias("detected"),
    )
    return R.session_summary(events, "6 hours")


@query(
    "sensor_medians",
    "SELECT user_id, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90 FROM events GROUP BY 1",
)
def medians(spark, folder):
    events = A.table(spark, folder, "events")
    half = exact_quantile(events, ["user_id"], "value", 0.5, "median")
    high = exact_quantile(events, ["user_id"], "value", 0.9, "p90")
    return half.join(high, "user_id").select(
        "user_id", F.round("median", 6).alias("median"), F.round("p90", 6).alias("p90")
    )


def _byte_pairs(value):
    """An int16 as two bytes, low byte first, in hexadecimal."""
    word = F.lpad(F.hex(F.when(value < 0, value + 65536).otherwise(value)), 4, "0")
    return F.concat(F.substring(word, 3, 2), F.substring(word, 1, 2))


@query(
    "packet_decoding",
    """SELECT user_id::VARCHAR AS sensor_id, event_id AS seq, 32::BIGINT AS n_samples, j // 16 AS frame_idx, j % 16 AS ch,
    round(((event_id * 31 + j * 7) % 65536 - 32768) / 32768.0::DOUBLE, 9) + 0.0 AS value FROM events, range(32) t(j)""",
)
def decoded_packets(spark, folder):
    event = F.col("event_id")
    number = F.lpad(F.hex(event), 8, "0")
    low_first = F.concat(*[F.substring(number, at, 2) for at in (7, 5, 3, 1)])
    values = F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: (event * 31 + j * 7) % 65536 - 32768)
    body = F.array_join(F.transform(values, _byte_pairs), "")
    # Three bytes too many at the end: an incomplete frame that is cut off.
    payload = F.unhex(F.concat(low_first, F.lit("20000000"), body, F.lit("010203")))
    packets = A.table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("sensor_id"), "ts", payload.alias("payload")
    )
    rows = P.packet_frames(P.decode_packets(packets))
    return rows.select(
        "sensor_id", "seq", "n_samples", F.col("frame_idx").cast("long").alias("frame_idx"),
        F.col("ch").cast("long").alias("ch"), rounded("value", 9).alias("value"),
    )


@query(
    "raw_float_decoding",
    """SELECT event_id, 1 + ((event_id * 31) % 8388608) / 8388608.0::DOUBLE AS first,
    1 + ((event_id * 31 + 7) % 8388608) / 8388608.0::DOUBLE AS second FROM events""",
)
def raw_floats(spark, folder):
    """Floats from 1 to 2: sign and exponent are fixed, the 23 low bits count."""
    from wavelark.functions.sql import decode_float32

    event = F.col("event_id")

    def low_first(bits):
        word = F.lpad(F.hex(bits), 8, "0")
        return F.concat(*[F.substring(word, at, 2) for at in (7, 5, 3, 1)])

    body = F.concat(*[low_first((event * 31 + j * 7) % 8388608 + 0x3F800000) for j in range(2)])
    rows = A.table(spark, folder, "events").select("event_id", decode_float32(F.unhex(body)).alias("s"))
    return rows.select(
        "event_id", F.col("s")[0].cast("double").alias("first"), F.col("s")[1].cast("double").alias("second")
    )


@query(
    "raw_chunk_decoding",
    """SELECT event_id, ((event_id * 31) % 65536 - 32768) / 32768.0::DOUBLE AS first,
    ((event_id * 31 + 7) % 65536 - 32768) / 32768.0::DOUBLE AS second FROM events""",
)
def raw_chunks(spark, folder):
    from wavelark.functions.sql import decode_pcm16

    event = F.col("event_id")
    body = F.concat(*[_byte_pairs((event * 31 + j * 7) % 65536 - 32768) for j in range(2)])
    rows = A.table(spark, folder, "events").select("event_id", decode_pcm16(F.unhex(body)).alias("s"))
    return rows.select("event_id", F.col("s")[0].alias("first"), F.col("s")[1].alias("second"))
