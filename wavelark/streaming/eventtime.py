"""Per-sensor operators in event time, whatever micro-batch a row comes in.

Rows wait, in state, until the watermark has passed them; a timer then lets them
go in order of time, so a row that comes late but within the watermark finds its
place and the output is the batch operator's.  A sensor that has been silent for
``ttl`` of event time is forgotten: its state goes, and if it speaks again it
starts anew.

State is what the fold of an operator needs (a few numbers) and the rows that
wait, at most those of one watermark delay.  A sensor has one timer at a time:
at its earliest waiting row, or at the end of its silence.

Needs the RocksDB state store (``state_store``) and a watermark on ``ts``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: state, row -> (new state, output values or None); state None is a sensor not known.
Step = Callable[[tuple | None, tuple], tuple[tuple, tuple | None]]


def state_store(spark: SparkSession) -> None:
    """Select the state store that timers and maps need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


def _milliseconds(duration: str) -> int:
    return int(pd.Timedelta(duration).total_seconds() * 1000)


class InOrder(StatefulProcessor):
    """Applies ``step`` to a sensor's rows in order of (ts, ``tie``), once the watermark has passed them."""

    def __init__(self, step: Step, columns: Sequence[str], row: str, memory: str, tie: str, out: Sequence[str], ttl: int):
        self.step, self.columns, self.row, self.memory = step, list(columns), row, memory
        self.tie, self.out, self.ttl = tie, list(out), ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", self.memory)
        self.clock = handle.getValueState("clock", "last long, timer long")
        # Rows of one instant keep their number, so that equal rows stay apart.
        self.waiting = handle.getMapState("waiting", "micros long, place long", self.row)

    def _clock(self) -> tuple[int, int]:
        return tuple(self.clock.get()) if self.clock.exists() else (-1, -1)

    def _set(self, last: int, timer: int, before: int) -> None:
        """One timer a sensor: ``timer`` replaces the one set ``before``."""
        if timer != before:
            if before >= 0:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(timer)
        self.clock.update((last, timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last, timer = self._clock()
        place = 1 + max((k[1] for k in self.waiting.keys()), default=-1)
        first = None
        for batch in rows:
            micros = batch["ts"].astype("datetime64[us]").astype("int64")
            for at, values in zip(micros, batch[self.columns].itertuples(index=False, name=None)):
                self.waiting.updateValue((int(at), place), tuple(v.item() if hasattr(v, "item") else v for v in values))
                place += 1
                first = int(at) if first is None else min(first, int(at))
        if first is not None:
            # A timer rings when the watermark is behind it, that is, once no earlier row can come.
            earliest = first // 1000 + 1
            waits = timer >= 0 and place > 0 and timer <= earliest and self._any_before(timer)
            self._set(last, timer if waits else earliest, timer)
        yield pd.DataFrame(columns=self.out)

    def _any_before(self, timer: int) -> bool:
        return any(k[0] // 1000 < timer for k in self.waiting.keys())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        last, _ = self._clock()
        state = tuple(self.known.get()) if self.known.exists() else None
        ready, ahead = [], None
        for at, values in self.waiting.iterator():
            if at[0] // 1000 < mark:
                ready.append((at[0], values[self.columns.index(self.tie)] if self.tie else 0, at[1], tuple(values)))
            else:
                ahead = at[0] if ahead is None else min(ahead, at[0])
        ready.sort(key=lambda r: r[:3])
        out = []
        for micros, _, place, values in ready:
            if state is not None and last >= 0 and micros // 1000 - last > self.ttl:
                state = None  # it was silent for too long, whenever the timer rang
            state, made = self.step(state, values)
            last = micros // 1000
            if made is not None:
                out.append((key[0], pd.Timestamp(micros, unit="us"), *made))
            self.waiting.removeKey((micros, place))
        if ahead is not None:
            self._keep(state)
            self._after(last, ahead // 1000 + 1)
        elif last + self.ttl < mark:
            for kept in (self.known, self.clock, self.waiting):
                kept.clear()
        else:
            self._keep(state)
            self._after(last, last + self.ttl + 1)
        yield pd.DataFrame(out, columns=self.out)

    def _after(self, last: int, timer: int) -> None:
        """The timer that rang is gone; the next one is set."""
        self.handle.registerTimer(timer)
        self.clock.update((last, timer))

    def _keep(self, state: tuple | None) -> None:
        if state is not None:
            self.known.update(state)

    def close(self) -> None:
        pass


def in_order(
    rows: DataFrame, step: Step, columns: dict[str, str], memory: str, out: dict[str, str], watermark: str, ttl: str,
    tie: str = "",
) -> DataFrame:
    """``step`` over every sensor's rows (sensor_id, ts, ``columns``) in event time.

    ``columns`` and ``out`` map names to types, ``memory`` is the state's schema.
    Rows later than ``watermark`` are dropped by Spark.
    """
    state_store(rows.sparkSession)
    names = ["sensor_id", "ts", *out]
    schema = ", ".join(["sensor_id string", "ts timestamp", *[f"{n} {t}" for n, t in out.items()]])
    body = ", ".join(f"{n} {t}" for n, t in columns.items())
    processor = InOrder(step, list(columns), body, memory, tie, names, _milliseconds(ttl))
    timed = rows.select("sensor_id", "ts", *columns).withWatermark("ts", watermark)
    return timed.groupBy("sensor_id").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode="EventTime"
    )


def packet_loss(packets: DataFrame, watermark: str = "10 seconds", ttl: str = "1 hour") -> DataFrame:
    """``operators.packets.packet_loss`` live: a row per packet (sensor_id, ts, seq)."""

    def step(state, row):
        (seq,) = row
        if state is None:
            return (seq, 0), (seq, False, 0, 0)
        top, dropped = state
        if seq <= top:
            return state, (seq, True, 0, dropped)
        gap = seq - top - 1
        return (seq, dropped + gap), (seq, False, gap, dropped + gap)

    out = {"seq": "long", "late": "boolean", "gap": "long", "dropped": "long"}
    return in_order(packets, step, {"seq": "long"}, "top long, dropped long", out, watermark, ttl, "seq")


def energy_spikes(
    windows: DataFrame, ratio: float = 2.0, floor: float = 0.01, watermark: str = "10 seconds", ttl: str = "1 hour"
) -> DataFrame:
    """Windows (sensor_id, ts, rms) louder than ``ratio`` times the mean of all before."""

    def step(state, row):
        n, total = state or (0, 0.0)
        (rms,) = row
        loud = n > 0 and rms * n > ratio * total and rms > floor
        return (n + 1, total + rms), (round(rms, 4), "energy_spike") if loud else None

    return in_order(
        windows, step, {"rms": "double"}, "n long, total double", {"energy": "double", "type": "string"}, watermark, ttl
    )


def velocities(
    freqs: DataFrame, speed: float = 343.0, tolerance_hz: float = 2.0, watermark: str = "10 seconds", ttl: str = "1 hour"
) -> DataFrame:
    """Velocity between each chunk (sensor_id, ts, freq_hz) and the sensor's chunk before."""

    def step(state, row):
        (f2,) = row
        if state is None:
            return (f2,), None
        (f1,) = state
        shift = f2 - f1
        way = "stationary" if abs(shift) < tolerance_hz else "approaching" if shift > 0 else "receding"
        return (f2,), (f1, f2, speed * shift / f2 if f2 > 0 else 0.0, way)

    out = {"f1_hz": "double", "f2_hz": "double", "velocity_m_s": "double", "direction": "string"}
    return in_order(freqs, step, {"freq_hz": "double"}, "freq_hz double", out, watermark, ttl)
