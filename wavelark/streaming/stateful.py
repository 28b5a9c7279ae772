"""Operators that remember something per sensor between micro-batches.

Rows of one sensor in one micro-batch are ordered by time before they meet the
state; the size of a micro-batch is bounded by the source's trigger options.
States are a few numbers, or a buffer of fixed capacity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def _ordered(batches: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    parts = [b for b in batches if len(b)]
    return pd.concat(parts).sort_values(by, kind="stable", ignore_index=True) if parts else pd.DataFrame()


def packet_loss_stream(packets: DataFrame) -> DataFrame:
    """Gap, running losses and lateness per packet (sensor_id, ts, seq).

    A packet at or below the highest sequence seen is late and changes nothing.
    """

    def count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        top, dropped = state.get if state.exists else (-1, 0)
        rows = _ordered(batches, ["ts", "seq"])
        out = []
        for ts, seq in zip(rows["ts"], rows["seq"]):
            late = top >= 0 and seq <= top
            gap = 0 if late or top < 0 else int(seq - top - 1)
            dropped += gap
            top = top if late else int(seq)
            out.append((key[0], ts, int(seq), bool(late), gap, dropped))
        state.update((top, dropped))
        yield pd.DataFrame(out, columns=["sensor_id", "ts", "seq", "late", "gap", "dropped"])

    return packets.select("sensor_id", "ts", "seq").groupBy("sensor_id").applyInPandasWithState(
        count, "sensor_id string, ts timestamp, seq long, late boolean, gap long, dropped long",
        "top long, dropped long", "append", GroupStateTimeout.NoTimeout,
    )


def energy_spike_stream(windows: DataFrame, ratio: float = 2.0, floor: float = 0.01) -> DataFrame:
    """Windows louder than ``ratio`` times the mean of all before (sensor_id, ts, rms)."""

    def watch(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total = state.get if state.exists else (0, 0.0)
        rows = _ordered(batches, ["ts"])
        rms = rows["rms"].to_numpy(dtype=float)
        seen = n + np.arange(len(rms))
        before = total + np.concatenate([[0.0], np.cumsum(rms)[:-1]])
        loud = (seen > 0) & (rms * seen > ratio * before) & (rms > floor)
        state.update((n + len(rms), total + float(rms.sum())))
        hits = rows[loud]
        yield pd.DataFrame({"sensor_id": key[0], "ts": hits["ts"], "energy": np.round(hits["rms"], 4), "type": "energy_spike"})

    return windows.select("sensor_id", "ts", "rms").groupBy("sensor_id").applyInPandasWithState(
        watch, "sensor_id string, ts timestamp, energy double, type string",
        "n long, total double", "append", GroupStateTimeout.NoTimeout,
    )


def velocity_stream(freqs: DataFrame, speed: float = 343.0, tolerance_hz: float = 2.0) -> DataFrame:
    """Velocity between each chunk and the sensor's chunk before (sensor_id, ts, freq_hz)."""

    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _ordered(batches, ["ts"])
        f2 = rows["freq_hz"].to_numpy(dtype=float)
        f1 = np.concatenate([[state.get[0] if state.exists else np.nan], f2[:-1]])
        state.update((float(f2[-1]),))
        shift = f2 - f1
        v = np.where(f2 > 0, speed * shift / np.where(f2 > 0, f2, 1), 0.0)
        way = np.where(np.abs(shift) < tolerance_hz, "stationary", np.where(shift > 0, "approaching", "receding"))
        out = pd.DataFrame(
            {"sensor_id": key[0], "ts": rows["ts"], "f1_hz": f1, "f2_hz": f2, "velocity_m_s": v, "direction": way}
        )
        yield out[~np.isnan(f1)]

    return freqs.select("sensor_id", "ts", "freq_hz").groupBy("sensor_id").applyInPandasWithState(
        follow, "sensor_id string, ts timestamp, f1_hz double, f2_hz double, velocity_m_s double, direction string",
        "freq_hz double", "append", GroupStateTimeout.NoTimeout,
    )


def rebuffer(packets: DataFrame, sr: int, seconds: float = 2.0, frames: int = 1024, channels: int = 16, flush: str | None = None) -> DataFrame:
    """Packets of any size to windows of exactly ``frames`` frames.

    ``packets``: sensor_id, ts, seq, frames (array of frames).  Every full
    window is sent, so the windows do not depend on how the stream is cut into
    micro-batches.  Of what remains, less than a window, at most ``sr *
    seconds`` of the newest frames are kept.  With ``flush`` (seconds of silence
    as a duration, e.g. ``"5 seconds"``) what is left is sent zero-padded; a
    sensor with nothing left sends zeros.  Window numbers go on after a flush.
    """
    capacity = int(sr * seconds)
    wait = None if flush is None else int(pd.Timedelta(flush).total_seconds() * 1000)
    names = ["sensor_id", "window", "padded", "samples"]

    def window_rows(key, number: int, block: np.ndarray, padded: int) -> tuple:
        return (key[0], number, padded, block.ravel())

    def refill(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept, number = state.get if state.exists else ([], 0)
        buffer = np.asarray(kept, dtype=float).reshape(-1, channels)
        out = []
        if state.hasTimedOut:
            padded = frames - len(buffer)
            block = np.vstack([buffer, np.zeros((padded, channels))])
            out.append(window_rows(key, number, block, padded))
            state.update(([], number + 1))
        else:
            rows = _ordered(batches, ["ts", "seq"])
            parts = [np.stack([np.asarray(f, dtype=float) for f in packet]) for packet in rows["frames"] if len(packet)]
            buffer = np.vstack([buffer, *parts])
            whole = len(buffer) // frames
            out += [window_rows(key, number + i, buffer[i * frames : (i + 1) * frames], 0) for i in range(whole)]
            rest = buffer[whole * frames :]
            state.update((rest[max(0, len(rest) - capacity) :].ravel().tolist(), number + whole))
            if wait is not None:
                state.setTimeoutDuration(wait)
        yield pd.DataFrame(out, columns=names)

    timeout = GroupStateTimeout.NoTimeout if wait is None else GroupStateTimeout.ProcessingTimeTimeout
    return packets.select("sensor_id", "ts", "seq", "frames").groupBy("sensor_id").applyInPandasWithState(
        refill, "sensor_id string, window long, padded long, samples array<double>",
        "buffer array<double>, number long", "append", timeout,
    )
