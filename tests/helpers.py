"""Small signals for tests."""

from __future__ import annotations

import numpy as np

from wavelark.model import SIGNAL_SCHEMA


def make_signals(spark, signals: dict, sr: int = 16000, chunk: int = 4000, halo: int = 0, class_name: str = "c"):
    """DataFrame of chunked signals from {name or (name, channel): array}."""
    rows = []
    for key, values in signals.items():
        name, channel = key if isinstance(key, tuple) else (key, 0)
        values = np.asarray(values, dtype=float)
        n = len(values)
        for start in range(0, n, chunk):
            own = min(chunk, n - start)
            rows.append(
                (name, class_name, channel, sr, n, start, own, values[start : start + own + halo].tolist())
            )
    return spark.createDataFrame(rows, SIGNAL_SCHEMA)


def assemble(df, name: str, channel: int = 0) -> np.ndarray:
    rows = sorted(
        df.filter((df.recording_id == name) & (df.channel == channel)).collect(), key=lambda r: r.start
    )
    return np.concatenate([np.asarray(r.samples[: r.own]) for r in rows])


def tone(freq: float, seconds: float = 1.0, sr: int = 16000, amplitude: float = 0.5) -> np.ndarray:
    return amplitude * np.sin(2 * np.pi * freq * np.arange(int(seconds * sr)) / sr)


def peak_hz(values: np.ndarray, sr: int = 16000) -> float:
    spectrum = np.abs(np.fft.rfft(values * np.hanning(len(values))))
    return float(np.fft.rfftfreq(len(values), 1 / sr)[spectrum.argmax()])
