"""Arrow-batched transforms: one FFT call per batch of frames."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def batched(values: pa.Array, compute: Callable[[np.ndarray], np.ndarray]) -> pa.Array:
    """Apply ``compute`` to all rows of one length at a time.

    A batch of equal-length rows, the usual case, is reshaped without a copy.
    """
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    lengths = np.asarray(values.value_lengths().fill_null(-1))
    flat = np.asarray(values.flatten(), dtype=np.float64)
    kinds = np.unique(lengths)
    if len(kinds) == 1 and kinds[0] > 0:
        out = np.ascontiguousarray(compute(flat.reshape(len(lengths), kinds[0])))
        return _lists(out)
    starts = np.concatenate([[0], np.cumsum(np.maximum(lengths, 0))])[:-1]
    result: list[np.ndarray | None] = [None] * len(lengths)
    for n in kinds[kinds > 0]:
        rows = np.flatnonzero(lengths == n)
        out = compute(flat[starts[rows][:, None] + np.arange(n)])
        for row, vector in zip(rows, out):
            result[row] = vector
    return pa.array(result, type=pa.list_(pa.float64()))


def _lists(matrix: np.ndarray) -> pa.Array:
    n, width = matrix.shape
    offsets = pa.array(np.arange(0, (n + 1) * width, width, dtype=np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(matrix.reshape(-1), type=pa.float64()))


def fit_length(rows: np.ndarray, n: int) -> np.ndarray:
    """Cut or zero-pad rows to ``n`` samples."""
    if rows.shape[1] >= n:
        return rows[:, :n]
    return np.pad(rows, ((0, 0), (0, n - rows.shape[1])))


def power_spectrum(samples: Column | str, n_fft: int | None = None) -> Column:
    """Power of the Hann-windowed (symmetric) frame, ``n_fft // 2 + 1`` bins.

    ``n_fft=None`` takes each row's own length.
    """

    @F.arrow_udf("array<double>")
    def spectrum(values: pa.Array) -> pa.Array:
        return power_spectrum_batch(values, n_fft)

    return spectrum(samples)


def power_spectrum_batch(values: pa.Array, n_fft: int | None) -> pa.Array:
    return batched(values, lambda rows: _power(rows, n_fft or rows.shape[1]))


def _frames_by_shape(values: pa.Array, rates: pa.Array):
    """Groups of equal length and rate: (row positions, matrix, rate)."""
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    lengths = np.asarray(values.value_lengths().fill_null(0))
    flat = np.asarray(values.flatten(), dtype=np.float64)
    starts = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    sr = np.asarray(rates)
    for n, rate in np.unique(np.stack([lengths, sr], axis=1), axis=0):
        rows = np.flatnonzero((lengths == n) & (sr == rate))
        yield rows, flat[starts[rows][:, None] + np.arange(n)], int(rate)


def _power(rows: np.ndarray, n_fft: int) -> np.ndarray:
    return np.abs(np.fft.rfft(fit_length(rows, n_fft) * np.hanning(n_fft), axis=1)) ** 2


def dominant_frequency(
    samples: Column | str,
    sr: Column | str,
    n_fft: int | None = None,
    low_hz: float = 20.0,
    high_hz: float = 20000.0,
) -> Column:
    """Frequency of the strongest bin in the band, refined by a parabola.

    The refinement works on magnitudes and only where both neighbours of the
    peak are in the band; an empty band gives 0.  The FFT and the search share
    one batch, so no spectrum travels back to the JVM.
    """

    @F.arrow_udf("double")
    def peak(values: pa.Array, rates: pa.Array) -> pa.Array:
        return dominant_frequency_batch(values, rates, n_fft, low_hz, high_hz)

    return peak(samples, sr)


def dominant_frequency_batch(
    values: pa.Array, rates: pa.Array, n_fft: int | None, low_hz: float, high_hz: float
) -> pa.Array:
    out = np.zeros(len(values))
    for at, frames, rate in _frames_by_shape(values, rates):
        size = n_fft or frames.shape[1]
        if size == 0:
            continue
        freqs = np.fft.rfftfreq(size, d=1.0 / rate)
        allowed = np.flatnonzero((freqs >= low_hz) & (freqs <= high_hz))
        if len(allowed) == 0:
            continue
        magnitude = np.sqrt(_power(frames, size)[:, allowed])
        top = magnitude.argmax(axis=1)
        line = np.arange(len(top))
        inner = (top > 0) & (top < len(allowed) - 1)
        left, mid, right = (magnitude[line, np.clip(top + d, 0, len(allowed) - 1)] for d in (-1, 0, 1))
        bend = left - 2 * mid + right
        usable = inner & (bend != 0)
        shift = np.zeros(len(top))
        shift[usable] = 0.5 * (left - right)[usable] / bend[usable]
        out[at] = freqs[allowed][top] + shift * rate / size
    return pa.array(out)


def band_power(
    samples: Column | str, sr: Column | str, n_fft: int, limits: list[tuple[float, float]]
) -> Column:
    """Power per band, bins with ``low <= f < high``; one value per band."""

    @F.arrow_udf("array<double>")
    def energy(values: pa.Array, rates: pa.Array) -> pa.Array:
        out = np.zeros((len(values), len(limits)))
        for at, frames, rate in _frames_by_shape(values, rates):
            freqs = np.fft.rfftfreq(n_fft, d=1.0 / rate)
            member = np.array([(freqs >= low) & (freqs < high) for low, high in limits], dtype=float)
            out[at] = _power(frames, n_fft) @ member.T
        return _lists(out)

    return energy(samples, sr)


def mean_band_power(
    samples: Column | str, sr: Column | str, n_fft: int, limits: list[tuple[float, float]]
) -> Column:
    """Mean power per band over the consecutive frames of a whole signal in one row.

    The last frame is padded with silence.
    """

    @F.arrow_udf("array<double>")
    def energy(values: pa.Array, rates: pa.Array) -> pa.Array:
        out = np.zeros((len(values), len(limits)))
        for at, rows, rate in _frames_by_shape(values, rates):
            freqs = np.fft.rfftfreq(n_fft, d=1.0 / rate)
            member = np.array([(freqs >= low) & (freqs < high) for low, high in limits], dtype=float)
            count = max(1, -(-rows.shape[1] // n_fft))
            cut = fit_length(rows, count * n_fft).reshape(-1, n_fft)
            out[at] = (_power(cut, n_fft) @ member.T).reshape(len(rows), count, -1).mean(axis=1)
        return _lists(out)

    return energy(samples, sr)


def gcc_phat(first: Column | str, second: Column | str, max_shift: Column) -> Column:
    """Delay in samples between two signals, positive when ``first`` lags.

    ``max_shift`` limits the search; null searches everything.
    """

    @F.arrow_udf("int")
    def delay(a: pa.Array, b: pa.Array, limit: pa.Array) -> pa.Array:
        return gcc_phat_batch(a, b, limit)

    return delay(first, second, max_shift.cast("int"))


def gcc_phat_batch(first: pa.Array, second: pa.Array, limit: pa.Array) -> pa.Array:
    la, lb = (np.asarray(x.value_lengths()) for x in (first, second))
    fa, fb = (np.asarray(x.flatten(), dtype=np.float64) for x in (first, second))
    sa, sb = (np.concatenate([[0], np.cumsum(x)])[:-1] for x in (la, lb))
    bounds = np.asarray(limit.fill_null(-1))
    out = np.zeros(len(la), dtype=np.int32)
    for n, m in np.unique(np.stack([la, lb], axis=1), axis=0):
        rows = np.flatnonzero((la == n) & (lb == m))
        size = 1 << int(np.ceil(np.log2(n + m - 1)))
        x = np.fft.rfft(fa[sa[rows][:, None] + np.arange(n)], n=size, axis=1)
        y = np.fft.rfft(fb[sb[rows][:, None] + np.arange(m)], n=size, axis=1)
        cross = x * np.conj(y)
        cross /= np.maximum(np.abs(cross), 1e-10)
        strength = np.abs(np.fft.fftshift(np.fft.irfft(cross, n=size, axis=1), axes=1))
        lags = np.arange(size) - size // 2
        reach = np.where(bounds[rows] < 0, size, bounds[rows])
        strength[np.abs(lags)[None, :] > reach[:, None]] = -1.0
        out[rows] = lags[np.argmax(strength, axis=1)]
    return pa.array(out)
