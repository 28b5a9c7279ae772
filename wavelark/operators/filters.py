"""Band-pass, noise reduction and source separation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavelark.functions import stft
from wavelark.operators.blocks import KEY, stft_blocks, sum_arrays
from wavelark.operators.framing import frames, overlap_add
from wavelark.session import materialise


def butterworth_response(freqs: np.ndarray, sr: float, low: float, high: float, order: int) -> np.ndarray | None:
    """Complex response of a digital Butterworth band-pass (bilinear design).

    Cut-offs relative to Nyquist are kept within [0.001, 0.999]; None when they
    are inverted.
    """
    nyquist = sr / 2
    low, high = max(low / nyquist, 0.001), min(high / nyquist, 0.999)
    if low >= high:
        return None
    warp = lambda f: np.tan(np.pi * f / 2)
    w1, w2 = warp(low), warp(high)
    s = 1j * np.tan(np.pi * freqs / sr)
    with np.errstate(divide="ignore", invalid="ignore"):
        prototype = (s * s + w1 * w2) / (s * (w2 - w1))
    angles = np.pi * (2 * np.arange(1, order + 1) + order - 1) / (2 * order)
    response = np.ones_like(s)
    for pole in np.exp(1j * angles):
        response = response / (prototype - pole)
    return np.where(np.isfinite(response), response, 0)


def response_length(sr: Column, low: float, high: float, order: int, tolerance: float) -> Column:
    """Samples after which the impulse response stays below ``tolerance`` of its start.

    The slowest poles of a Butterworth band-pass decay with the sine of their
    angle times the lower edge, or half the width where that is less.
    """
    nyquist = sr / 2
    w1 = F.tan(np.pi / 2 * F.greatest(low / nyquist, F.lit(0.001)))
    w2 = F.tan(np.pi / 2 * F.least(high / nyquist, F.lit(0.999)))
    decay = 2 * np.sin(np.pi / (2 * order)) * F.least(w1, (w2 - w1) / 2)
    length = F.ceil(F.lit(1.5 * np.log(1 / tolerance)) / F.when(decay > 0, decay).otherwise(1.0)) + 2 * order
    return length.cast("int")


def impulse_response(sr: int, low: float, high: float, order: int, taps: int) -> np.ndarray | None:
    size = max(1 << 18, 1 << int(np.ceil(np.log2(4 * taps))))
    freqs = np.fft.rfftfreq(size, d=1.0 / sr)
    freqs[-1] -= 1e-9  # the response at Nyquist itself is 0
    response = butterworth_response(freqs, sr, low, high, order)
    return None if response is None else np.fft.irfft(response, n=size)[:taps]


def bandpass(
    signals: DataFrame, low: float | None = 50.0, high: float | None = 16000.0, order: int = 5,
    tolerance: float = 1e-9, block: int = 16384,
) -> DataFrame:
    """Butterworth band-pass as overlap-save convolution.

    The recursive filter is replaced by its impulse response, cut per rate where
    it has fallen to ``tolerance`` of its start; a block only needs as many
    samples before it.
    """
    if low is None or high is None:
        return signals
    taps = response_length(F.col("sr"), low, high, order, tolerance)
    blocks = frames(
        signals.withColumn("_taps", taps), F.col("_taps") + (block - 1), block, F.ceil(F.col("n_total") / block),
        F.col("_taps") - 1, keep=["_taps"],
    )

    @F.pandas_udf("array<double>")
    def convolve(samples: pd.Series, sr: pd.Series, length: pd.Series) -> pd.Series:
        kernels: dict[int, tuple[int, np.ndarray | None]] = {}
        out = []
        for x, rate, taps in zip(samples, sr, length):
            if rate not in kernels:
                size = 1 << int(np.ceil(np.log2(block + 2 * taps)))
                h = impulse_response(int(rate), low, high, order, int(taps))
                kernels[rate] = size, None if h is None else np.fft.rfft(h, n=size)
            size, kernel = kernels[rate]
            x = np.asarray(x)
            if kernel is None:
                out.append(x[taps - 1 :])
                continue
            y = np.fft.irfft(np.fft.rfft(x, n=size) * kernel, n=size)
            out.append(y[taps - 1 : taps - 1 + block])
        return pd.Series(out)

    start = F.col("frame_idx") * block
    own = F.least(F.lit(block).cast("long"), F.col("n_total") - start).cast("int")
    return blocks.select(
        "recording_id", "class_name", "channel", "sr", "n_total", start.alias("start"), own.alias("own"),
        F.slice(convolve("samples", "sr", "_taps"), 1, own).alias("samples"),
    )


def reduce_noise(
    signals: DataFrame, prop_decrease: float = 1.0, n_std: float = 1.5, n_fft: int = 2048, hop: int = 512
) -> DataFrame:
    """Spectral gate: bins near their usual level are turned down.

    The usual level of a bin is the mean of its dB values over the recording
    plus ``n_std`` deviations.  Blocks report sums and sums of squares; samples
    meet the thresholds in one join and are gated block by block.  Recordings
    shorter than a frame are padded to one.
    """
    blocks = stft_blocks(signals, n_fft, hop)

    def level(spectra: np.ndarray) -> np.ndarray:
        return 20 * np.log10(np.abs(spectra) + 1e-10)

    def spectra_of(samples, block: int, n_total: int) -> np.ndarray:
        all_frames = stft.transform(np.asarray(samples), n_fft, hop)
        left = n_total // hop + 1 - block * len(all_frames)
        return all_frames[: max(0, min(len(all_frames), left))]

    @F.pandas_udf("n array<double>, s array<double>, q array<double>")
    def sums(samples: pd.Series, block: pd.Series, n_total: pd.Series) -> pd.DataFrame:
        out = []
        for x, b, n in zip(samples, block, n_total):
            db = level(spectra_of(x, b, n))
            out.append((np.full(db.shape[1], float(len(db))), db.sum(axis=0), (db**2).sum(axis=0)))
        return pd.DataFrame(out, columns=["n", "s", "q"])

    @F.pandas_udf("samples array<double>, weight array<double>")
    def gate(samples: pd.Series, block: pd.Series, n_total: pd.Series, n: pd.Series, s: pd.Series, q: pd.Series) -> pd.DataFrame:
        out = []
        for x, b, total, count, first, second in zip(samples, block, n_total, n, s, q):
            count, first, second = map(np.asarray, (count, first, second))
            mean = first / count
            limit = mean + n_std * np.sqrt(np.maximum(second / count - mean**2, 0))
            spectra = spectra_of(x, b, total)
            kept = np.where(level(spectra) > limit, 1.0, 1.0 - prop_decrease)
            out.append(stft.inverse(spectra * kept, n_fft, hop))
        return pd.DataFrame(out, columns=["samples", "weight"])

    reported = blocks.select(*KEY, sums("samples", "block", "n_total").alias("r")).select(*KEY, "r.*")
    usual = sum_arrays(reported, KEY, ["n", "s", "q"])
    gated = blocks.join(usual, KEY).select(
        *KEY, "class_name", "sr", "n_total", "start",
        gate("samples", "block", "n_total", "n", "s", "q").alias("g"),
    )
    return overlap_add(gated.select(*KEY, "class_name", "sr", "n_total", "start", "g.*"))


#: Numbers of spectra held together.
STACKED = 1 << 21


def _activations(magnitude: np.ndarray, history: list[np.ndarray]) -> np.ndarray:
    """Row weights after one multiplicative step per dictionary in ``history``.

    Weights depend only on the row and the small dictionaries, so they are
    recomputed instead of being kept in a growing table.
    """
    weights = np.full((len(magnitude), history[0].shape[1]), 0.5)
    for w in history:
        weights *= (magnitude @ w) / np.maximum(weights @ (w.T @ w), 1e-12)
    return weights


def _stacked(
    samples: pd.Series, block: pd.Series, n_total: pd.Series, n_fft: int, hop: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(spectra of some blocks' frames, one below the other; frames of each block), up to ``STACKED`` numbers at a time."""
    if not len(samples):
        return
    per_block = (len(samples.iloc[0]) - n_fft) // hop + 1
    step = max(1, STACKED // (per_block * (n_fft // 2 + 1)))
    for at in range(0, len(samples), step):
        part = slice(at, at + step)
        x = np.stack(samples.iloc[part].to_list())
        left = n_total.iloc[part].to_numpy() // hop + 1 - block.iloc[part].to_numpy() * per_block
        count = np.clip(left, 0, per_block).astype(np.int64)
        cut = np.lib.stride_tricks.sliding_window_view(x, n_fft, axis=1)[:, ::hop]
        frames = cut[np.arange(per_block)[None, :] < count[:, None]]
        yield np.fft.rfft(frames * stft.hann(n_fft), axis=1), count


def fit_dictionary(
    signals: DataFrame, n_components: int = 2, iters: int = 50, seed: int = 42, n_fft: int = 2048, hop: int = 512,
    tolerance: float = 1e-4,
) -> tuple[np.ndarray, list[np.ndarray], list[float]]:
    """Spectral dictionary for the whole corpus by multiplicative updates.

    Returns the dictionary (bins × components), the dictionaries of all steps
    and the squared error before each; it stops once a step lowers the error by
    less than ``tolerance`` of itself, or after ``iters`` steps.  Blocks of
    samples are written once; every step adds up matrices of size bins ×
    components.
    """
    bins = n_fft // 2 + 1
    rng = np.random.default_rng(seed)
    history = [rng.uniform(0.1, 1.0, (bins, n_components))]
    losses: list[float] = []
    blocks = materialise(stft_blocks(signals, n_fft, hop).select("samples", "block", "n_total"))

    for _ in range(iters):
        steps = list(history)

        def partial(batches: Iterator[pd.DataFrame], steps=steps) -> Iterator[pd.DataFrame]:
            cross, gram, loss = np.zeros((bins, n_components)), np.zeros((n_components, n_components)), 0.0
            for batch in batches:
                for spectra, _ in _stacked(batch["samples"], batch["block"], batch["n_total"], n_fft, hop):
                    v = np.abs(spectra)
                    h = _activations(v, steps)
                    cross += v.T @ h
                    gram += h.T @ h
                    loss += ((v - h @ steps[-1].T) ** 2).sum()
            values = np.concatenate([cross.ravel(), gram.ravel(), [loss]])
            yield pd.DataFrame({"pos": np.arange(len(values)), "value": values})

        rows = blocks.mapInPandas(partial, "pos int, value double").groupBy("pos").agg(F.sum("value").alias("value"))
        total = np.array([r["value"] for r in sorted(rows.collect(), key=lambda r: r["pos"])])  # bins × components
        cross = total[: bins * n_components].reshape(bins, n_components)
        gram = total[bins * n_components : -1].reshape(n_components, n_components)
        losses.append(float(total[-1]))
        w = history[-1]
        history.append(w * cross / np.maximum(w @ gram, 1e-12))
        if len(losses) > 1 and losses[-2] - losses[-1] <= tolerance * losses[-2]:
            break
    return history[-1], history, losses


def separate(
    signals: DataFrame, history: list[np.ndarray], n_fft: int = 2048, hop: int = 512, together: bool = False
) -> DataFrame:
    """One signal per component, named ``<recording>_source_<i>``; with ``together`` their mixture, under its name.

    Components are ordered by the bin of their peak.  A source is its part of
    the modelled spectrum with the phase of the mixture.
    """
    w = history[-1]
    order = np.argsort(w.argmax(axis=0), kind="stable")
    k = w.shape[1]
    blocks = stft_blocks(signals, n_fft, hop)

    @F.pandas_udf("array<struct<source int, samples array<double>, weight array<double>>>")
    def split(samples: pd.Series, block: pd.Series, n_total: pd.Series) -> pd.Series:
        out = []
        for spectra, count in _stacked(samples, block, n_total, n_fft, hop):
            magnitude = np.abs(spectra)
            phase = spectra / np.maximum(magnitude, 1e-12)
            h = _activations(magnitude, history)
            end = np.cumsum(count)
            for at, n in zip(end - count, count):
                own = slice(at, at + n)
                row = []
                for place, c in enumerate([order] if together else order[:, None]):
                    part, weight = stft.inverse(h[own, c] @ w[:, c].T * phase[own], n_fft, hop)
                    row.append({"source": place, "samples": part, "weight": weight})
                out.append(row)
        return pd.Series(out)

    assert k == len(order)
    parts = blocks.select(
        *KEY, "class_name", "sr", "n_total", "start", F.explode(split("samples", "block", "n_total")).alias("p")
    )
    name = F.concat("recording_id", F.lit("_source_"), F.col("p.source").cast("string"))
    name = F.col("recording_id") if together else name
    return overlap_add(
        parts.select(
            name.alias("recording_id"), "channel", "class_name", "sr", "n_total", "start", "p.samples", "p.weight"
        )
    )
