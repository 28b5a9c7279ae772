"""Small NumPy helpers for a block of frames, used inside Arrow batches."""

from __future__ import annotations

import numpy as np


def hann(n: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def transform(samples: np.ndarray, n_fft: int, hop: int) -> np.ndarray:
    """Complex spectra, one row per frame."""
    cut = np.lib.stride_tricks.sliding_window_view(samples, n_fft)[::hop]
    return np.fft.rfft(cut * hann(n_fft), axis=1)


def inverse(spectra: np.ndarray, n_fft: int, hop: int) -> tuple[np.ndarray, np.ndarray]:
    """Overlap-added samples of a block and the window power under them."""
    window = hann(n_fft)
    frames = np.fft.irfft(spectra, n=n_fft, axis=1) * window
    size = (len(frames) - 1) * hop + n_fft
    samples, weight = np.zeros(size), np.zeros(size)
    for i, frame in enumerate(frames):
        samples[i * hop : i * hop + n_fft] += frame
        weight[i * hop : i * hop + n_fft] += window**2
    return samples, weight
