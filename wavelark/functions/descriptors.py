"""Descriptors of spectra: published definitions as small matrix products."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def cached(build: Callable) -> Callable:
    """Remember results by argument; unlike library caches it travels with a task."""
    made: dict[tuple, np.ndarray] = {}

    def get(*args) -> np.ndarray:
        if args not in made:
            made[args] = build(*args)
        return made[args]

    return get


def hz_to_mel(hz: np.ndarray) -> np.ndarray:
    """Auditory-toolbox scale: linear below 1 kHz, logarithmic above."""
    hz = np.asarray(hz, dtype=float)
    step = np.log(6.4) / 27.0
    return np.where(hz < 1000, hz * 3 / 200, 15 + np.log(np.maximum(hz, 1000) / 1000) / step)


def mel_to_hz(mel: np.ndarray) -> np.ndarray:
    mel = np.asarray(mel, dtype=float)
    step = np.log(6.4) / 27.0
    return np.where(mel < 15, mel * 200 / 3, 1000 * np.exp(step * (mel - 15)))


@cached
def mel_matrix(sr: int, n_fft: int, n_mels: int = 128) -> np.ndarray:
    """Triangles of equal area between neighbouring mel centres (mels × bins)."""
    edges = mel_to_hz(np.linspace(0, hz_to_mel(sr / 2), n_mels + 2))
    freqs = np.fft.rfftfreq(n_fft, 1.0 / sr)
    rising = (freqs - edges[:-2, None]) / (edges[1:-1] - edges[:-2])[:, None]
    falling = (edges[2:, None] - freqs) / (edges[2:] - edges[1:-1])[:, None]
    area = 2.0 / (edges[2:] - edges[:-2])
    return np.maximum(0, np.minimum(rising, falling)) * area[:, None]


@cached
def dct_matrix(n_out: int, n_in: int) -> np.ndarray:
    """Orthonormal DCT-II (outputs × inputs)."""
    k, i = np.arange(n_out)[:, None], np.arange(n_in)[None, :]
    basis = np.cos(np.pi * k * (2 * i + 1) / (2 * n_in)) * np.sqrt(2.0 / n_in)
    basis[0] /= np.sqrt(2.0)
    return basis


@cached
def chroma_matrix(sr: int, n_fft: int) -> np.ndarray:
    """Each bin's nearest pitch class, C first, from 27.5 Hz up (12 × bins)."""
    freqs = np.fft.rfftfreq(n_fft, 1.0 / sr)
    member = np.zeros((12, len(freqs)))
    heard = np.flatnonzero(freqs >= 27.5)
    note = np.round(12 * np.log2(freqs[heard] / 440.0)).astype(int) + 9
    member[note % 12, heard] = 1.0
    return member


@cached
def tonal_matrix() -> np.ndarray:
    """Pitch classes on the circles of fifths, minor and major thirds (6 × 12)."""
    note = np.arange(12)
    rows = []
    for radius, turn in ((1.0, 7 / 6), (1.0, 3 / 2), (0.5, 2 / 3)):
        rows += [radius * np.sin(np.pi * turn * note), radius * np.cos(np.pi * turn * note)]
    return np.array(rows)


def decibels(power: np.ndarray) -> np.ndarray:
    return 10 * np.log10(np.maximum(power, 1e-10))


def chroma(power: np.ndarray, sr: int, n_fft: int) -> np.ndarray:
    raw = power @ chroma_matrix(sr, n_fft).T
    return raw / np.maximum(raw.max(axis=1, keepdims=True), 1e-10)


def tonnetz(chroma_rows: np.ndarray) -> np.ndarray:
    share = chroma_rows / np.maximum(np.abs(chroma_rows).sum(axis=1, keepdims=True), 1e-10)
    return share @ tonal_matrix().T


def middle(values: np.ndarray) -> np.ndarray:
    """Median over the last axis, whose length is odd."""
    half = values.shape[-1] // 2
    return np.partition(values, half, axis=-1)[..., half]


def harmonic_power(magnitude: np.ndarray, own: slice, first: int, total: int, width: int = 31) -> np.ndarray:
    """Power of the part that is steady over time rather than spread over bins.

    ``magnitude`` rows are frames ``first, first+1, …`` of a recording of
    ``total`` frames; frames beyond its ends are mirrored.
    """
    half = width // 2
    frames = np.arange(first + own.start, first + own.stop)
    places = frames[:, None] + np.arange(-half, half + 1)
    places = np.where(places < 0, -places - 1, places)
    places = np.where(places >= total, 2 * total - 1 - places, places)
    places = np.clip(places, 0, total - 1) - first
    picked = magnitude[np.clip(places, 0, len(magnitude) - 1)]
    steady = middle(np.moveaxis(picked, 1, 2))
    here = magnitude[own]
    padded = np.pad(here, ((0, 0), (half, half)), mode="symmetric" if here.shape[1] > half else "edge")
    spread = middle(np.lib.stride_tricks.sliding_window_view(padded, width, axis=1))
    mask = steady**2 / np.maximum(steady**2 + spread**2, 1e-20)
    return (here * mask) ** 2


def contrast(magnitude: np.ndarray, sr: int, n_fft: int, bands: int = 6, lowest: float = 200.0, share: float = 0.02) -> np.ndarray:
    """Peak minus valley in dB for the octaves above ``lowest`` and the rest below."""
    freqs = np.fft.rfftfreq(n_fft, 1.0 / sr)
    edges = np.concatenate([[0], lowest * 2.0 ** np.arange(bands + 1)])
    out = np.zeros((len(magnitude), bands + 1))
    for i, (low, high) in enumerate(zip(edges[:-1], edges[1:])):
        last = i == bands
        part = magnitude[:, (freqs >= low) & ((freqs < high) | last)]
        if part.shape[1] == 0:
            continue
        ordered = np.sort(part, axis=1)
        k = max(1, int(round(share * ordered.shape[1])))
        out[:, i] = decibels(ordered[:, -k:].mean(axis=1)) - decibels(ordered[:, :k].mean(axis=1))
    return out


def shape(magnitude: np.ndarray, sr: int, n_fft: int) -> dict[str, np.ndarray]:
    """Centroid, bandwidth, rolloff (85 %) and flatness per frame."""
    freqs = np.fft.rfftfreq(n_fft, 1.0 / sr)
    total = magnitude.sum(axis=1)
    safe = np.where(total > 0, total, 1.0)
    centroid = magnitude @ freqs / safe
    deviation = (freqs[None, :] - centroid[:, None]) ** 2
    bandwidth = np.sqrt((magnitude * deviation).sum(axis=1) / safe)
    reached = np.cumsum(magnitude, axis=1) >= 0.85 * total[:, None]
    power = np.maximum(magnitude**2, 1e-10)
    return {
        "centroid": centroid,
        "bandwidth": bandwidth,
        "rolloff": freqs[reached.argmax(axis=1)],
        "flatness": np.exp(np.log(power).mean(axis=1)) / power.mean(axis=1),
    }


def slope(rows: np.ndarray, places: np.ndarray, order: int = 1, half: int = 4) -> np.ndarray:
    """Least-squares slope (or second derivative) over ``2*half + 1`` rows.

    ``places`` (outputs × window) picks the neighbours of every output row.
    """
    x = np.arange(-half, half + 1, dtype=float)
    weights = np.linalg.pinv(np.vander(x, order + 1, increasing=True))[order]
    if order == 2:
        weights = 2 * weights
    return np.einsum("w,owf->of", weights, rows[places])
