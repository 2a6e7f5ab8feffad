"""Log-mel features: numpy kernels and the Arrow functions over them.

Frames aren't centred, windows are Hann, spectra are power, filters are triangles
on the mel scale, and the logarithm is natural with a floor.  All of it can be set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

FEATURES = "struct<data:array<float>,frames:int,dim:int>"
#: Samples at the model's rate to rows of features.
Extractor = Callable[[np.ndarray], np.ndarray]


@dataclass(frozen=True)
class MelOptions:
    rate: int = 16000
    bins: int = 80
    fft: int = 400
    hop: int = 160
    low: float = 0.0
    high: float | None = None
    floor: float = 1e-10
    power: float = 2.0
    precise: bool = False  # features in double


def to_mel(hertz):
    return 2595.0 * np.log10(1.0 + np.asarray(hertz, float) / 700.0)


def to_hertz(mel):
    return 700.0 * (10.0 ** (np.asarray(mel, float) / 2595.0) - 1.0)


@lru_cache(maxsize=16)
def filters(o: MelOptions) -> np.ndarray:
    """(fft / 2 + 1, bins): the weight of each frequency in each band."""
    edges = to_hertz(np.linspace(to_mel(o.low), to_mel(o.high or o.rate / 2), o.bins + 2))
    f = np.arange(o.fft // 2 + 1) * o.rate / o.fft
    up = (f[:, None] - edges[:-2]) / np.maximum(edges[1:-1] - edges[:-2], 1e-12)
    down = (edges[2:] - f[:, None]) / np.maximum(edges[2:] - edges[1:-1], 1e-12)
    return np.maximum(0, np.minimum(up, down))


@lru_cache(maxsize=16)
def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / max(1, n - 1))


def mel_spectrogram(samples: np.ndarray, o: MelOptions = MelOptions()) -> np.ndarray:
    """(frames, bins); no frames for a signal shorter than one window."""
    x = np.asarray(samples, float)
    if len(x) < o.fft:
        return np.zeros((0, o.bins), float if o.precise else np.float32)
    windows = np.lib.stride_tricks.sliding_window_view(x, o.fft)[:: o.hop]
    out = np.empty((len(windows), o.bins), float if o.precise else np.float32)
    for a in range(0, len(windows), 2048):  # bounds the copies of a long signal
        spectrum = np.abs(np.fft.rfft(windows[a : a + 2048] * hann(o.fft), axis=1)) ** o.power
        out[a : a + 2048] = np.log(np.maximum(spectrum @ filters(o), o.floor))
    return out


def whisper_features(samples: np.ndarray, bins: int = 80, frames: int = 3000, pad: float = 0.0, padded: bool = True, options: MelOptions | None = None) -> np.ndarray:
    """Exactly ``frames`` rows: cut, or filled with ``pad`` after the logarithm; fewer if not padded."""
    m = mel_spectrogram(samples, options or replace(MelOptions(), bins=bins))[:frames]
    bins = m.shape[1]
    if not padded:
        return m
    out = np.full((frames, bins), pad, np.float32)
    out[: len(m)] = m
    return out


def whisper_chunks(samples: np.ndarray, rate: int = 16000, overlap_frames: int = 0, bins: int = 80) -> list[np.ndarray]:
    """Features of windows of 30 seconds at 16 kHz, up to the first short one."""
    from tessitura.sources.wav import Audio, resample

    x = resample(Audio(np.asarray(samples, np.float32), rate), 16000).samples
    window, step = 3000 * 160, (3000 - overlap_frames) * 160
    if step <= 0:
        raise ValueError("windows must begin later than the ones before them")
    out, at = [], 0
    while at < len(x):
        out.append(whisper_features(x[at : at + window], bins))
        if len(x) - at < window:
            break
        at += step
    return out


def at_rate(samples, source: int | None, channels: int | None, rate: int) -> np.ndarray:
    """A signal of interleaved channels as a mono one of another rate."""
    from tessitura.sources.wav import Audio, resample, to_mono

    audio = Audio(np.asarray(samples, np.float32), int(source or rate), int(channels or 1))
    return resample(to_mono(audio), rate).samples


def mel_features(
    samples: Column | str, options: MelOptions = MelOptions(), whisper: bool = False, source: Column | int | None = None,
    channels: Column | int | None = None, extractor: Extractor | None = None,
) -> Column:
    """The features of a signal column, with their shape.

    ``source`` and ``channels``, for all rows or by row, are what the signal has: channels are
    averaged and the mean is resampled to the rate of the options.  ``extractor`` takes the place
    of the mel features.
    """

    @F.pandas_udf(FEATURES.replace("float", "double") if options.precise else FEATURES)
    def extract(signals: pd.Series, sources: pd.Series, widths: pd.Series) -> pd.DataFrame:
        rows = []
        own = lambda v: None if pd.isna(v) else int(v)
        for x, r, c in zip(signals, sources, widths, strict=True):
            if options.precise and own(r) in (None, options.rate) and own(c) in (None, 1):
                x = np.zeros(0) if x is None else x
            else:
                x = np.zeros(0, np.float32) if x is None else at_rate(x, own(r), own(c), options.rate)
            m = extractor(x) if extractor else whisper_features(x, options=options) if whisper else mel_spectrogram(x, options)
            rows.append((m.ravel(), m.shape[0], m.shape[1]))
        return pd.DataFrame(rows, columns=["data", "frames", "dim"])

    number = lambda v: (v if isinstance(v, Column) else F.lit(v)).cast("int")
    return extract(F.col(samples) if isinstance(samples, str) else samples, number(source), number(channels))
