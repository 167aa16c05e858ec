"""Kernels over arrays of samples: frame levels, crossings, pitch, spectrum and channel choice.

Levels are higher-order functions; pitch and spectrum need transforms and run as Arrow-batched pandas functions, a clip per row.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from clipweave.functions.arrays import dot

SILENCE_DB = -120.0


def rms(samples: Column) -> Column:
    """Root mean square; 0 for none."""
    return F.when(F.size(samples) > 0, F.sqrt(dot(samples, samples) / F.size(samples))).otherwise(0.0)


def dbfs(level: Column) -> Column:
    """A level in dB of full scale, at least SILENCE_DB."""
    return F.when(level > 1e-6, 20 * F.log10(level)).otherwise(SILENCE_DB)


def zero_crossing_rate(samples: Column) -> Column:
    """Sign changes per sample."""
    sign = F.transform(samples, lambda x: (x >= 0).cast("int"))
    pairs = F.zip_with(F.slice(sign, F.lit(2), F.greatest(F.size(sign) - 1, F.lit(0))), F.slice(sign, F.lit(1), F.greatest(F.size(sign) - 1, F.lit(0))), lambda a, b: F.abs(a - b))
    return F.when(F.size(samples) > 1, F.aggregate(pairs, F.lit(0), lambda s, x: s + x) / (F.size(samples) - 1)).otherwise(0.0)


def frames(samples: Column, size: int, hop: int) -> Column:
    """Whole frames of ``size`` samples every ``hop``."""
    n = F.floor((F.size(samples) - size) / F.lit(hop)).cast("int")
    return F.when(F.size(samples) >= size, F.transform(F.sequence(F.lit(0), n), lambda k: F.slice(samples, (k * hop + 1).cast("int"), F.lit(size)))).otherwise(F.array().cast("array<array<double>>"))


def frame_levels(samples: Column, size: int, hop: int) -> Column:
    """The rms of each frame."""
    return F.transform(frames(samples, size, hop), rms)


def silent_fraction(levels: Column, below: float = 0.01) -> Column:
    return F.when(F.size(levels) > 0, F.size(F.filter(levels, lambda x: x < below)) / F.size(levels)).otherwise(1.0)


def scorable(level: Column, silent: Column) -> Column:
    """A window with enough speech: silent share under 0.70 and level at least 0.02."""
    return (silent < 0.70) & (level >= 0.02)


def peaks(samples: Column, bins: int) -> Column:
    """The largest magnitude in each of ``bins`` runs; the first len % bins runs are one longer, as evenly as runs can be."""
    n = F.size(samples)
    q, r = F.floor(n / bins).cast("int"), (n % bins).cast("int")
    start = lambda k: k * q + F.least(k, r)
    return F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda k: F.coalesce(F.array_max(F.transform(F.slice(samples, (start(k) + 1).cast("int"), (q + (k < r).cast("int")).cast("int")), lambda x: F.abs(x))), F.lit(0.0)))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's of two channels: 1 if both are constant, 0 if one is."""
    n = F.least(F.size(a), F.size(b))
    mean = lambda x: F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / F.greatest(F.size(x), F.lit(1))
    centred = lambda x: F.transform(F.slice(x, F.lit(1), n), lambda v: v - mean(x))
    ca, cb = centred(a), centred(b)
    va, vb = dot(ca, ca), dot(cb, cb)
    return F.when((va <= 1e-12) & (vb <= 1e-12), 1.0).when((va <= 1e-12) | (vb <= 1e-12), 0.0).otherwise(dot(ca, cb) / F.sqrt(va * vb))


def choose_channel(left: Column, right: Column, matched: float = 0.98, dominant: float = 1.5) -> Column:
    """downmix, silent, left, right or prompt, by the channels' correlation and levels."""
    l, r = rms(left), rms(right)
    return (
        F.when((l <= 1e-6) & (r <= 1e-6), "silent").when(correlation(left, right) >= matched, "downmix")
        .when(l >= dominant * F.greatest(r, F.lit(1e-9)), "left").when(r >= dominant * F.greatest(l, F.lit(1e-9)), "right").otherwise("prompt")
    )


def crest_factor(levels_peak: Column, levels_rms: Column) -> Column:
    """The largest ratio of peak to rms over frames."""
    return F.array_max(F.zip_with(levels_peak, levels_rms, lambda p, r: F.when(r > 1e-9, p / r).otherwise(0.0)))


@pandas_udf(T.DoubleType())
def spectral_centroid(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """The mean frequency by magnitude, 0 for silence."""
    out = []
    for x, hz in zip(samples, rate, strict=True):
        x = np.asarray(x, float)
        m = np.abs(np.fft.rfft(x * np.hanning(len(x)))) if len(x) > 1 else np.zeros(1)
        f = np.fft.rfftfreq(len(x), 1 / hz) if len(x) > 1 else np.zeros(1)
        out.append(float((m * f).sum() / m.sum()) if m.sum() > 1e-12 else 0.0)
    return pd.Series(out)


@pandas_udf(T.DoubleType())
def pitch(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """The strongest period between 60 and 400 Hz by autocorrelation, 0 where there is none."""
    out = []
    for x, hz in zip(samples, rate, strict=True):
        x = np.asarray(x, float)
        x = x - x.mean() if len(x) else x
        lo, hi = int(hz // 400), min(int(hz // 60), len(x) - 1)
        if hi <= lo or not np.any(x):
            out.append(0.0)
            continue
        size = 1 << (2 * len(x) - 1).bit_length()
        f = np.fft.rfft(x, size)
        ac = np.fft.irfft(f * np.conj(f))[: hi + 1]
        k = lo + int(ac[lo : hi + 1].argmax())
        out.append(float(hz / k) if ac[k] > 0.3 * ac[0] else 0.0)
    return pd.Series(out)


@pandas_udf(T.ArrayType(T.DoubleType()))
def resample(samples: pd.Series, from_rate: pd.Series, to_rate: pd.Series) -> pd.Series:
    """Linear interpolation to another rate."""
    out = []
    for x, a, b in zip(samples, from_rate, to_rate, strict=True):
        x = np.asarray(x, float)
        n = max(1, round(len(x) * b / a)) if len(x) else 0
        out.append(np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x) if n else x)
    return pd.Series(out)


def crossings(samples: Column) -> Column:
    """Sign changes per pair of neighbours, where a change ends at zero or beyond."""
    n = F.greatest(F.size(samples) - 1, F.lit(0))
    change = F.zip_with(F.slice(samples, F.lit(1), n), F.slice(samples, F.lit(2), n), lambda a, b: (((a < 0) & (b >= 0)) | ((a > 0) & (b <= 0))).cast("int"))
    return F.aggregate(change, F.lit(0), lambda s, x: s + x) / F.greatest(n, F.lit(1))


def mean_of(values: Column) -> Column:
    return F.when(F.size(values) > 0, F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)).otherwise(0.0)


def _thinned(x: np.ndarray, hz: float) -> tuple[np.ndarray, float]:
    """At most about 4,000 samples, evenly taken, and their rate."""
    step = max(len(x) // 4000, 1)
    return x[::step], hz / step


@pandas_udf(T.ArrayType(T.DoubleType()))
def pitch_statistics(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Mean and deviation of the pitch over short frames, where one from 60 to 500 Hz is found; zeros where none is."""
    out = []
    for raw, hz in zip(samples, rate, strict=True):
        x, r = _thinned(np.asarray(raw, float), hz)
        size = max(int(r / 100), 32)
        found = np.empty(0)
        if len(raw) >= hz // 20 and len(x) > size:
            f = np.lib.stride_tricks.sliding_window_view(x, size)[:: max(size // 2, 16)][: -(-(len(x) - size) // max(size // 2, 16))]
            f = f[np.abs(f).max(1) >= 0.01]
            if len(f):
                spectrum = np.fft.rfft(f, 2 * size)
                lag = np.fft.irfft(np.abs(spectrum) ** 2)[:, 1:size].argmax(1) + 1
                found = r / lag
                found = found[(found >= 60) & (found <= 500)]
        out.append([float(found.mean()), float(found.std())] if len(found) else [0.0, 0.0])
    return pd.Series(out)


@pandas_udf(T.ArrayType(T.DoubleType()))
def spectrum_statistics(samples: pd.Series, rate: pd.Series) -> pd.Series:
    """Centroid and spread of the magnitude spectrum, zeros for silence."""
    out = []
    for raw, hz in zip(samples, rate, strict=True):
        x, r = _thinned(np.asarray(raw, float), hz)
        m = np.abs(np.fft.rfft(x * np.hanning(len(x)))) if len(x) >= 16 else np.zeros(1)
        f = np.fft.rfftfreq(len(x), 1 / r) if len(x) >= 16 else np.zeros(1)
        if m.sum() <= 1e-12:
            out.append([0.0, 0.0])
            continue
        c = float((m * f).sum() / m.sum())
        out.append([c, float(np.sqrt((m * (f - c) ** 2).sum() / m.sum()))])
    return pd.Series(out)


@pandas_udf(T.DoubleType())
def spectral_flatness(samples: pd.Series) -> pd.Series:
    """Median over frames of the geometric over the arithmetic mean of the power spectrum; 1 for fewer than 256 samples."""
    out = []
    for raw in samples:
        x = np.asarray(raw, float)
        if len(x) < 256:
            out.append(1.0)
            continue
        size = min(2048, max(512, len(x)))
        x = np.pad(x, size // 2)
        f = np.lib.stride_tricks.sliding_window_view(x, size)[:: max(size // 4, 128)]
        p = np.maximum(np.abs(np.fft.rfft(f * np.hanning(size))) ** 2, 1e-10)
        out.append(float(np.median(np.exp(np.log(p).mean(1)) / p.mean(1))))
    return pd.Series(out)


def rate_proxy(samples: Column, rate: int) -> Column:
    """Peaks of frame level per second: frames no quieter than their neighbours and 1.35 times the median."""
    size = max(rate // 50, 1)
    levels = frame_levels(samples, size, max(size // 2, 1))

    def count(e: Column) -> Column:
        ordered = F.array_sort(e)
        n = F.size(e)
        middle = (F.get(ordered, F.floor((n - 1) / 2).cast("int")) + F.get(ordered, F.floor(n / 2).cast("int"))) / 2
        least = F.greatest(middle * 1.35, F.lit(0.01))
        at = F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1)))
        top = F.filter(at, lambda k: (F.get(e, k) >= least) & (F.get(e, k) >= F.get(e, k - 1)) & (F.get(e, k) >= F.get(e, k + 1)))
        return F.when(n >= 3, F.size(top) / F.greatest(F.size(samples) / F.lit(float(rate)), F.lit(0.001))).otherwise(0.0)

    return F.transform(F.array(levels), count)[0]


def signature(samples: Column, rate: int, segments: int = 6) -> Column:
    """A clip's acoustic signature: level, mean magnitude, mean step, crossings, peak, pitch (mean, deviation), spectrum (centroid, spread), speaking
    rate, and per equal segment its level, crossings and pitch. Levels are built-in functions; pitch and spectrum run on Arrow batches."""
    n = F.size(samples)
    steps = F.zip_with(F.slice(samples, F.lit(2), F.greatest(n - 1, F.lit(0))), F.slice(samples, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda b, a: F.abs(b - a))
    hz = F.lit(float(rate))
    p, s = pitch_statistics(samples, hz), spectrum_statistics(samples, hz)
    head = [rms(samples), mean_of(F.transform(samples, lambda x: F.abs(x))), mean_of(steps), crossings(samples), F.coalesce(F.array_max(F.transform(samples, lambda x: F.abs(x))), F.lit(0.0)), p[0], p[1], s[0], s[1], rate_proxy(samples, rate)]
    for k in range(segments):
        lo, hi = F.floor(k * n / segments), F.floor((k + 1) * n / segments)
        part = F.slice(samples, (lo + 1).cast("int"), (hi - lo).cast("int"))
        head += [rms(part), crossings(part), pitch_statistics(part, hz)[0]]
    return F.array(*head)


def energised(samples: Column, size: int, hop: int, speech_rms: Column) -> Column:
    """The frames of a gap that are loud enough to analyse, end to end."""
    least = F.greatest(speech_rms * 0.03, F.lit(1e-5))
    return F.flatten(F.filter(frames(samples, size, hop), lambda f: rms(f) >= least))


def breath(samples: Column, rate: int, shortest: float = 0.15, longest: float = 0.6, quiet: float = 0.002, loud: float = 0.05) -> Column:
    """Whether a gap sounds like a breath: by length, level and a level that isn't constant over frames of 20 ms."""
    seconds, level = F.size(samples) / F.lit(float(rate)), rms(samples)
    size = max(1, rate // 50)
    e = frame_levels(samples, size, size)
    spread = F.transform(F.array(e), lambda x: F.sqrt(mean_of(F.transform(x, lambda v: (v - mean_of(x)) * (v - mean_of(x))))))[0]
    return seconds.between(shortest, longest) & level.between(quiet, loud) & ((F.size(e) < 2) | (spread > 1e-5))
