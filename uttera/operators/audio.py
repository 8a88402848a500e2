"""Audio files: PCM decoding, resampling by a windowed sinc, coercion to one format, frame descriptors and functionals over them."""

from __future__ import annotations

import io
import math
import wave
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Zero crossings of the sinc on each side, and the part of the band that stays.
CROSSINGS, ROLLOFF = 32, 0.95
#: Values that are resampled at a time.
STEP = 8_192


@lru_cache(maxsize=32)
def _phases(up: int, down: int) -> tuple[np.ndarray, int]:
    """Filter taps of each of the `up` phases (a row each) and how many input values they reach back.

    A Kaiser-windowed sinc that passes what both rates can hold; each phase sums to 1, so a constant stays.
    """
    cutoff = ROLLOFF * min(1.0, up / down)
    reach = math.ceil(CROSSINGS / cutoff)
    t = np.arange(up)[:, None] / up - np.arange(-reach, reach + 1)[None]
    taps = cutoff * np.sinc(cutoff * t) * np.where(np.abs(t) <= reach, np.i0(10.0 * np.sqrt(np.maximum(0, 1 - (t / reach) ** 2))) / np.i0(10.0), 0.0)
    return taps / taps.sum(1, keepdims=True), reach


def resampled(x: np.ndarray, own: int, rate: int) -> np.ndarray:
    """x at another rate, without what the lower rate can't hold: ceil(n * rate / own) values. Values before and after the signal count as 0."""
    if own == rate or not len(x):
        return np.asarray(x, float)
    g = math.gcd(own, rate)
    up, down = rate // g, own // g
    taps, reach = _phases(up, down)
    n = -(-len(x) * up // down)
    at = np.arange(n) * down
    padded = np.concatenate([np.zeros(reach), x, np.zeros(reach + 1)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)
    out = np.empty(n)
    for start in range(0, n, STEP):  # bounded memory for long signals
        own_at = at[start : start + STEP]
        out[start : start + STEP] = np.einsum("ij,ij->i", windows[own_at // up], taps[own_at % up])
    return out


def samples(raw: bytes, duration: float | None = None) -> tuple[np.ndarray, int, int, int]:
    """Mono values in -1..1 of a PCM WAV of 8, 16, 24 or 32 bits, its rate, channels and bytes a value; `duration` reads its first seconds only."""
    with wave.open(io.BytesIO(raw)) as f:
        channels, width, rate = f.getnchannels(), f.getsampwidth(), f.getframerate()
        data = f.readframes(f.getnframes() if duration is None else min(f.getnframes(), round(duration * rate)))
    data = data[: len(data) // (channels * width) * (channels * width)]
    if width == 1:  # unsigned
        x = (np.frombuffer(data, np.uint8).astype(float) - 128) / 128
    elif width == 3:
        b = np.frombuffer(data, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2**23
    else:
        x = np.frombuffer(data, {2: "<i2", 4: "<i4"}[width]).astype(float) / 2 ** (8 * width - 1)
    return x.reshape(-1, channels).mean(1), rate, channels, width


def decoded(raw: bytes, rate: int = 16_000, duration: float | None = None) -> np.ndarray:
    """PCM WAV bytes to mono samples in -1..1 at `rate`."""
    x, own, *_ = samples(raw, duration)
    return np.clip(resampled(x, own, rate), -1, 1)


def wav_bytes(x: np.ndarray, rate: int = 16_000) -> bytes:
    """PCM16 mono WAV."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes(np.clip(np.round(np.asarray(x, float) * 32768), -32768, 32767).astype("<i2").tobytes())
    return out.getvalue()


def coerced(raw: bytes, rate: int = 16_000) -> bytes:
    """The file as PCM16 mono at `rate`; one that is that already stays byte for byte."""
    x, own, channels, width = samples(raw)
    return raw if (own, channels, width) == (rate, 1, 2) else wav_bytes(np.clip(resampled(x, own, rate), -1, 1), rate)


def _tried(fn, raw: bytes):
    """fn's result, or null where the bytes are no PCM WAV."""
    try:
        return fn(raw)
    except (wave.Error, EOFError, KeyError, ValueError):
        return None


def decoded_column(wav: Column, rate: int = 16_000, duration: float | None = None) -> Column:
    """Samples of a column of WAV files; null where the bytes are no PCM WAV."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda v: None if v is None else _tried(lambda raw: decoded(raw, rate, duration), v))

    return run(wav)


def coerced_column(wav: Column, rate: int = 16_000) -> Column:
    """Files in one format; null where the bytes are no PCM WAV."""

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda v: None if v is None else _tried(lambda raw: coerced(raw, rate), v))

    return run(wav)


# ---- frame descriptors ----------------------------------------------------------------------------------------

#: Names of the descriptors of a frame.
DESCRIPTORS = ("pitch", "voicing", "energy_db", "zero_crossings", "centroid", "rolloff", "flux", "formant1", "formant2", "formant3")


def _frames(x: np.ndarray, size: int, hop: int) -> np.ndarray:
    if len(x) < size:
        x = np.pad(x, (0, size - len(x)))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def pitch(frames: np.ndarray, rate: int, low: float = 60.0, high: float = 500.0) -> tuple[np.ndarray, np.ndarray]:
    """Frequency and strength (0..1) of the highest peak of each frame's normalised autocorrelation between the two periods, refined by a parabola. Of peaks within a tenth the shortest period counts."""
    n = frames.shape[1]
    z = frames - frames.mean(1, keepdims=True)
    power = np.abs(np.fft.rfft(z, 2 * n, axis=1)) ** 2
    r = np.fft.irfft(power, axis=1)[:, :n]
    squares = np.cumsum(z * z, 1)
    total = squares[:, -1:]
    # energy of the two parts that are laid over each other at each lag
    left = np.concatenate([total, squares[:, -2::-1]], 1)
    right = total - np.concatenate([np.zeros((len(z), 1)), squares[:, :-1]], 1)
    r = r / np.maximum(1e-12, np.sqrt(np.maximum(0, left * right)))
    a, b = max(2, int(rate / high)), min(n - 2, int(rate / low) + 1)
    y0, y1, y2 = r[:, a - 1 : b], r[:, a : b + 1], r[:, a + 1 : b + 2]
    bend = np.minimum(y0 - 2 * y1 + y2, -1e-12)
    shift = np.clip((y0 - y2) / (2 * bend), -0.5, 0.5)
    height = np.where((y1 >= y0) & (y1 >= y2), y1 - (y0 - y2) ** 2 / (8 * bend), -1.0)
    top = height.max(1)
    k = np.where(top > 0, (height >= 0.9 * top[:, None]).argmax(1), y1.argmax(1))  # of nearly equal peaks, as multiples of a period are, the shortest
    rows = np.arange(len(z))
    return rate / (k + a + shift[rows, k]), np.clip(np.where(total[:, 0] > 1e-10, np.maximum(top, y1[rows, k]), 0.0), 0, 1)


def predictors(frames: np.ndarray, order: int) -> np.ndarray:
    """Linear prediction polynomials (1 first) of all frames by Levinson's recursion over their autocorrelations."""
    n = frames.shape[1]
    power = np.abs(np.fft.rfft(frames, 2 * n, axis=1)) ** 2
    r = np.fft.irfft(power, axis=1)[:, : order + 1]
    r[:, 0] = r[:, 0] * (1 + 1e-9) + 1e-12
    a = np.zeros((len(frames), order + 1))
    a[:, 0], error = 1, r[:, 0].copy()
    for i in range(1, order + 1):
        k = -(a[:, :i] * r[:, i:0:-1]).sum(1) / error
        a[:, 1 : i + 1] = a[:, 1 : i + 1] + k[:, None] * a[:, i - 1 :: -1][:, :i]
        error = error * (1 - k * k)
    return a


def formants(frames: np.ndarray, rate: int, count: int = 3) -> np.ndarray:
    """The lowest resonances under 5 kHz of each frame (window and pre-emphasis inside), NaN where there are fewer."""
    z = np.concatenate([frames[:, :1], frames[:, 1:] - 0.97 * frames[:, :-1]], 1) * np.hamming(frames.shape[1])
    out = np.full((len(frames), count), np.nan)
    for i, p in enumerate(predictors(z, 2 + rate // 1000)):
        roots = np.roots(p)
        roots = roots[roots.imag > 0]
        hz, width = np.angle(roots) * rate / (2 * np.pi), -np.log(np.maximum(1e-12, np.abs(roots))) * rate / np.pi
        found = np.sort(hz[(hz > 90) & (hz < 5000) & (width < 400)])[:count]
        out[i, : len(found)] = found
    return out


def descriptors(x: np.ndarray, rate: int = 16_000, size: float = 0.04, hop: float = 0.01) -> np.ndarray:
    """Frames by DESCRIPTORS; pitch is NaN in frames that aren't voiced."""
    f = _frames(np.asarray(x, float), round(size * rate), round(hop * rate))
    hz, strength = pitch(f, rate)
    spectrum = np.abs(np.fft.rfft(f * np.hanning(f.shape[1]), axis=1))
    bins = np.fft.rfftfreq(f.shape[1], 1 / rate)
    whole = np.maximum(1e-12, spectrum.sum(1))
    power = np.cumsum(spectrum**2, 1)
    unit = spectrum / np.maximum(1e-12, np.linalg.norm(spectrum, axis=1, keepdims=True))
    flux = np.concatenate([[0.0], np.linalg.norm(np.diff(unit, axis=0), axis=1)])
    crossings = (np.diff(np.signbit(f), axis=1) != 0).mean(1)
    energy = 10 * np.log10(np.maximum(1e-10, (f * f).mean(1)))
    rolloff = bins[(power >= 0.85 * power[:, -1:]).argmax(1)]
    return np.column_stack([np.where(strength > 0.45, hz, np.nan), strength, energy, crossings, (spectrum * bins).sum(1) / whole, rolloff, flux, formants(f, rate)])


def jitter(hz: np.ndarray) -> float:
    """Mean change of the period between neighbouring voiced frames against the mean period; 0 where there are no two."""
    period = 1 / hz
    steps = np.abs(np.diff(period))
    steps, known = steps[~np.isnan(steps)], period[~np.isnan(period)]
    return float(steps.mean() / known.mean()) if len(steps) else 0.0


#: Names of the functionals of each descriptor.
FUNCTIONALS = ("mean", "std", "min", "max", "p20", "p50", "p80", "slope")


def functionals(d: np.ndarray) -> np.ndarray:
    """FUNCTIONALS of each column over the rows that have it, zeros where none has; then the share of voiced rows and the jitter."""
    out = []
    for c in d.T:
        at = np.flatnonzero(~np.isnan(c))
        v = c[at]
        if not len(v):
            out.append(np.zeros(len(FUNCTIONALS)))
            continue
        t = at - at.mean()
        slope = (t @ (v - v.mean())) / (t @ t) if len(v) > 1 else 0.0
        out.append(np.array([v.mean(), v.std(), v.min(), v.max(), *np.percentile(v, [20, 50, 80]), slope]))
    voiced = ~np.isnan(d[:, 0])
    return np.concatenate([*out, [voiced.mean() if len(d) else 0.0, jitter(d[:, 0]) if len(d) else 0.0]])


FEATURES = [f"{d}_{f}" for d in DESCRIPTORS for f in FUNCTIONALS] + ["voiced_share", "jitter"]


def functionals_column(wave_: Column, rate: int = 16_000) -> Column:
    """One vector of FEATURES for each signal."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda v: None if v is None else functionals(descriptors(np.asarray(v, float), rate)))

    return run(wave_)


def descriptor_rows(df: DataFrame, id_: str, signal: str, rate: int = 16_000) -> DataFrame:
    """A row for each frame: id, frame, and a column for each descriptor; unvoiced pitch and missing formants are null."""
    kind = dict(df.dtypes)[id_]

    @F.pandas_udf("array<array<double>>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda v: None if v is None else [[None if math.isnan(u) else float(u) for u in row] for row in descriptors(np.asarray(v, float), rate)])

    rows = df.select(F.col(id_).cast(kind), F.posexplode(run(F.col(signal))).alias("frame", "_d"))
    return rows.select(id_, "frame", *[F.col("_d")[i].alias(name) for i, name in enumerate(DESCRIPTORS)])
