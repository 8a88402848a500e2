"""Kernels on sequences of numbers, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """body(value) with the value computed once, also where body uses it for each element of an array."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def total(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def mean(x: Column) -> Column:
    """Null for an empty array."""
    return F.try_divide(total(x), F.size(x))


def std(x: Column) -> Column:
    """Population standard deviation."""
    return let(mean(x), lambda m: F.sqrt(F.try_divide(total(F.transform(x, lambda v: (v - m) * (v - m))), F.size(x))))


def cmvn(x: Column, m: Column, s: Column, only_mean: bool = False) -> Column:
    return F.transform(x, lambda v: v - m if only_mean else (v - m) / (s + 1e-8))


def voiced(x: Column, m: Column, s: Column, alpha: float = 1.0, least: int = 5) -> Column:
    """Frames with energy over mean - alpha * std; all frames where fewer than `least` are."""
    kept = let(m - alpha * s, lambda floor: F.filter(x, lambda v: v > floor))
    return let(kept, lambda k: F.when(F.size(k) < least, x).otherwise(k))


def without_edges(x: Column, skip: int) -> Column:
    return F.filter(x, lambda v, i: (i >= skip) & (i < F.size(x) - skip))


def rms_normalised(x: Column, target: float = 0.1, eps: float = 1e-8) -> Column:
    """Scaled to a root mean square of `target`; then, where the peak is over 1, scaled to a peak of 1.

    eps is added to the mean square, so a nearly silent signal stays nearly silent. An empty array stays empty.
    """
    gain = F.try_divide(F.lit(target), F.sqrt(F.try_divide(total(F.transform(x, lambda v: v * v)), F.size(x)) + eps))
    scaled = let(gain, lambda g: F.transform(x, lambda v: v * g))
    limited = lambda y: let(F.array_max(F.transform(y, lambda v: F.abs(v))), lambda peak: F.when(peak > 1, F.transform(y, lambda v: v / peak)).otherwise(y))
    return F.when(F.size(x) == 0, x).otherwise(let(scaled, limited))


def trimmed(x: Column, top_db: float = 30.0, frame: int = 1, hop: int = 1) -> Column:
    """Without what comes before the first and after the last loud frame.

    Frames of `frame` values, centred on every hop-th value and filled with zeros at both ends, are loud where their
    mean square is less than top_db under the largest. With the defaults each value is a frame. A silent signal stays whole.
    """
    n, half = F.size(x), frame // 2
    part = lambda at: F.slice(x, F.greatest(F.lit(1), at - half + 1), F.least(n, at - half + frame) - F.greatest(F.lit(0), at - half))
    power = F.transform(F.sequence(F.lit(0), F.floor((n - frame % 2) / hop).cast("int")), lambda k: total(F.transform(part(k * hop), lambda v: v * v)) / frame)
    floor = lambda p: F.greatest(F.lit(1e-10), F.array_max(p)) * (10 ** (-top_db / 10))
    loud = let(power, lambda p: let(floor(p), lambda low: F.filter(F.transform(p, lambda v, k: F.when(F.greatest(F.lit(1e-10), v) > low, k)), lambda k: k.isNotNull())))
    cut = lambda at: F.slice(x, F.array_min(at) * hop + 1, F.least(n, (F.array_max(at) + 1) * hop) - F.array_min(at) * hop)
    return F.when(n == 0, x).otherwise(let(loud, cut))


def segments(x: Column, spans: Column, rate: int) -> Column:
    """The parts of x inside (start, end) seconds, rounded to samples (ties to even), clamped, joined; x where nothing is left."""
    n = F.size(x)
    at = lambda t: F.greatest(F.lit(0), F.least(n, F.bround(t * rate).cast("int")))
    parts = F.flatten(F.transform(spans, lambda s: F.slice(x, at(s["start"]) + 1, F.greatest(F.lit(0), at(s["end"]) - at(s["start"])))))
    return F.when(F.size(parts) == 0, x).otherwise(parts)


#: Preprocessing modes: whether silence is trimmed, speech segments are kept, the level is normalised.
PREPROCESSING = {"raw": (False, False, False), "trim": (True, False, False), "trim_rms": (True, False, True), "vad": (False, True, False), "vad_rms": (False, True, True)}


def preprocessed(x: Column, mode: str, spans: Column | None = None, rate: int = 16_000, frame: int = 2048, hop: int = 512) -> Column:
    """x by a mode of PREPROCESSING; an unknown one raises. vad needs the speech spans (start, end in seconds) that a model gave.

    A signal of which nothing would be left stays whole.
    """
    if mode not in PREPROCESSING:
        raise ValueError(f"unknown preprocessing {mode}; known are {sorted(PREPROCESSING)}")
    trim, vad, rms = PREPROCESSING[mode]
    if vad and spans is None:
        raise ValueError(f"{mode} needs speech spans")
    y = trimmed(x, 30.0, frame, hop) if trim else segments(x, spans, rate) if vad else x
    y = let(y, lambda v: F.when(F.size(v) == 0, x).otherwise(v)) if trim or vad else y
    return let(y, lambda v: rms_normalised(v)) if rms else y


def delta(x: Column, width: int = 9, order: int = 1, edges: bool = False) -> Column:
    """Derivative of the regression line (order 1) or parabola (order 2) over `width` frames, for the frames with a whole window.

    With `edges` the first and last windows' values also stand for the frames before and after. Shorter sequences give an empty array.
    """
    h = width // 2
    s0, s2, s4 = width, 2 * sum(k**2 for k in range(1, h + 1)), 2 * sum(k**4 for k in range(1, h + 1))
    weight = {1: lambda k: k / s2, 2: lambda k: 2 * (s0 * k * k - s2) / (s0 * s4 - s2 * s2)}[order]
    value = lambda i: sum((F.get(x, i + k) * float(weight(k)) for k in range(-h, h + 1) if weight(k)), F.lit(0.0))
    inner = F.when(F.size(x) >= width, F.transform(F.sequence(F.lit(h), F.greatest(F.lit(h), F.size(x) - 1 - h)), value)).otherwise(F.array().cast("array<double>"))
    if not edges:
        return inner
    ends = lambda y, at: F.array_repeat(F.element_at(y, at), h)
    return let(inner, lambda y: F.when(F.size(y) == 0, y).otherwise(F.concat(ends(y, 1), y, ends(y, -1))))


def chunks(x: Column, size: int, hop: int, padded: bool, overlapping_stride: bool = False) -> Column:
    """Array of (start, vec). Starts run by `hop` up to the first chunk that needs padding, which is the last.

    padded keeps that last chunk, filled with zeros; otherwise only whole chunks come. overlapping_stride
    steps by hop - 1 and keeps, of chunks with one number start // hop, the last.
    """
    if size < 1 or hop < (2 if overlapping_stride else 1):
        raise ValueError("size and hop must be positive")
    n, step = F.size(x), hop - 1 if overlapping_stride else hop
    starts = F.when(n > 0, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(step))).otherwise(F.array().cast("array<int>"))
    whole = F.filter(starts, lambda b: n - b >= size)
    if padded:
        short = F.slice(F.filter(starts, lambda b: n - b < size), 1, 1)
        whole = F.concat(whole, short)
    if overlapping_stride:
        whole = F.filter(whole, lambda b, i: F.coalesce(F.floor(F.get(whole, i + 1) / hop), F.lit(-1)) != F.floor(b / hop))
    zeros = F.array_repeat(F.lit(0.0), size)
    return F.transform(whole, lambda b: F.struct(b.alias("start"), F.slice(F.concat(F.slice(x, b + 1, F.lit(size)), zeros), 1, size).alias("vec")))


def tta_starts(n: Column, length: int, count: int) -> Column:
    """`count` evenly spaced starts; one where the sequence isn't longer than `length`."""
    if count == 1:
        return F.array(F.lit(0))
    spread = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * (n - length) / (count - 1)).cast("int"))
    return F.when(n <= length, F.array(F.lit(0))).otherwise(spread)


def softmax(w: list[float]) -> list[float]:
    import math

    top = max(w)
    e = [math.exp(v - top) for v in w]
    return [v / sum(e) for v in e]


def weighted_sum(vectors: list[Column], weights: list[float]) -> Column:
    out = F.transform(vectors[0], lambda v: v * weights[0])
    for x, w in zip(vectors[1:], weights[1:], strict=True):
        out = _added(out, x, w)
    return out


def _added(a: Column, x: Column, w: float) -> Column:
    return F.zip_with(a, x, lambda p, q: p + q * w)


def cosine(a: Column, b: Column) -> Column:
    dot = total(F.zip_with(a, b, lambda x, y: x * y))
    size = lambda v: F.sqrt(total(F.transform(v, lambda x: x * x)))
    return F.try_divide(dot, size(a) * size(b))  # null where one is zero


def gaussian_log_density(x: Column, means: list[float], variances: list[float]) -> Column:
    """Log density of a diagonal Gaussian at a vector."""
    import math

    const = -0.5 * sum(math.log(2 * math.pi * v) for v in variances)
    m, v = F.array(*[F.lit(float(i)) for i in means]), F.array(*[F.lit(float(i)) for i in variances])
    return const - 0.5 * total(F.zip_with(F.zip_with(x, m, lambda a, b: (a - b) * (a - b)), v, lambda d, s: d / s))


def masked_mean(frames: Column, mask: Column) -> Column:
    """Mean of the frames (arrays of one length) whose mask is not 0, dimension by dimension; zeros where there is none."""
    kept = F.filter(F.zip_with(frames, mask, lambda f, m: F.struct(f.alias("f"), m.alias("m"))), lambda p: p["m"] != 0)
    zeros = F.transform(F.get(frames, F.lit(0)), lambda v: F.lit(0.0))
    sums = F.aggregate(kept, zeros, lambda s, p: F.zip_with(s, p["f"], lambda a, b: a + b))
    return let(F.greatest(F.size(kept), F.lit(1)), lambda n: F.transform(sums, lambda v: v / n))
