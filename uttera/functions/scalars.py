"""Scalar expressions on ages, names, runs and losses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clipped_age(x: Column, low: float = 20.0, high: float = 90.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def z_scored(y: Column, mean: Column, std: Column) -> Column:
    """With a standard deviation under 1e-6 taken as 1."""
    return (y - mean) / F.when(std < 1e-6, 1.0).otherwise(std)


def un_z_scored(y: Column, mean: Column, std: Column) -> Column:
    return y * F.when(std < 1e-6, 1.0).otherwise(std) + mean


def gender_index(gender: Column, male_first: bool = False) -> Column:
    """F 0 and M 1, or the reverse; -1 for anything else."""
    f, m = (1, 0) if male_first else (0, 1)
    return F.when(F.trim(gender) == "F", f).when(F.trim(gender) == "M", m).otherwise(-1)


def cache_key(base: Column, mode: Column) -> Column:
    return F.when(mode == "raw", base).otherwise(F.concat(base, F.lit("__"), mode))


def audio_key(filename: Column, mode: Column) -> Column:
    return F.md5(F.concat_ws("|", filename, mode))


def without_prefix(path: Column, prefix: str) -> Column:
    return F.when(path.startswith(prefix), F.substr(path, F.lit(len(prefix) + 1))).otherwise(path)


def without_seed(tag: Column) -> Column:
    """A run tag without its last _s<seed>."""
    return F.regexp_replace(tag, r"^(.*)_s.*$", "$1")


def layers(text: Column) -> Column:
    """Layer numbers of a list with commas or blanks."""
    return F.transform(F.filter(F.split(text, "[ ,]+"), lambda x: x != ""), lambda x: x.cast("int"))


def gap_verdict(gap: Column) -> Column:
    return F.when(gap > 1.5, "overfit").when(gap > 0.5, "moderate").otherwise("ceiling")


def latency_verdict(seconds: Column) -> Column:
    return F.when(seconds < 2, "interactive").otherwise("batch-only")


def intelligibility(wer: Column) -> Column:
    """What a word error rate of speech that was made and transcribed again says of the speech."""
    return F.when(wer <= 0.1, "excellent").when(wer <= 0.2, "acceptable").when(wer < 0.5, "poor").otherwise("unintelligible")


def language_of(model: Column, language: Column) -> Column:
    """English-only models transcribe as English."""
    return F.when(F.contains(model, F.lit("distil")), "en").otherwise(language)


def minutes(samples: Column, rate: int = 16_000) -> Column:
    return samples / (60.0 * rate)


def pinball(error: Column, tau: float = 0.5) -> Column:
    """error: target - prediction."""
    return F.greatest(tau * error, (tau - 1) * error)


def huber(error: Column, delta: float = 1.0) -> Column:
    a = F.abs(error)
    return F.when(a <= delta, 0.5 * error * error).otherwise(delta * (a - 0.5 * delta))


def ramp(step: Column, warmup: float, top: float) -> Column:
    return F.lit(top) * F.least(F.lit(1.0), step / F.lit(float(warmup)))
