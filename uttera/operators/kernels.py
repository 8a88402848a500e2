"""Mixtures and kernel machines from sums over all rows: diagonal Gaussian mixtures with k-means|| starts, kernel ridge on landmarks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.operators.sums import dense_sum, matrix, numbers


def _squares(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None])


# ---- Gaussian mixtures ------------------------------------------------------------------------------------------


def _vectors(df: DataFrame, vec: str) -> DataFrame:
    return df.select(F.col(vec).cast("array<double>").alias("_x")).where("_x is not null")


def _nearest(x: Column, centres: np.ndarray) -> Column:
    """Squared distance to the nearest centre."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(_squares(np.array(b.tolist(), float), centres).min(1) if len(b) else [], dtype=float)

    return run(x)


def starts(rows: DataFrame, k: int, rounds: int = 3, seed: int = 0) -> np.ndarray:
    """k centres by k-means||: rounds draw about 2 k rows each with chances by their squared distance to the centres so far; the drawn ones, weighted by the
    rows nearest to them, are thinned to k on the driver. Chances come from a hash of the vector, and equal vectors are drawn once."""
    first = rows.orderBy(F.xxhash64("_x", F.lit(seed)), "_x").limit(1).collect()
    if not first:
        return np.zeros((0, 0))
    centres = np.array([first[0][0]], float)
    for r in range(rounds):

        def cost(batch, c=centres):
            return np.array([_squares(matrix(batch.column(0)), c).min(1).sum()])

        total = dense_sum(rows, cost, 1)[0]
        if total <= 1e-12:
            break

        chance = F.pmod(F.xxhash64("_x", F.lit(seed + 1 + r)), F.lit(1 << 40)) / float(1 << 40)
        drawn = rows.where(chance < _nearest(F.col("_x"), centres) * (2.0 * k / total)).distinct().collect()  # about 2 k rows
        if drawn:
            centres = np.concatenate([centres, np.array(sorted(tuple(d[0]) for d in drawn), float)])

    def nearest(batch, c=centres):
        return np.bincount(_squares(matrix(batch.column(0)), c).argmin(1), minlength=len(c)).astype(float)

    weight, rng = dense_sum(rows, nearest, len(centres)), np.random.default_rng(seed)
    chosen = [int(weight.argmax())]
    while len(chosen) < min(k, len(centres)):  # k-means++ over the drawn
        far = _squares(centres, centres[chosen]).min(1) * weight
        if far.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(centres), p=far / far.sum())))
    return centres[chosen]


def lloyd(rows: DataFrame, centres: np.ndarray, rounds: int = 5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k-means from given centres: centres, and of each the number of rows and the squares' sums, of the last assignment."""
    k, d = centres.shape
    for _ in range(rounds + 1):

        def part(batch, c=centres):
            x = matrix(batch.column(0))
            own = np.eye(k)[_squares(x, c).argmin(1)]
            return np.concatenate([own.sum(0), (own.T @ x).ravel(), (own.T @ (x * x)).ravel()])

        s = dense_sum(rows, part, k + 2 * k * d)
        n, total, squares = s[:k], s[k : k + k * d].reshape(k, d), s[k + k * d :].reshape(k, d)
        moved = np.where(n[:, None] > 0, total / np.maximum(1, n)[:, None], centres)
        still = np.allclose(moved, centres, rtol=0, atol=1e-9)
        centres = moved
        if still:
            break
    return centres, n, squares


def gmm_fit(df: DataFrame, vec: str, k: int = 4, rounds: int = 10, floor: float = 1e-3, tolerance: float = 1e-4, seed: int = 0) -> list[tuple[float, list[float], list[float]]]:
    """Diagonal Gaussian mixture by EM: (weight, means, variances) of each component; fewer than k where fewer vectors differ, none without rows.

    Each round is one pass: a task sends k (2 d + 1) + 1 sums. It ends when the mean log likelihood gains less than the tolerance.
    """
    rows = _vectors(df, vec)
    centres = starts(rows, k, seed=seed)
    if not len(centres):
        return []
    k, d = centres.shape
    mean, n, squares = lloyd(rows, centres)
    count = np.maximum(n, 1e-9)
    var = np.maximum(squares / count[:, None] - mean**2, floor)
    weight, before = n / n.sum(), -math.inf
    for _ in range(rounds):

        def part(batch, weight=weight, mean=mean, var=var):
            r, log = responsibilities(matrix(batch.column(0)), weight, mean, var)
            x = matrix(batch.column(0))
            return np.concatenate([[log.sum()], r.sum(0), (r.T @ x).ravel(), (r.T @ (x * x)).ravel()])

        s = dense_sum(rows, part, 1 + k + 2 * k * d)
        n = np.maximum(s[1 : k + 1], 1e-9)
        mean = s[k + 1 : k + 1 + k * d].reshape(k, d) / n[:, None]
        var = np.maximum(s[k + 1 + k * d :].reshape(k, d) / n[:, None] - mean**2, floor)
        weight, level = n / n.sum(), s[0] / s[1 : k + 1].sum()
        if level - before < tolerance:
            break
        before = level
    return [(float(w), m.tolist(), v.tolist()) for w, m, v in zip(weight, mean, var, strict=True)]


def responsibilities(x: np.ndarray, weight: np.ndarray, mean: np.ndarray, var: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row its components' shares and its log likelihood."""
    logs = np.log(np.maximum(weight, 1e-12)) - 0.5 * (np.log(2 * np.pi * var).sum(1) + (x * x) @ (1 / var).T - 2 * x @ (mean / var).T + (mean**2 / var).sum(1))
    top = logs.max(1, keepdims=True)
    e = np.exp(logs - top)
    z = e.sum(1, keepdims=True)
    return e / z, (top + np.log(z))[:, 0]


# ---- kernel ridge ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class KernelRidge:
    """Regression with the kernel exp(-gamma |x - y|^2) on landmarks; residual is the mean part of the kernel's diagonal that they don't reach, 0 where the result is the exact one."""

    landmarks: np.ndarray
    weights: np.ndarray
    gamma: float
    mean: np.ndarray
    std: np.ndarray
    residual: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-self.gamma * _squares((x - self.mean) / self.std, self.landmarks)) @ self.weights

    def column(self, vec: Column) -> Column:
        @F.pandas_udf("double")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for b in batches:
                known = b.notna().to_numpy()
                out = np.full(len(b), np.nan)
                if known.any():
                    out[known] = self.predict(np.array(b[known].tolist(), float))
                yield pd.Series(out).where(known)

        x = vec.cast("array<double>")
        return F.when(x.isNotNull(), run(x))


def kernel_ridge(df: DataFrame, vec: str, target: str, alphas: list[float], gamma: float | None = None, landmarks: int = 500, scale: bool = True) -> list[KernelRidge]:
    """Kernel ridge regressions, one for each alpha, in one pass over all rows (two more scale them and pick the landmarks).

    Landmarks are at most `landmarks` distinct vectors, the first by a hash: a bounded sample. With all vectors among them the result is that
    of the whole kernel matrix; else it is the best in the span of theirs, and `residual` says how far the kernel reaches beyond it.
    gamma: one over the number of dimensions by default. No intercept.
    """
    rows = df.select(F.col(vec).cast("array<double>").alias("_x"), F.col(target).cast("double").alias("_y")).where("_x is not null and _y is not null")
    picked = [r[0] for r in rows.select("_x").distinct().orderBy(F.xxhash64("_x"), "_x").limit(landmarks).collect()]
    if not picked:
        return [KernelRidge(np.zeros((0, 0)), np.zeros(0), 1.0, np.zeros(0), np.ones(0), 0.0) for _ in alphas]
    d = len(picked[0])
    mean, std = np.zeros(d), np.ones(d)
    if scale:

        def moments(batch):
            x = matrix(batch.column(0))
            return np.concatenate([[len(x)], x.sum(0), (x * x).sum(0)])

        m = dense_sum(rows, moments, 2 * d + 1)
        mean = m[1 : d + 1] / m[0]
        var = m[d + 1 :] / m[0] - mean**2
        std = np.where(var > 1e-12 * (1 + mean**2), np.sqrt(np.maximum(var, 0)), 1.0)
    gamma = 1 / d if gamma is None else gamma
    marks = (np.array(picked, float) - mean) / std
    e, v = np.linalg.eigh(np.exp(-gamma * _squares(marks, marks)))
    keep = e > 1e-11 * e.max()
    white = v[:, keep] / np.sqrt(e[keep])  # columns of kernel values times this are orthonormal features
    k = white.shape[1]

    def part(batch):
        x, y = (matrix(batch.column(0)) - mean) / std, numbers(batch.column(1))
        f = np.exp(-gamma * _squares(x, marks)) @ white
        return np.concatenate([[len(y), len(y) - (f * f).sum()], f.T @ y, (f.T @ f).ravel()])

    s = dense_sum(rows, part, 2 + k + k * k)
    fy, ff = s[2 : 2 + k], s[2 + k :].reshape(k, k)
    return [KernelRidge(marks, white @ np.linalg.solve(ff + a * np.eye(k), fy), gamma, mean, std, max(0.0, float(s[1] / s[0]))) for a in alphas]
