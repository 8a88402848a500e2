"""Linear models from sums over all rows: ridge by fold Gram matrices, support vector machines by Newton steps on a smoothed loss.

Rows whose vector or target is null take no part. Vectors have one length. The driver holds d x d matrices for d dimensions, never rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.operators.sums import dense_sum, matrix, numbers


@dataclass(frozen=True)
class Linear:
    """weights . x + intercept, on vectors as they come: a scaler is folded into the weights."""

    weights: np.ndarray
    intercept: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        return x @ self.weights + self.intercept

    def column(self, vec: Column) -> Column:
        w = F.array(*[F.lit(float(v)) for v in self.weights])
        return F.aggregate(F.zip_with(vec.cast("array<double>"), w, lambda a, b: a * b), F.lit(float(self.intercept)), lambda s, v: s + v)


def _clean(df: DataFrame, vec: str, target: Column, *more: Column) -> DataFrame:
    rows = df.select(F.col(vec).cast("array<double>").alias("_x"), target.cast("double").alias("_y"), *more)
    return rows.where("_x is not null and _y is not null")


def _size(rows: DataFrame) -> int:
    first = rows.select(F.size("_x")).first()
    return first[0] if first else 0


# ---- ridge ------------------------------------------------------------------------------------------------------


@dataclass
class Grams:
    """Sums of (1, x, y) times itself for each fold: all that ridge regression needs to know of the rows."""

    sums: np.ndarray  # folds x (d + 2) x (d + 2)

    @property
    def folds(self) -> int:
        return len(self.sums)

    def without(self, fold: int | None) -> np.ndarray:
        total = self.sums.sum(0)
        return total if fold is None else total - self.sums[fold]


def grams(df: DataFrame, vec: str, target: str, fold: str, folds: int) -> Grams:
    """One pass over all rows, whatever is fitted of it afterwards. Folds are numbered 0 .. folds - 1; other rows take no part."""
    rows = _clean(df, vec, F.col(target), F.col(fold).cast("int").alias("_f")).where(F.col("_f").between(0, folds - 1))
    d = _size(rows) + 2

    def part(batch):
        x, y, f = matrix(batch.column(0)), numbers(batch.column(1)), numbers(batch.column(2))
        z = np.concatenate([np.ones((len(y), 1)), x, y[:, None]], 1)
        return np.stack([z[f == k].T @ z[f == k] for k in range(folds)]).ravel()

    return Grams(dense_sum(rows, part, folds * d * d).reshape(folds, d, d))


def ridge_from(gram: np.ndarray, alpha: float, scale: bool = False) -> Linear:
    """Minimum of the squared errors plus alpha |w|^2, the intercept free; with scale, of w on dimensions of standard deviation 1 (a constant one counts as 1)."""
    n = gram[0, 0]
    if not n:
        return Linear(np.zeros(len(gram) - 2), 0.0)
    mean = gram[0, 1:] / n
    centred = gram[1:, 1:] - n * np.outer(mean, mean)
    xx, xy = centred[:-1, :-1], centred[:-1, -1]
    s = np.ones(len(xy))
    if scale:
        variance = np.diag(xx) / n
        s = np.where(variance > 1e-12 * (1 + mean[:-1] ** 2), np.sqrt(np.maximum(variance, 0)), 1.0)
    w = np.linalg.lstsq(xx / np.outer(s, s) + alpha * np.eye(len(s)), xy / s, rcond=None)[0] / s
    return Linear(w, float(mean[-1] - w @ mean[:-1]))


@dataclass
class Search:
    """Scores of a grid: a row (alpha, mae, mse, n) each, the best alpha by mae (ties: the first given), and the model refitted on all rows."""

    scores: list[tuple[float, float, float, int]]
    best: float
    model: Linear

    def frame(self, spark) -> DataFrame:
        return spark.createDataFrame([(float(a), float(e), float(q), int(n), a == self.best) for a, e, q, n in self.scores], "alpha double, mae double, mse double, n long, best boolean")


def ridge_search(df: DataFrame, vec: str, target: str, fold: str, alphas: list[float], folds: int, scale: bool = False) -> Search:
    """Cross-validated grid search with refit in two passes, whatever the grid: one for the folds' Gram matrices, one for the held-out errors of all models."""
    g = grams(df, vec, target, fold, folds)
    models = [[ridge_from(g.without(k), a, scale) for a in alphas] for k in range(folds)]
    weights, intercepts = (np.stack([np.stack([np.asarray(getattr(m, name)) for m in row]) for row in models]) for name in ("weights", "intercept"))
    rows = _clean(df, vec, F.col(target), F.col(fold).cast("int").alias("_f")).where(F.col("_f").between(0, folds - 1))

    def part(batch):
        x, y, f = matrix(batch.column(0)), numbers(batch.column(1)), numbers(batch.column(2))
        e = np.zeros((3, len(alphas)))
        for k in np.unique(f):
            own = f == k
            r = x[own] @ weights[k].T + intercepts[k] - y[own, None]
            e += np.stack([np.abs(r).sum(0), (r * r).sum(0), np.full(len(alphas), float(own.sum()))])
        return e.ravel()

    e = dense_sum(rows, part, 3 * len(alphas)).reshape(3, -1)
    n = np.maximum(1, e[2])
    scores = [(a, *v) for a, v in zip(alphas, np.stack([e[0] / n, e[1] / n, e[2]], 1).tolist(), strict=True)]
    best = min(scores, key=lambda s: s[1])[0]
    return Search(scores, best, ridge_from(g.without(None), best, scale))


# ---- support vector machines ----------------------------------------------------------------------------------


def _smooth(a: np.ndarray, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """max(0, a) with a parabola over (0, width): values, slopes, curvatures. At most width / 2 below."""
    inside = (a > 0) & (a < width)
    return np.where(inside, a * a / (2 * width), np.where(a > 0, a - width / 2, 0.0)), np.clip(a / width, 0, 1), inside / width


def _loss(kind: str, f: np.ndarray, y: np.ndarray, epsilon: float, width: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loss, slope and curvature at each prediction f; kind: svr (epsilon-insensitive) or svc (hinge, y in -1, 1)."""
    if kind == "svr":
        r = f - y
        v, s, c = _smooth(np.abs(r) - epsilon, width)
        return v, s * np.sign(r), c
    v, s, c = _smooth(1 - y * f, width)
    return v, -y * s, c


@dataclass
class Machine:
    """A fitted machine, its objective (0.5 |w|^2 + c * sum of losses, on scaled dimensions) and the passes it took."""

    model: Linear
    objective: float
    passes: int


def svm(df: DataFrame, vec: str, target: Column, kind: str, c: float = 1.0, epsilon: float = 0.1, scale: bool = False, widths: int = 5, steps: int = 25, tolerance: float = 1e-5) -> Machine:
    """Linear support vector regression ("svr") or classification ("svc", target -1 or 1), the intercept free of penalty.

    The loss is smoothed over a width that shrinks tenfold, `widths` times; on each width Newton steps are taken, two passes each: gradient
    and Hessian in one, the objective after steps of all tried dampings and lengths in the other. The objective that is returned is that of the loss itself.
    """
    rows = _clean(df, vec, target)
    d = _size(rows)
    if not d:
        return Machine(Linear(np.zeros(0), 0.0), 0.0, 0)

    def moments(batch):
        x, y = matrix(batch.column(0)), numbers(batch.column(1))
        return np.concatenate([[len(x), y.sum(), (y * y).sum()], x.sum(0), (x * x).sum(0)])

    m = dense_sum(rows, moments, 2 * d + 3)
    level = m[1] / m[0]
    spread = float(np.sqrt(max(0.0, m[2] / m[0] - level**2))) or 1.0
    mean, std = np.zeros(d), np.ones(d)
    if scale:
        mean = m[3 : d + 3] / m[0]
        variance = m[d + 3 :] / m[0] - mean**2
        std = np.where(variance > 1e-12 * (1 + mean**2), np.sqrt(np.maximum(variance, 0)), 1.0)
    passes, p = 1, np.r_[level if kind == "svr" else 0.0, np.zeros(d)]  # the intercept first
    penalty = np.r_[0.0, np.ones(d)]
    first = 4 * spread if kind == "svr" else 4.0

    def read(batch):
        x = (matrix(batch.column(0)) - mean) / std
        return np.concatenate([np.ones((len(x), 1)), x], 1), numbers(batch.column(1))

    def objective(losses: float | np.ndarray, p: np.ndarray):
        return 0.5 * (p * p * penalty).sum(-1) + c * losses

    for width in first * 0.1 ** np.arange(widths):
        for _ in range(steps):

            def curved(batch, p=p, width=width):
                z, y = read(batch)
                v, s, h = _loss(kind, z @ p, y, epsilon, width)
                return np.concatenate([[v.sum()], z.T @ s, (z.T @ (z * h[:, None])).ravel()])

            sums = dense_sum(rows, curved, 1 + (d + 1) + (d + 1) ** 2)
            now, g, h = objective(sums[0], p), c * sums[1 : d + 2] + penalty * p, c * sums[d + 2 :].reshape(d + 1, d + 1) + np.diag(penalty)
            size = np.trace(h) / len(h)
            steps_ = [-t * np.linalg.lstsq(h + (damping * size + 1e-12) * np.eye(d + 1), g, rcond=None)[0] for damping in (1e-10, 1e-4, 1e-2, 1.0, 100.0) for t in (1.0, 0.5, 0.1, 0.01)]
            tried = p + np.array(steps_)

            def along(batch, width=width, tried=tried):
                z, y = read(batch)
                return _loss(kind, z @ tried.T, y[:, None], epsilon, width)[0].sum(0)

            values = objective(dense_sum(rows, along, len(tried)), tried)
            passes += 2
            k = int(values.argmin())
            if not values[k] < now:
                break
            p = tried[k]
            if now - values[k] <= tolerance * max(1e-9, abs(now)):
                break

    def exact(batch, p=p):
        z, y = read(batch)
        f = z @ p
        return np.array([(np.maximum(0, np.abs(f - y) - epsilon) if kind == "svr" else np.maximum(0, 1 - y * f)).sum()])

    total = dense_sum(rows, exact, 1)[0]
    w = p[1:] / std
    return Machine(Linear(w, float(p[0] - w @ mean)), float(objective(total, p)), passes + 1)
