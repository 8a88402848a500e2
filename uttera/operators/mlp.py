"""Multilayer perceptrons with one hidden layer, trained on all rows: each epoch every task takes its own steps and their ends are averaged.

An epoch is one pass over the rows for all configurations together. A task starts from the common parameters, takes Adam steps on batches of its
training rows (clipped gradients, a learning rate by schedule) and sends its parameters and moments weighted by its rows; their mean is
the next common state. Held-out rows are scored with the state at the start of a pass. A configuration stops when its held-out error has not
fallen for `patience` epochs and keeps the best state. Inputs and targets are scaled by the mean and deviation of the training rows alone.

Rows are dealt to tasks by a hash of the id, WORKER rows a task, and sorted by it, so a result depends on the rows, not on how they lay (but for the last bits of sums).
Rows whose vector or target is null take no part in training; a null vector's prediction is null. Without held-out rows the training loss decides.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.operators.sums import dense_sum, matrix, numbers, task_sum

#: Rows in a task. Few rows a task mean more averaging, many mean fewer tasks.
WORKER = 20_000


@dataclass(frozen=True)
class Config:
    """One run: width, seed, and how its steps are taken. schedule: "constant", "cosine" or "plateau" (halved after 3 epochs without gain)."""

    hidden: int
    seed: int
    rate: float = 1e-2
    schedule: str = "constant"
    clip: float = 5.0
    batch: int = 64
    epochs: int = 40
    patience: int = 10
    gain: float = 1e-4

    @property
    def run_id(self) -> str:
        return f"h{self.hidden}_s{self.seed}"

    def size(self, d: int) -> int:
        return d * self.hidden + 2 * self.hidden + 1

    def start(self, d: int) -> np.ndarray:
        rng = np.random.default_rng(self.seed)
        return np.concatenate([rng.normal(0, math.sqrt(2 / d), d * self.hidden), np.zeros(self.hidden), rng.normal(0, 1 / math.sqrt(self.hidden), self.hidden), [0.0]])

    def rate_at(self, epoch: int, halvings: int) -> float:
        if self.schedule == "cosine":
            return self.rate * (1 + math.cos(math.pi * epoch / self.epochs)) / 2
        return self.rate * (0.5**halvings if self.schedule == "plateau" else 1.0)


def _split(p: np.ndarray, d: int, h: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    return p[: d * h].reshape(d, h), p[d * h : d * h + h], p[d * h + h : -1], p[-1]


def forward(p: np.ndarray, x: np.ndarray, h: int) -> np.ndarray:
    a, b, c, e = _split(p, x.shape[1], h)
    return np.maximum(0, x @ a + b) @ c + e


def gradient(p: np.ndarray, x: np.ndarray, t: np.ndarray, h: int) -> tuple[float, np.ndarray]:
    """Mean squared error and its gradient."""
    a, b, c, e = _split(p, x.shape[1], h)
    z = np.maximum(0, x @ a + b)
    r = z @ c + e - t
    ge = 2 * r / len(t)
    gz = np.outer(ge, c) * (z > 0)
    return float((r * r).mean()), np.concatenate([(x.T @ gz).ravel(), gz.sum(0), z.T @ ge, [ge.sum()]])


def steps(state: np.ndarray, done: int, x: np.ndarray, t: np.ndarray, config: Config, rate: float, rng: np.random.Generator) -> tuple[np.ndarray, float, int]:
    """Adam over the rows once: state (parameters, first and second moments), the summed loss, and the number of steps."""
    p, m, v = (a.copy() for a in np.split(state, 3))
    order, loss, k = rng.permutation(len(x)), 0.0, 0
    for i in range(0, len(x), config.batch):
        own = order[i : i + config.batch]
        value, g = gradient(p, x[own], t[own], config.hidden)
        loss += value * len(own)
        norm = np.linalg.norm(g)
        if norm > config.clip:
            g *= config.clip / norm
        k += 1
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        p = p - rate * (m / (1 - 0.9 ** (done + k))) / (np.sqrt(v / (1 - 0.999 ** (done + k))) + 1e-8)
    return np.concatenate([p, m, v]), loss, k


@dataclass(frozen=True)
class Perceptron:
    """A trained run with its scalers."""

    config: Config
    parameters: np.ndarray
    mean: np.ndarray
    std: np.ndarray
    target_mean: float
    target_std: float
    best: float
    best_epoch: int

    def predict(self, x: np.ndarray) -> np.ndarray:
        return forward(self.parameters, (x - self.mean) / self.std, self.config.hidden) * self.target_std + self.target_mean


def predicted(vec: Column, models: list[Perceptron]) -> Column:
    """Mean prediction of the models, batch by batch."""

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            known = b.notna().to_numpy()
            out = np.full(len(b), np.nan)
            if known.any():
                x = np.array(b[known].tolist(), float)
                out[known] = np.mean([m.predict(x) for m in models], 0)
            yield pd.Series(out).where(known)

    x = vec.cast("array<double>")
    return F.when(x.isNotNull(), run(x))


@dataclass
class _Run:
    config: Config
    state: np.ndarray
    done: int = 0
    best: float = math.inf
    best_epoch: int = -1
    best_state: np.ndarray | None = None
    bad: int = 0
    halvings: int = 0
    waited: int = 0
    over: bool = False

    def judged(self, epoch: int, error: float) -> None:
        """What the error after an epoch means for stop, best state and rate."""
        if error < self.best - self.config.gain:
            self.best, self.best_epoch, self.best_state, self.bad, self.waited = error, epoch, self.state, 0, 0
        else:
            self.bad, self.waited = self.bad + 1, self.waited + 1
            if self.waited >= 3:
                self.halvings, self.waited = self.halvings + 1, 0
            self.over = self.bad >= self.config.patience
        self.over |= epoch + 1 >= self.config.epochs


def train(df: DataFrame, id_: str, vec: str, target: str, held: Column, configs: list[Config], worker: int = WORKER) -> tuple[list[Perceptron], list[tuple]]:
    """The trained runs and their history: run_id, hidden, seed, epoch, train_loss (mean squared error of the scaled target), dev_mae, rate."""
    rows = df.select(F.col(vec).cast("array<double>").alias("x"), F.col(target).cast("double").alias("y"), F.coalesce(held, F.lit(False)).alias("held"), F.xxhash64(F.col(id_).cast("string")).alias("k"))
    rows = rows.where("x is not null and y is not null")
    first = rows.select(F.size("x")).first()
    if not first:
        return [], []
    d = first[0]

    def moments(batch):
        own = ~numbers(batch.column(2)).astype(bool)
        x, y = matrix(batch.column(0))[own], numbers(batch.column(1))[own]
        return np.concatenate([[len(y), y.sum(), (y * y).sum()], x.sum(0), (x * x).sum(0)])

    s = dense_sum(rows, moments, 2 * d + 3)
    n = max(1.0, s[0])
    target_mean, mean = s[1] / n, s[3 : d + 3] / n
    target_std = max(math.sqrt(max(0.0, s[2] / n - target_mean**2)), 1e-6)
    std = np.sqrt(np.maximum(0, s[d + 3 :] / n - mean**2))
    std = np.where(std > 1e-9 * (1 + np.abs(mean)), std, 1.0)
    rows = rows.repartition(max(1, math.ceil(n / worker)), "k").sortWithinPartitions("k", "y", "x").persist(StorageLevel.MEMORY_AND_DISK)
    runs = [_Run(c, np.concatenate([c.start(d), np.zeros(2 * c.size(d))])) for c in configs]
    history: list[tuple] = []
    try:
        epoch = 0
        while active := [r for r in runs if not r.over]:
            plan = [(r.config, r.state, r.done, r.config.rate_at(epoch, r.halvings)) for r in active]
            sizes = [len(r.state) + 5 for r in active]

            def task(batches, plan=plan, sizes=sizes, epoch=epoch):
                sums = None
                for i, batch in enumerate(batches):
                    if sums is None:
                        sums, states = [np.zeros(k) for k in sizes], [state for _, state, *_ in plan]
                        done = [k for *_, k, _ in plan]
                        count = 0
                    x, y, out = (matrix(batch.column(0)) - mean) / std, numbers(batch.column(1)), numbers(batch.column(2)).astype(bool)
                    t = (y - target_mean) / target_std
                    for j, (config, start, _, rate) in enumerate(plan):
                        if out.any():  # with the state that all tasks start from
                            e = forward(start[: len(start) // 3], x[out], config.hidden) * target_std + target_mean - y[out]
                            sums[j][-2:] += np.abs(e).sum(), out.sum()
                        if not out.all():
                            rng = np.random.default_rng([config.seed, epoch, i])
                            states[j], loss, k = steps(states[j], done[j], x[~out], t[~out], config, rate, rng)
                            done[j] += k
                            sums[j][-5:-2] += loss, (~out).sum(), k
                    count += int((~out).sum())
                if sums is None:
                    return None
                for j, state in enumerate(states):
                    sums[j][:-5] = state * count
                    sums[j][-3] *= count
                return np.concatenate(sums)

            total, at = task_sum(rows, task, sum(sizes)), 0
            for r, k in zip(active, sizes, strict=True):
                own, at = total[at : at + k], at + k
                loss, trained, moved, error, scored = own[-5:]
                if epoch:  # what this pass scored is the state after the epoch before
                    name, last = history_row(history, r.config.run_id)
                    dev = float(error / scored) if scored else None
                    history[name] = (*last[:5], dev, last[6])
                    r.judged(epoch - 1, dev if dev is not None else last[4])
                if not r.over and trained:
                    rate = r.config.rate_at(epoch, r.halvings)
                    history.append((r.config.run_id, r.config.hidden, r.config.seed, epoch, float(loss / trained), None, float(rate)))
                    r.state, r.done = own[:-5] / trained, r.done + round(moved / trained)
                elif not trained:
                    r.over, r.best_state = True, r.state
            epoch += 1
    finally:
        rows.unpersist()
    out = []
    for r in runs:
        p = np.split(r.best_state if r.best_state is not None else r.state, 3)[0]
        out.append(Perceptron(r.config, p, mean, std, float(target_mean), float(target_std), float(r.best), r.best_epoch))
    return out, history


def history_row(history: list[tuple], run_id: str) -> tuple[int, tuple]:
    """Place and content of a run's last row."""
    k = max(i for i, h in enumerate(history) if h[0] == run_id)
    return k, history[k]


HISTORY = "run_id string, hidden long, seed long, epoch long, train_loss double, dev_mae double, rate double"
