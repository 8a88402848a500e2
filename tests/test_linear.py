"""Linear models against direct solutions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from uttera.operators import linear as ln
from uttera.operators.sums import dense_sum, matrix
from uttera.session import ship


def data(n=240, d=5, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, d)) * np.array([1, 10, 0.1, 3, 0][:d]) + np.array([0, 5, 0, -2, 7][:d])
    y = x @ rng.normal(0, 1, d) + 30 + rng.normal(0, 2, n)
    return x, y


def frame(spark, x, y, **more):
    ship(spark)
    rows = [(i, a.tolist(), float(b), i % 4) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(-1, None, 1.0, 0), (-2, x[0].tolist(), None, 1), (-3, x[0].tolist(), 5.0, None)]
    return spark.createDataFrame(rows, "id long, v array<double>, y double, fold int").repartition(5)


def direct(x, y, alpha, scale):
    mean, std = x.mean(0), np.where(x.std(0) > 1e-9, x.std(0), 1.0) if scale else np.ones(x.shape[1])
    z = (x - mean) / std
    w = np.linalg.solve(z.T @ z + alpha * np.eye(z.shape[1]), z.T @ (y - y.mean())) / std
    return w, y.mean() - w @ mean


def test_dense_sum(spark):
    ship(spark)
    df = spark.createDataFrame([([float(i), 1.0],) for i in range(100)], "v array<double>").repartition(7)
    part = lambda b: np.concatenate([matrix(b.column(0)).sum(0), np.arange(70.0) * b.num_rows])
    assert dense_sum(df, part, 72).tolist() == [4950.0, 100.0] + [100.0 * k for k in range(70)]
    assert dense_sum(df.limit(0), part, 72).tolist() == [0.0] * 72


@pytest.mark.parametrize("scale", [False, True])
def test_search_equals_direct_fits(spark, scale):
    x, y = data()
    fold, alphas = np.arange(len(y)) % 4, [0.01, 1.0, 100.0]
    found = ln.ridge_search(frame(spark, x, y), "v", "y", "fold", alphas, 4, scale)
    want = []
    for a in alphas:
        e = np.zeros(len(y))
        for k in range(4):
            w, b = direct(x[fold != k], y[fold != k], a, scale)
            e[fold == k] = x[fold == k] @ w + b - y[fold == k]
        want.append((a, np.abs(e).mean(), (e * e).mean(), len(y)))
    assert np.allclose(np.array(found.scores), np.array(want), rtol=1e-8, atol=1e-8)
    assert found.best == min(want, key=lambda r: r[1])[0]
    w, b = direct(x, y, found.best, scale)
    assert np.allclose(found.model.weights, w, rtol=1e-8, atol=1e-8) and np.isclose(found.model.intercept, b, rtol=1e-8)
    got = frame(spark, x, y).where("id >= 0").orderBy("id").select(found.model.column(F.col("v"))).collect()
    assert np.allclose([r[0] for r in got], x @ w + b)
    assert [r.best for r in found.frame(spark).collect()].count(True) == 1


def dual(x, y, kind, c, epsilon, rounds=60_000):
    """A lower bound of the optimum, close to it: the dual problem by pairs of coordinates whose sum stays."""
    rng = np.random.default_rng(0)
    b, w = np.zeros(len(y)), np.zeros(x.shape[1])  # w = x.T @ b
    low, high = (-c, c) if kind == "svr" else (np.minimum(0, c * y), np.maximum(0, c * y))
    low, high = np.broadcast_to(low, len(y)), np.broadcast_to(high, len(y))
    gain = (lambda i, v: y[i] * v - epsilon * abs(v)) if kind == "svr" else (lambda i, v: y[i] * v)
    for _ in range(rounds):
        i, j = rng.choice(len(y), 2, replace=False)
        u = x[i] - x[j]
        q, r = max(u @ u, 1e-12), y[i] - y[j] - u @ w
        bounds = max(low[i] - b[i], b[j] - high[j]), min(high[i] - b[i], b[j] - low[j])
        tries = [(r - (s if kind == "svr" else 0) * epsilon) / q for s in (-2, 0, 2)] + [-b[i], b[j], *bounds]
        t = max((min(max(t, bounds[0]), bounds[1]) for t in tries), key=lambda t: gain(i, b[i] + t) + gain(j, b[j] - t) - t * (u @ w) - q * t * t / 2)
        b[i], b[j], w = b[i] + t, b[j] - t, w + t * u
    return sum(gain(i, v) for i, v in enumerate(b)) - w @ w / 2


@pytest.mark.parametrize(("kind", "scale"), [("svr", True), ("svr", False), ("svc", True), ("svc", False)])
def test_machines_reach_the_optimum(spark, kind, scale):
    x, y = data(120, 4, 3)
    x[:, 1] /= 10
    if kind == "svc":
        y = np.where(y + np.random.default_rng(1).normal(0, 4, len(y)) > np.median(y), 1.0, -1.0)
    got = ln.svm(frame(spark, x, y).where("id >= 0"), "v", F.col("y"), kind, c=0.5, epsilon=0.3, scale=scale)
    z = (x - x.mean(0)) / x.std(0) if scale else x
    bound = dual(z, y, kind, 0.5, 0.3)
    assert bound <= got.objective * (1 + 1e-9) and got.objective <= bound * (1 + 1e-3)
    f = got.model.predict(x)
    assert np.abs(f - y).mean() < np.abs(y - np.median(y)).mean() if kind == "svr" else ((f > 0) == (y > 0)).mean() > 0.75


def test_no_rows(spark):
    x, y = data(4, 2)
    none = frame(spark, x, y).limit(0)
    assert ln.svm(none, "v", F.col("y"), "svr").passes == 0
    assert ln.ridge_search(none, "v", "y", "fold", [1.0], 3).scores[0][3] == 0
