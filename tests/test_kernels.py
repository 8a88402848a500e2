"""Mixtures and kernel ridge against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from uttera.operators import kernels as kn
from uttera.operators import models
from uttera.session import ship


def frame(spark, x, y=None):
    ship(spark)
    y = np.zeros(len(x)) if y is None else y
    return spark.createDataFrame([(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))] + [(-1, None, 0.0)], "id long, v array<double>, y double").repartition(4)


def clusters(n=90):
    rng = np.random.default_rng(0)
    return np.concatenate([rng.normal(c, 0.3, (n, 2)) for c in ([0, 0], [5, 0], [0, 6])])


def test_starts_find_the_clusters(spark):
    x = clusters()
    rows = kn._vectors(frame(spark, x), "v")
    found = kn.starts(rows, 3)
    assert sorted(tuple(np.round(c / 5).astype(int)) for c in found) == [(0, 0), (0, 1), (1, 0)]
    centres, n, squares = kn.lloyd(rows, found)
    assert sorted(n) == [90, 90, 90] and np.isclose(squares.sum(), (x * x).sum())
    want = sorted(x[k * 90 : k * 90 + 90].mean(0).tolist() for k in range(3))
    assert np.allclose(sorted(centres.tolist()), want)
    again = kn.starts(kn._vectors(frame(spark, np.repeat(x, 3, 0)), "v").repartition(7), 3)
    assert len(again) == 3


def test_rounds_equal_em_in_numpy(spark):
    x = clusters(40)
    rows = frame(spark, x)
    one, two = (kn.gmm_fit(rows, "v", 3, r, tolerance=-1) for r in (1, 2))
    w, m, v = (np.array([c[k] for c in one]) for k in range(3))
    p = w * np.exp(-0.5 * ((x[:, None] - m) ** 2 / v).sum(2)) / np.sqrt((2 * np.pi * v).prod(1))
    r = p / p.sum(1, keepdims=True)
    n = r.sum(0)
    mean = r.T @ x / n[:, None]
    assert np.allclose([c[0] for c in two], n / len(x)) and np.allclose([c[1] for c in two], mean)
    assert np.allclose([c[2] for c in two], np.maximum(r.T @ (x * x) / n[:, None] - mean**2, 1e-3))
    got = rows.where("id >= 0").orderBy("id").select(models.gmm_log_likelihood(F.col("v"), one)).collect()
    assert np.allclose([g[0] for g in got], np.log(p.sum(1)))
    assert np.allclose(kn.responsibilities(x, w, m, v)[0], r)


def test_few_or_no_vectors(spark):
    same = frame(spark, np.ones((6, 2)))
    assert len(kn.gmm_fit(same, "v", 3)) == 1
    assert kn.gmm_fit(same.limit(0), "v", 3) == []
    assert kn.kernel_ridge(same.limit(0), "v", "y", [1.0])[0].landmarks.size == 0


@pytest.mark.parametrize("scale", [True, False])
def test_all_landmarks_equal_the_closed_form(spark, scale):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (500, 4)) * [1, 3, 0.5, 2] + 1
    y = np.sin(x[:, 0]) * 5 + x[:, 1] + rng.normal(0, 0.1, 500)
    got = kn.kernel_ridge(frame(spark, x, y).where("id >= 0"), "v", "y", [1.0, 0.1], scale=scale)
    z = (x - x.mean(0)) / x.std(0) if scale else x
    k = np.exp(-0.25 * ((z[:, None] - z[None]) ** 2).sum(2))
    for a, m in zip((1.0, 0.1), got, strict=True):
        want = k @ np.linalg.solve(k + a * np.eye(500), y)
        assert np.abs(m.predict(x) - want).max() < 1e-6 and m.residual < 1e-6
    df = frame(spark, x, y)
    out = {r.id: r.p for r in df.select("id", got[0].column(F.col("v")).alias("p")).collect()}
    assert out.pop(-1) is None and np.allclose([out[i] for i in range(500)], got[0].predict(x))


def test_fewer_landmarks_say_how_far_they_reach(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 2))
    y = np.sin(2 * x[:, 0]) + x[:, 1] ** 2
    few, more = (kn.kernel_ridge(frame(spark, x, y).where("id >= 0"), "v", "y", [0.1], landmarks=n)[0] for n in (5, 80))
    error = lambda m: np.abs(m.predict(x) - y).mean()
    assert few.residual > more.residual > 0 and error(more) < 0.1 < error(few)
