"""Perceptrons: gradients by differences, averaging by hand, learning on all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from uttera.operators import mlp
from uttera.session import ship


def frame(spark, n=600, seed=0):
    ship(spark)
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3)) * [1, 20, 0.05] + [0, 100, 3]
    y = 50 + 10 * np.abs(x[:, 0]) + 0.2 * x[:, 1] + rng.normal(0, 0.5, n)
    rows = [(i, a.tolist(), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows, "id long, v array<double>, y double"), x, y


def held_out():
    return F.col("id") % 5 == 0


def test_gradient():
    rng = np.random.default_rng(1)
    c = mlp.Config(4, 2)
    p, x, t = c.start(3), rng.normal(size=(7, 3)), rng.normal(size=7)
    value, g = mlp.gradient(p, x, t, 4)
    for k in range(len(p)):
        e = np.zeros(len(p))
        e[k] = 1e-6
        up, down = (mlp.gradient(p + s * e, x, t, 4)[0] for s in (1, -1))
        assert np.isclose(g[k], (up - down) / 2e-6, atol=1e-5)
    assert np.isclose(value, ((mlp.forward(p, x, 4) - t) ** 2).mean())


def test_clipping_and_schedules():
    c = mlp.Config(2, 0, clip=1e-3, schedule="cosine", epochs=10)
    state = np.concatenate([c.start(1), np.zeros(2 * c.size(1))])
    out, _, k = mlp.steps(state, 0, np.ones((4, 1)) * 50, np.ones(4) * 1e4, c, 0.1, np.random.default_rng(0))
    assert k == 1 and np.linalg.norm(np.split(out, 3)[1]) <= 0.1 * 1e-3 + 1e-12
    assert c.rate_at(0, 9) == c.rate and np.isclose(c.rate_at(5, 0), c.rate / 2) and c.rate_at(10, 0) == 0
    plateau = mlp._Run(mlp.Config(2, 0, schedule="plateau", patience=9), state)
    for epoch, error in enumerate([5.0, 6, 6, 6, 6, 6, 6, 4]):
        plateau.judged(epoch, error)
    assert plateau.halvings == 2 and plateau.best == 4 and not plateau.over and plateau.config.rate_at(9, 2) == plateau.config.rate / 4


def test_learns_all_rows(spark):
    df, x, y = frame(spark)
    models, history = mlp.train(df, "id", "v", "y", held_out(), [mlp.Config(16, 1, schedule="plateau"), mlp.Config(16, 2, schedule="cosine")], worker=200)
    held = np.arange(len(y)) % 5 == 0
    mean_error = np.abs(y[held] - y[~held].mean()).mean()
    for m in models:
        own = [h for h in history if h[0] == m.config.run_id]
        assert m.best < 0.4 * mean_error and m.best == min(h[5] for h in own if h[5] is not None)
        assert np.isclose(np.abs(m.predict(x[held]) - y[held]).mean(), m.best)  # the best state is the one that is kept
        assert [h[3] for h in own] == list(range(len(own))) and np.isclose(m.target_mean, y[~held].mean()) and np.allclose(m.std, x[~held].std(0))
    got = df.unionByName(spark.createDataFrame([(-1, None, None)], df.schema)).select("id", mlp.predicted(F.col("v"), models).alias("p")).collect()
    got = {r.id: r.p for r in got}
    assert got.pop(-1) is None and np.allclose([got[i] for i in range(len(y))], np.mean([m.predict(x) for m in models], 0))


def test_one_task_equals_plain_steps_and_layout_changes_nothing(spark):
    df, x, y = frame(spark, 100)
    c = mlp.Config(4, 3, epochs=2)
    a = mlp.train(df, "id", "v", "y", held_out(), [c])
    b = mlp.train(df.repartition(6), "id", "v", "y", held_out(), [c])
    assert np.allclose(a[0][0].parameters, b[0][0].parameters, rtol=1e-9) and np.allclose([h[4:] for h in a[1]], [h[4:] for h in b[1]])  # sums differ in their last bits
    two = mlp.train(df, "id", "v", "y", held_out(), [c], worker=30)
    assert len(two[1]) == 2 and not np.allclose(two[0][0].parameters, a[0][0].parameters)


def test_mean_of_tasks(spark):
    """The state after an epoch is the mean of the tasks' states, weighted by their rows."""
    df, x, y = frame(spark, 90)
    c = mlp.Config(3, 1, epochs=1)
    (m,), _ = mlp.train(df, "id", "v", "y", F.lit(False), [c], worker=40)
    keyed = df.select("id", F.xxhash64(F.col("id").cast("string")).alias("k")).repartition(3, "k").select("id", "k", F.spark_partition_id().alias("p")).collect()
    t, z = (y - y.mean()) / y.std(), (x - x.mean(0)) / x.std(0)
    start, total = np.concatenate([c.start(3), np.zeros(2 * c.size(3))]), 0
    for p in {r.p for r in keyed}:
        own = [r.id for r in sorted((r for r in keyed if r.p == p), key=lambda r: r.k)]
        total = total + len(own) * mlp.steps(start, 0, z[own], t[own], c, c.rate, np.random.default_rng([1, 0, 0]))[0]
    assert np.allclose(m.parameters, np.split(total / 90, 3)[0])


def test_odd_rows(spark):
    df, *_ = frame(spark, 20)
    assert mlp.train(df.limit(0), "id", "v", "y", held_out(), [mlp.Config(2, 0)]) == ([], [])
    nulls = df.select("id", F.when(F.col("id") % 2 == 0, F.col("v")).alias("v"), F.when(F.col("id") % 3 > 0, F.col("y")).alias("y"))
    (m,), history = mlp.train(nulls, "id", "v", "y", F.lit(None).cast("boolean"), [mlp.Config(2, 0, epochs=3)])
    assert len(history) == 3 and history[0][5] is None and np.isfinite(m.parameters).all()
    (m,), history = mlp.train(df, "id", "v", "y", F.lit(True), [mlp.Config(2, 0)])
    assert history == [] and np.isfinite(m.parameters).all()
