"""Estimators: scores under mixtures, ridge, boosted trees, random features. Mixtures and kernels: kernels; grid search and support vectors: linear; perceptrons: mlp."""

from __future__ import annotations

import math

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from uttera.functions.arrays import gaussian_log_density, let


def gmm_log_likelihood(x, model):
    """Log likelihood of a vector under a mixture, as a column."""
    logs = F.array(*[F.lit(math.log(max(w, 1e-12))) + gaussian_log_density(x, m, v) for w, m, v in model])
    summed = lambda v, top: top + F.log(F.aggregate(F.transform(v, lambda a: F.exp(a - top)), F.lit(0.0), lambda a, b: a + b))
    return let(logs, lambda v: let(F.array_max(v), lambda top: summed(v, top)))


def ridge(df: DataFrame, vec: str, target: str, alpha: float) -> LinearRegression:
    """Ridge with the penalty alpha * |w|^2 on the sum of squares, intercept free: a fitted Spark model on column x."""
    row = df.agg(F.count(target).alias("n"), F.stddev_pop(target).alias("s")).first()
    rows = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("x"), F.col(target).cast("double").alias("y"))
    reg = alpha / max(1, row["n"]) * (row["s"] or 1.0)
    return LinearRegression(featuresCol="x", labelCol="y", solver="normal", standardization=False, regParam=reg).fit(rows)


def boosted(df: DataFrame, vec: str, target: str, trees: int = 10, depth: int = 3):
    rows = df.select(array_to_vector(F.col(vec).cast("array<double>")).alias("x"), F.col(target).cast("double").alias("y"))
    return GBTRegressor(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=depth, seed=42).fit(rows)


def fourier_features(x, dims: int, n: int = 64, gamma: float = 1.0, seed: int = 7):
    """Random Fourier features of an array column: ridge on them approximates a regression with an RBF kernel."""
    rng = np.random.default_rng(seed)
    w, b = rng.normal(0, math.sqrt(2 * gamma), (n, dims)), rng.uniform(0, 2 * math.pi, n)
    dot = lambda row: F.aggregate(F.zip_with(x, F.array(*[F.lit(float(v)) for v in row]), lambda p, q: p * q), F.lit(0.0), lambda p, q: p + q)
    return F.array(*[F.cos(dot(w[i]) + float(b[i])) * math.sqrt(2 / n) for i in range(n)])


def standardised(df, vector: str, out: str):
    """df with the vectors' dimensions scaled to mean 0 and population standard deviation 1; a constant dimension becomes 0."""
    from pyspark.ml.stat import Summarizer

    if df.isEmpty():
        return df.withColumn(out, F.col(vector))
    v = array_to_vector(F.col(vector))
    row = df.agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s")).select("s.*").first()
    n = row["count"]
    std = np.sqrt(np.maximum(0, row["variance"].toArray() * (n - 1) / n))
    pairs = [F.struct(F.lit(float(m)).alias("m"), F.lit(float(1 / s) if s > 0 else 0.0).alias("w")) for m, s in zip(row["mean"].toArray(), std, strict=True)]
    return df.withColumn(out, F.zip_with(F.col(vector), F.array(*pairs), lambda x, p: (x - p["m"]) * p["w"]))
