"""Small cases of pooled scores, masked pooling, fold statistics and partitions."""

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from uttera.functions import arrays as A
from uttera.functions import scalars as S
from uttera.operators import evaluation
from uttera.sources import readers


def test_masked_mean(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0]), ([[4.0, 5.0]], [1])], "f array<array<double>>, m array<int>")
    assert [r[0] for r in df.select(A.masked_mean(F.col("f"), F.col("m"))).collect()] == [[2.0, 4.0], [0.0, 0.0], [4.0, 5.0]]


def test_fold_statistics(spark):
    y = [1e6 + v for v in (1.0, 2.0, 4.0, 8.0, 16.0, 3.0)] + [None]
    df = spark.createDataFrame([(k % 3, v) for k, v in enumerate(y)], "fold long, y double")
    got = {r.fold: (r.n, r["mean"], r["std"]) for r in evaluation.fold_statistics(df, "fold", "y", 4).collect()}
    for k in range(4):
        rest = [v for i, v in enumerate(y) if v is not None and i % 3 != k]
        assert got[k][0] == len(rest) and np.isclose(got[k][1], np.mean(rest), rtol=1e-12) and np.isclose(got[k][2], np.std(rest), rtol=1e-6)
    same = spark.createDataFrame([(0, 5.0), (1, 5.0)], "fold long, y double")
    assert [r["std"] for r in evaluation.fold_statistics(same, "fold", "y", 2).collect()] == [1.0, 1.0]
    assert [r.n for r in evaluation.fold_statistics(same.limit(0), "fold", "y", 2).collect()] in ([0, 0], [None, None])


def test_partitions(spark):
    features = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "fileid string, dims int")
    rows = [("train", "a", "44.5"), ("evl", "b", "?"), ("evl", "c", "30"), ("dev", "d", "1")]
    manifest = spark.createDataFrame(rows, "partition string, fileid string, age string")
    got = {r.fileid: (r.partition, r.age, r.dims) for r in readers.partitions(manifest, features).collect()}
    assert got == {"a": ("train", 44.5, 1), "b": ("evl", None, 2), "c": ("evl", None, 3)}
    assert {r.age for r in readers.partitions(spark.createDataFrame([("evl", "c", "30")], manifest.schema), features, unlabelled=()).collect()} == {30.0}
    with pytest.raises(PySparkException, match="no age: a"):
        readers.partitions(spark.createDataFrame([("train", "a", "?")], manifest.schema), features).collect()


def test_intelligibility(spark):
    df = spark.createDataFrame([(v,) for v in (0.083, 0.1, 0.146, 0.3, 1.0)], "w double")
    assert [r[0] for r in df.select(S.intelligibility(F.col("w"))).collect()] == ["excellent", "excellent", "acceptable", "poor", "unintelligible"]
