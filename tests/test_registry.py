"""Transforms and estimators by name, in pipelines that are saved and loaded."""

import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from test_audio import tone, wav
from uttera.operators import audio, evaluation, registry
from uttera.operators.registry import ColumnTransform
from uttera.session import ship


def files(spark, n=24):
    ship(spark)
    rows = [(i, wav(tone(100 + 12 * i, 16_000, 0.2) + 0.001 * np.random.default_rng(i).normal(size=3200), 16_000, 2), 100.0 + 12 * i, 1.0 if i > n / 2 else -1.0) for i in range(n)]
    return spark.createDataFrame(rows, "id long, wav binary, hz double, side double").repartition(3)


def test_from_files_to_metrics_and_back(spark, tmp_path):
    df = files(spark)
    fitted = registry.pipeline("prosody", "ridge", "hz", penalty=1e-3).fit(df)
    rows = fitted.transform(df).select("id", "hz", F.col("prediction").alias("hyp"))
    m = evaluation.metrics(rows, [], "hz", "hyp").first()
    assert m.n == 24 and m.mae < 2
    fitted.write().overwrite().save(str(tmp_path / "model"))
    again = PipelineModel.load(str(tmp_path / "model")).transform(df).select("id", "hz", F.col("prediction").alias("hyp"))
    assert sorted(rows.collect()) == sorted(again.collect())
    registry.pipeline("prosody", "ridge", "hz").write().overwrite().save(str(tmp_path / "plan"))
    plan = Pipeline.load(str(tmp_path / "plan"))
    assert [type(s).__name__ for s in plan.getStages()] == ["ColumnTransform", "ColumnTransform", "LinearEstimator"]
    sides = registry.pipeline("spectral", "svc_linear", "side").fit(df).transform(df).select("side", "prediction").collect()
    assert sum(r.side == r.prediction for r in sides) >= 22
    with pytest.raises(KeyError):
        registry.extractor("none")


def test_feature_sets(spark):
    df = files(spark, 2)
    for name, size in (("prosody", 3 * 8 + 2), ("spectral", 4 * 8), ("all", len(audio.FEATURES))):
        stages = registry.extractor(name)
        out = Pipeline(stages=stages).fit(df).transform(df)
        assert registry.dimension(out, "features") == size
    assert registry.dimension(out.limit(0), "features") == 0
    with pytest.raises(ValueError):
        registry.dimension(spark.createDataFrame([([1.0],), ([1.0, 2.0],)], "v array<double>"), "v")


def test_chunk_transforms(spark):
    x = list(map(float, range(10)))
    df = spark.createDataFrame([(x,), ([1.0],), ([],)], "x array<double>")

    def run(**options):
        return [r.y for r in ColumnTransform(inputCol="x", outputCol="y", name="chunks", options=json.dumps(options)).transform(df).collect()]

    assert run(size=4, hop=4) == [x[:8], [1.0], []]
    assert run(size=4, hop=3, transform="mean") == [[1.5, 4.5, 7.5], [1.0], []]
    assert run(size=4, hop=4, pad=True, transform="mean")[0] == [1.5, 5.5, 17 / 4]
    rms = run(size=5, hop=5, transform="rms", options={"target": 1.0})[0]
    assert np.isclose(np.sqrt(np.mean(np.square(rms[5:]))), 1, atol=0.3) and len(rms) == 10
    cmvn = run(size=5, hop=5, transform="cmvn")[0]
    assert np.isclose(np.mean(cmvn[:5]), 0, atol=1e-9) and np.isclose(np.std(cmvn[5:]), 1, atol=1e-6)


def test_each_transform_runs(spark):
    df = files(spark, 2).withColumn("x", audio.decoded_column(F.col("wav")))
    for name, options in (("rms", {}), ("trim", {}), ("mfcc", {"n_mfcc": 5}), ("functionals", {"feature_set": "prosody"})):
        out = ColumnTransform(inputCol="x", outputCol="y", name=name, options=json.dumps(options)).transform(df)
        assert all(len(r.y) for r in out.select("y").collect())
    frames = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]],)], "x array<array<double>>")
    assert ColumnTransform(inputCol="x", outputCol="y", name="mean_frames").transform(frames).first().y == [2.0, 4.0]
