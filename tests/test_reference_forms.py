"""Signal features against independent computations, sinks and sources, and empty or short inputs."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression, LinearRegressionModel
from pyspark.sql import functions as F

from uttera.functions import arrays as A
from uttera.operators import dsp, models
from uttera.sources import readers, sinks


def array(spark, *rows):
    return spark.createDataFrame([(list(map(float, r)),) for r in rows], "x array<double>")


def test_empty_and_zero(spark):
    x = F.col("x")
    df = array(spark, [], [0, 0], [1e-5, -1e-5, 1e-5])
    got = df.select(A.mean(x).alias("m"), A.std(x).alias("s"), A.rms_normalised(x).alias("r"), A.cosine(x, x).alias("c"), A.delta(x).alias("d"), A.trimmed(x, frame=4, hop=2).alias("t")).collect()
    assert (got[0].m, got[0].s, got[0].r, got[0].c, got[0].d, got[0].t) == (None, None, [], None, [], [])
    assert got[1].r == [0.0, 0.0] and got[1].c is None and got[1].t == [0.0, 0.0]
    assert max(got[2].r) == pytest.approx(1e-5 * 0.1 / np.sqrt(1e-10 + 1e-8))


def trim(y, top_db, frame, hop):
    half = frame // 2
    padded = np.concatenate([np.zeros(half), y, np.zeros(half)])
    p = np.array([(padded[a : a + frame] ** 2).mean() for a in range(0, len(padded) - frame + 1, hop)])
    loud = np.flatnonzero(10 * np.log10(np.maximum(1e-10, p)) - 10 * np.log10(max(1e-10, p.max())) > -top_db)
    return y[loud[0] * hop : min(len(y), (loud[-1] + 1) * hop)]


def test_trim_by_frames(spark):
    rng = np.random.default_rng(1)
    rows = [np.concatenate([np.zeros(a), rng.normal(size=b), 1e-4 * rng.normal(size=c)]) for a, b, c in ((0, 5, 0), (30, 40, 50), (7, 1, 90), (3, 0, 20), (1, 64, 0))]
    for frame, hop in ((8, 4), (16, 3), (1, 1)):
        got = [r.t for r in array(spark, *rows).select(A.trimmed(F.col("x"), 30.0, frame, hop).alias("t")).collect()]
        assert all(np.allclose(g, trim(y, 30, frame, hop)) for g, y in zip(got, rows, strict=True))


def test_preprocessing(spark):
    x = F.col("x")
    df = array(spark, [0, 0, 0, 0, 3, 4, 0, 0, 0, 0]).withColumn("s", F.expr("array(struct(0.4 AS start, 0.6 AS end))"))
    of = lambda mode, **k: df.select(A.preprocessed(x, mode, rate=10, frame=2, hop=1, **k).alias("y")).first().y
    assert of("raw") == df.first().x and of("vad", spans=F.col("s")) == [3.0, 4.0]
    assert of("vad_rms", spans=F.col("s")) == pytest.approx([0.1 * v / np.sqrt(12.5 + 1e-8) for v in (3, 4)])
    assert of("vad", spans=F.expr("array(struct(5.0 AS start, 6.0 AS end))")) == df.first().x
    for bad in ("loud", "vad"):
        with pytest.raises(ValueError):
            A.preprocessed(x, bad)


def test_slopes(spark):
    t = np.arange(20.0)
    y = 3 * t**2 - t
    one, two = (np.array(array(spark, y).select(A.delta(F.col("x"), 9, o, True).alias("d")).first().d) for o in (1, 2))
    assert np.allclose(two, 6) and np.allclose(one[4:-4], 6 * t[4:-4] - 1) and np.allclose(one[:4], one[4]) and len(one) == 20
    assert np.allclose(dsp.slopes(y[:, None], 1)[:, 0], one) and np.allclose(dsp.slopes(y[:, None], 2)[:, 0], two)


def plain_mfcc(y):
    """Straight from the definitions, one frame and one filter at a time."""
    n, hop, rate = 512, 160, 16_000
    mel = lambda f: f * 3 / 200 if f < 1000 else 15 + np.log(f / 1000) * 27 / np.log(6.4)
    hz = lambda m: m * 200 / 3 if m < 15 else 1000 * np.exp((m - 15) * np.log(6.4) / 27)
    edges = [hz(mel(50) + (mel(7800) - mel(50)) * k / 41) for k in range(42)]
    padded = np.concatenate([np.zeros(256), y, np.zeros(256)])
    window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)
    rows = []
    for a in range(0, len(y) + 1, hop):
        p = np.abs(np.fft.rfft(padded[a : a + n] * window)) ** 2
        row = []
        for lo, mid, hi in zip(edges, edges[1:], edges[2:]):
            w = [max(0, min((f - lo) / (mid - lo), (hi - f) / (hi - mid))) * 2 / (hi - lo) for f in np.arange(257) * rate / n]
            row.append(float(p @ w))
        rows.append(row)
    db = 10 * np.log10(np.maximum(1e-10, rows))
    db = np.maximum(db, db.max() - 80)
    k = np.arange(40)
    return np.stack([(db * np.cos(np.pi * c * (2 * k + 1) / 80)).sum(1) * np.sqrt((1 if c == 0 else 2) / 40) for c in range(13)], 1)


def test_mfcc_values():
    y = np.random.default_rng(2).normal(size=3_000) * np.linspace(0, 1, 3_000)
    want = plain_mfcc(y)
    assert np.allclose(dsp.mfcc(y), want, atol=1e-6) and len(want) == 1 + 3_000 // 160
    full = dsp.mfcc(y, remove_c0=True, delta_order=2, cmvn=True, skip_frames=2)
    still = want[:, 1:]
    whole = np.concatenate([still, dsp.slopes(still, 1), dsp.slopes(still, 2)], 1)
    assert np.allclose(full, ((whole - whole.mean(0)) / (whole.std(0) + 1e-8))[2:-2], atol=1e-5)
    kept = want[:, 0] > want[:, 0].mean() - want[:, 0].std()
    assert np.allclose(dsp.mfcc(y, vad=True), want[kept], atol=1e-6) and 5 <= kept.sum() < len(want)


def test_feature_cache(spark, tmp_path):
    path = f"{tmp_path}/cache"
    rows = lambda t, p, v: spark.createDataFrame([("f", v, t, p)], "fileid string, v int, transform_id string, partition string")
    sinks.cache_features(rows("a", "train", 1), path)
    sinks.cache_features(rows("b", "train", 2).union(rows("a", "dev", 3)).union(rows("a", "train", 9)), path)
    assert sorted((r.transform_id, r.partition, r.v) for r in spark.read.parquet(path).collect()) == [("a", "dev", 3), ("a", "train", 1), ("b", "train", 2)]


def test_results_and_models(spark, tmp_path):
    todo = spark.createDataFrame([(k, 1) for k in range(4)], "run int, seed int")
    path = f"{tmp_path}/results"
    assert readers.resumed(todo, path, ["run"]).count() == 4
    sinks.append_results(spark.createDataFrame([(0, "ok", 1.0), (1, "failed", None)], "run int, status string, mae double"), path)
    assert {r.run for r in readers.resumed(todo, path, ["run"]).collect()} == {1, 2, 3}
    for y in (1.0, 2.0):
        sinks.predictions_table(spark.createDataFrame([("a", y)], "fileid string, hyp double"), f"{tmp_path}/pred", "r1")
    assert [(r.fileid, r.hyp, r.run) for r in spark.read.parquet(f"{tmp_path}/pred").collect()] == [("a", 2.0, "r1")]
    df = spark.createDataFrame([(Vectors.dense([float(k)]), 2.0 * k) for k in range(5)], ["features", "label"])
    model = LinearRegression().fit(df)
    sinks.save_model(model, f"{tmp_path}/model")
    got = readers.load_model(f"{tmp_path}/model")
    assert isinstance(got, LinearRegressionModel) and got.coefficients == model.coefficients


def test_checksum(spark, tmp_path):
    (tmp_path / "a.tar").write_bytes(b"abc")
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.tar"))
    assert readers.verified(files, "BA7816bf").count() == 1
    with pytest.raises(Exception, match="wrong checksum"):
        readers.verified(files, "00").collect()


def test_constant_dimension(spark):
    got = [r.z for r in models.standardised(array(spark, [1, 5], [3, 5]), "x", "z").collect()]
    assert got == [[-1.0, 0.0], [1.0, 0.0]]
    assert models.standardised(array(spark).limit(0), "x", "z").count() == 0
