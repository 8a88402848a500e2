"""Sampling, splits, ensembles, frames, models and sources on small cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from uttera.functions import arrays as A
from uttera.functions import scalars as S
from uttera.operators import audio, dsp, evaluation, intervals, kernels, models, sampling
from uttera.session import ship
from uttera.sources import readers, sinks


def test_sampling(spark):
    df = spark.range(300).select("id", (F.col("id") % 3).alias("g"))
    got = sampling.sample_per_group(df, "g", "id", 7).groupBy("g").count().collect()
    assert {r["count"] for r in got} == {7}
    assert sampling.sample_per_group(df, "g", "id", 0).count() == 0
    folds = [r["count"] for r in sampling.kfold(df, "id", 7).groupBy("fold").count().collect()]
    assert len(folds) == 7 and max(folds) - min(folds) <= 1
    ranks = sorted(r["rank"] for r in sampling.hash_rank(df, "id").collect())
    assert ranks == list(range(300))


def test_ensemble(spark):
    df = spark.createDataFrame([("a", 1, 10.0), ("a", 2, 20.0), ("b", 1, 5.0), ("c", 2, 7.0), ("c", 2, 9.0)], "id string, m int, y double")
    full = {r.id: r.hyp for r in evaluation.ensemble(df, {1: 1.0, 2: 3.0}, "id", "m", "y").collect()}
    assert full == {"a": 17.5}
    part = {r.id: r.hyp for r in evaluation.ensemble(df, {1: 1.0, 2: 3.0}, "id", "m", "y", True).collect()}
    assert part == {"a": 17.5, "b": 5.0, "c": 8.0}
    zero = {r.id: r.hyp for r in evaluation.ensemble(df, {1: 0.0, 2: 1.0}, "id", "m", "y", True).collect()}
    assert zero["b"] == 0.0


def loop(trace, gain, patience):
    best, at, bad, stop = float("inf"), -1, 0, None
    for i, x in enumerate(trace):
        if x < best - gain:
            best, at, bad = x, i, 0
        else:
            bad += 1
            if bad >= patience:
                stop = i
                break
    return best, at, stop


def test_early_stop(spark):
    rng = np.random.default_rng(3)
    traces = [np.round(rng.normal(5, 1, 12), 2).tolist() for _ in range(20)] + [[5 - 0.004 * i for i in range(12)]]
    rows = [(k, i, x) for k, t in enumerate(traces) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "k int, i int, x double")
    got = {r.k: (r.best, r.best_step, r.stop_step) for r in evaluation.early_stop(df, ["k"], "i", "x", 0.01, 3).collect()}
    assert got == {k: loop(t, 0.01, 3) for k, t in enumerate(traces)}


def test_alignment(spark):
    a = spark.createDataFrame([(1, 2.0, [1.0]), (2, 3.0, [2.0])], "id int, y double, v array<double>")
    assert evaluation.aligned(a, a, "id", "y", "v").count() == 2
    with pytest.raises(Exception, match="missing id"):
        evaluation.aligned(a, a.where("id = 1"), "id", "y", "v").collect()


def test_report_with_empty_class(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("a", "c")], "r string, h string")
    rep = {r.label: r for r in evaluation.classification_report(evaluation.confusion(df, "r", "h")).collect()}
    assert rep["b"].precision == 0 and rep["b"].support == 0 and rep["a"].recall == pytest.approx(1 / 3, abs=1e-6)


def test_chunks(spark):
    df = spark.createDataFrame([([float(i) for i in range(n)],) for n in (0, 3, 4, 5, 9)], "x array<double>")
    starts = lambda padded, **k: [[c.start for c in r.c] for r in df.select(A.chunks(F.col("x"), 4, 2, padded, **k).alias("c")).collect()]
    assert starts(False) == [[], [], [0], [0], [0, 2, 4]]
    assert starts(True) == [[], [0], [0, 2], [0, 2], [0, 2, 4, 6]]
    long = spark.createDataFrame([([0.0] * 100,)], "x array<double>").select(A.chunks(F.col("x"), 20, 10, True, overlapping_stride=True).alias("c")).first().c
    assert len(long) == 9 and len({c.start // 10 for c in long}) == 9
    with pytest.raises(ValueError):
        A.chunks(F.col("x"), 4, 1, True, overlapping_stride=True)


def test_waveforms(spark):
    df = spark.createDataFrame([([0.0, 0.0, 0.5, -0.2, 0.0],), ([0.0, 0.0],)], "x array<double>")
    assert [r.t for r in df.select(A.trimmed(F.col("x")).alias("t")).collect()] == [[0.5, -0.2], [0.0, 0.0]]
    y = df.select(A.rms_normalised(F.col("x")).alias("y")).first().y
    assert np.sqrt(np.mean(np.square(y))) == pytest.approx(0.1, rel=1e-5)
    seg = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0], [(0.0, 1.0), (2.0, 9.0)])], "x array<double>, s array<struct<start:double,end:double>>")
    assert seg.select(A.segments(F.col("x"), F.col("s"), 1)).first()[0] == [1.0, 3.0, 4.0]
    flat = spark.createDataFrame([([1.0] * 8,)], "x array<double>")
    assert len(flat.select(A.voiced(F.col("x"), F.lit(1.0), F.lit(0.0))).first()[0]) == 8


def test_intervals(spark):
    w = spark.createDataFrame([("u", 0.0, 1.0, "a"), ("u", 1.0, 25.0, "b")], "utt string, start double, end double, label string")
    p = spark.createDataFrame([("u", 0.2, 0.9, "x"), ("u", 0.9, 1.3, "y"), ("u", 20.0, 24.0, "z"), ("u", 0.0, 1.0, "a"), ("u", 30.0, 31.0, "q")], w.schema)
    assert {r.label: r.w_label for r in intervals.midpoint_join(p, w, "utt").collect()} == {"x": "a", "y": "b", "z": "b"}


def test_ridge_equals_closed_form(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 3))
    y = x @ [1.0, -2.0, 0.5] + 3 + rng.normal(0, 0.1, 60)
    df = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y, strict=True)], "v array<double>, y double")
    m = models.ridge(df, "v", "y", 2.0)
    xc, yc = x - x.mean(0), y - y.mean()
    w = np.linalg.solve(xc.T @ xc + 2.0 * np.eye(3), xc.T @ yc)
    assert np.allclose(m.coefficients.toArray(), w, atol=1e-8)


def test_gmm_separates(spark):
    rng = np.random.default_rng(0)
    rows = [(rng.normal(c, 0.1, 2).tolist(),) for c in (0, 3) for _ in range(40)]
    model = kernels.gmm_fit(spark.createDataFrame(rows, "v array<double>"), "v", 2, 8)
    assert sum(w for w, _, _ in model) == pytest.approx(1) and all(v > 0 for _, _, s in model for v in s)


def test_signals(spark):
    t = np.arange(1600)
    p = dsp.power(np.sin(2 * np.pi * 1000 * t / 16000))
    assert int(p.mean(0).argmax()) == 32
    assert dsp.mfcc(np.zeros(100)).shape == (1, 13)
    wav = sinks.wav_bytes([0.5, -0.5, 0.0] * 100)
    assert np.allclose(audio.decoded(wav)[:3], [0.5, -0.5, 0.0], atol=1e-3)
    ship(spark)
    df = spark.createDataFrame([(wav,)], "wav binary").select(audio.decoded_column(F.col("wav")).alias("x"))
    assert len(df.first().x) == 300


def test_scalars(spark):
    df = spark.createDataFrame([("mlp_s_s3", "raw", "7, 8 9")], "tag string, mode string, l string")
    r = df.select(S.without_seed(F.col("tag")).alias("a"), S.cache_key(F.lit("x"), F.col("mode")).alias("b"), S.layers(F.col("l")).alias("c"), S.gender_index(F.lit(" M")).alias("d"), S.gap_verdict(F.lit(1.5)).alias("e")).first()
    assert tuple(r) == ("mlp_s", "x", [7, 8, 9], 1, "moderate")


def test_sources(spark, tmp_path):
    (tmp_path / "info.csv").write_text("wav,gender,age\na.wav,M,44\na.b.wav,F,?\n x.wav , F,44.5\nn.wav,F,NaN\n")
    rows = readers.manifest(spark, str(tmp_path / "info.csv"), "train", "data").collect()
    assert [(r.fileid, r.gender, r.age) for r in rows] == [("a", "M", 44.0), ("a.b", "F", None), ("x", "F", 44.5), ("n", "F", None)]
    (tmp_path / "bad.csv").write_text("wav,age\na.wav,1\n")
    with pytest.raises(readers.MissingColumns):
        readers.manifest(spark, str(tmp_path / "bad.csv"), "train", "data")
    (tmp_path / "t.txt").write_text("0.0\t0.5\tfour\n0.5\t0.9\thours\n")
    assert readers.label_track(spark, str(tmp_path / "t.txt"), "u", "word").count() == 2
    (tmp_path / "m.json").write_text(json.dumps({"train_inner_uuids": ["a", "b"], "dev_inner_uuids": ["c"], "uuid_to_speaker": {"a": "1", "c": "2"}}))
    assert {(r.split, r.uuid, r.speaker) for r in readers.split_manifest(spark, str(tmp_path / "m.json")).collect()} == {("train", "a", "1"), ("train", "b", None), ("dev", "c", "2")}
    cps = spark.createDataFrame([("r1", "checkpoint-9"), ("r1", "checkpoint-10"), ("r2", "final_b"), ("r2", "final_a"), ("r2", "checkpoint-1"), ("r3", ""), ("r3", "final")], "run string, folder string")
    assert {r.run: r.folder for r in readers.checkpoint(cps).collect()} == {"r1": "checkpoint-10", "r2": "final_a", "r3": ""}
    reg = spark.createDataFrame([("train", "local://", None)], "partition string, url string, checksum string")
    assert readers.partition(reg, "train").count() == 1
    (tmp_path / "d").mkdir()
    for d, b in (("d", b"1"), ("", b"2")):
        (tmp_path / d / "s.wav").write_bytes(b)
    assert readers.audio_files(spark, str(tmp_path)).count() == 1


def test_fetch_pushes_ids_down(spark, tmp_path):
    p = str(tmp_path / "a")
    spark.range(100).select(F.col("id").cast("string").alias("ID"), F.struct(F.lit(b"x").alias("bytes")).alias("wav"), F.lit(1).alias("other")).write.parquet(p)
    df = readers.fetch(spark, [p], ["3", "5", "700"])
    assert df.count() == 2
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "In(ID" in plan and "other" not in plan.split("ReadSchema")[-1]
    wanted = spark.createDataFrame([("3",), ("700",)], "ID string")
    assert [r.ID for r in readers.missing(wanted, df).collect()] == ["700"]
