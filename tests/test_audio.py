"""Audio: resampling, formats, pitch, resonances, functionals."""

import io
import math
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from uttera.operators import audio
from uttera.session import ship


def tone(hz, rate, seconds=0.5, level=0.5):
    return level * np.sin(2 * np.pi * hz * np.arange(round(seconds * rate)) / rate)


def wav(x, rate, width, channels=1):
    out = io.BytesIO()
    top = 2 ** (8 * width - 1)
    v = np.clip(np.round(np.repeat(np.asarray(x)[:, None], channels, 1) * top), -top, top - 1).astype(np.int64).ravel()
    data = (v + 128).astype(np.uint8).tobytes() if width == 1 else b"".join(int(k).to_bytes(width, "little", signed=True) for k in v)
    with wave.open(out, "wb") as f:
        f.setnchannels(channels)
        f.setsampwidth(width)
        f.setframerate(rate)
        f.writeframes(data)
    return out.getvalue()


@pytest.mark.parametrize("own", [44_100, 48_000, 22_050, 8_000])
def test_tones_stay_and_nothing_aliases(own):
    for hz in (300, 1000, 3000):
        y = audio.resampled(tone(hz, own), own, 16_000)
        assert len(y) == math.ceil(round(0.5 * own) * 16_000 / own)
        assert np.abs(y - tone(hz, 16_000)[: len(y)])[400:-400].max() < 2e-3
    if own > 20_000:
        assert np.abs(audio.resampled(tone(10_000, own), own, 16_000)[400:-400]).max() < 1e-3
    assert np.allclose(audio.resampled(np.ones(3000), own, 16_000)[400:-400], 1)
    assert audio.resampled(np.array([]), own, 16_000).tolist() == [] and audio.resampled(np.ones(3), 16_000, 16_000).tolist() == [1, 1, 1]


@pytest.mark.parametrize(("width", "error"), [(1, 1 / 128), (2, 1e-4), (3, 1e-6), (4, 1e-8)])
def test_widths_channels_and_duration(width, error):
    x = tone(440, 16_000, 0.1)
    for channels in (1, 2):
        raw = wav(x, 16_000, width, channels)
        assert np.abs(audio.decoded(raw) - x).max() <= error
        assert len(audio.decoded(raw, duration=0.05)) == 800 and len(audio.decoded(raw, duration=9.0)) == len(x)
    low = wav(np.array([-1.0, 0.0, 0.5]), 16_000, width)
    assert np.allclose(audio.decoded(low), [-1, 0, 0.5], atol=error)


def test_coercion():
    x = tone(440, 16_000, 0.1)
    same = wav(x, 16_000, 2)
    assert audio.coerced(same) is same
    for raw in (wav(x, 16_000, 3), wav(x, 16_000, 2, 2), wav(tone(440, 8_000, 0.1), 8_000, 2)):
        y, rate, channels, width = audio.samples(audio.coerced(raw))
        assert (rate, channels, width) == (16_000, 1, 2) and np.abs(y - x)[200:-200].max() < 3e-3


def test_columns(spark):
    ship(spark)
    df = spark.createDataFrame([(1, wav(tone(440, 8_000), 8_000, 1)), (2, b"none"), (3, None), (4, b"")], "id int, wav binary")
    got = df.select("id", F.size(audio.decoded_column(F.col("wav"))).alias("n"), audio.coerced_column(F.col("wav")).alias("c")).orderBy("id").collect()
    assert [r.n for r in got][:1] == [8000] and [r.c is None for r in got] == [False, True, True, True] and all(r.n in (None, -1) for r in got[1:])


def test_pitch_within_a_percent():
    for hz in (80, 110, 150.5, 220, 333, 450):
        for rate in (8_000, 16_000, 44_100):
            t = np.arange(rate // 2) / rate
            x = sum(np.sin(2 * np.pi * k * hz * t + k) / k for k in (1, 2, 3, 4))
            d = audio.descriptors(x, rate)
            assert np.abs(d[:, 0] / hz - 1).max() < 0.01 and d[:, 1].min() > 0.8
            assert audio.jitter(d[:, 0]) < 0.005
    noise = audio.descriptors(np.random.default_rng(0).normal(0, 0.1, 16_000))
    assert np.isnan(noise[:, 0]).mean() > 0.8 and np.isnan(audio.descriptors(np.zeros(2000))[:, 0]).all()


def test_levinson_equals_a_direct_solution():
    f = np.random.default_rng(1).normal(size=(5, 200))
    a = audio.predictors(f, 8)
    for row, p in zip(f, a, strict=True):
        r = np.correlate(row, row, "full")[199 : 199 + 9]
        want = np.linalg.solve(r[np.abs(np.arange(8)[:, None] - np.arange(8))], -r[1:])
        assert np.allclose(p[1:], want, atol=1e-5) and p[0] == 1


def test_formants_of_resonators():
    rate, want = 16_000, (700, 1200, 2600)
    x = np.zeros(rate // 2)
    x[:: rate // 100] = 1.0  # pulses
    for hz in want:
        a, b = -2 * math.exp(-math.pi * 60 / rate) * math.cos(2 * math.pi * hz / rate), math.exp(-2 * math.pi * 60 / rate)
        y = np.zeros_like(x)
        for i in range(len(x)):
            y[i] = x[i] - a * y[i - 1] - b * y[i - 2]
        x = y
    got = np.nanmedian(audio.formants(audio._frames(x, 640, 160), rate), 0)
    assert np.abs(got / want - 1).max() < 0.06


def test_functionals():
    rng = np.random.default_rng(2)
    d = rng.normal(size=(30, 3))
    d[::4, 0] = np.nan
    out = audio.functionals(d)
    for k in range(3):
        v, t = d[:, k][~np.isnan(d[:, k])], np.flatnonzero(~np.isnan(d[:, k]))
        want = [v.mean(), v.std(), v.min(), v.max(), *np.percentile(v, [20, 50, 80]), np.polyfit(t, v, 1)[0]]
        assert np.allclose(out[k * 8 : k * 8 + 8], want)
    assert out[-2] == (~np.isnan(d[:, 0])).mean()
    assert len(audio.functionals(audio.descriptors(tone(200, 16_000)))) == len(audio.FEATURES) and np.isfinite(audio.functionals(audio.descriptors(np.zeros(3)))).all()


def test_rows(spark):
    ship(spark)
    df = spark.createDataFrame([(7, tone(200, 16_000, 0.1).tolist()), (8, None)], "id long, x array<double>")
    rows = audio.descriptor_rows(df, "id", "x").orderBy("frame").collect()
    assert [r.frame for r in rows] == list(range(7)) and all(r.id == 7 and abs(r.pitch - 200) < 2 for r in rows)
    v = df.select(audio.functionals_column(F.col("x")).alias("v")).collect()
    assert len(v[0].v) == len(audio.FEATURES) and v[1].v is None


def test_queries(spark):
    import oracle
    from uttera.plans.queries import QUERIES

    ship(spark)
    for r in QUERIES["acoustic_functionals"](spark, oracle.SF).collect():
        if r.hz <= 500:
            assert abs(r.pitch_p50 / r.hz - 1) < 0.02
    for r in QUERIES["audio_coercion"](spark, oracle.SF).collect():
        assert r.unchanged == (r.rate == 16_000) and r.bytes_out == 44 + 2 * math.ceil(1600 * 16_000 / r.rate) and abs(r.rms - 0.177) < 0.02
