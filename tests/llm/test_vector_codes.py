"""Vector codes against brute force in Python integers."""

import hashlib
import math

import numpy as np
import pytest

from uttera.llm import vector_codes as vc
from uttera.session import ship


def brute(rows, parts=16, entries=64, rounds=2):
    """rows: (id, vector, label), all kept. Codes and errors in id order, and the digest."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = [[math.floor(256 * v) for v in r[1]] for r in rows]
    w = len(x[0]) // parts
    cut = [[v[p * w : p * w + w] for v in x] for p in range(parts)]
    books = [[list(v) for v in c[:entries]] for c in cut]
    far = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    assign = lambda p: [min(range(len(books[p])), key=lambda e: (far(v, books[p][e]), e)) for v in cut[p]]
    for _ in range(rounds):
        for p in range(parts):
            a = assign(p)
            for e in range(len(books[p])):
                own = [v for v, i in zip(cut[p], a, strict=True) if i == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    last = [assign(p) for p in range(parts)]
    errors = [sum(far(cut[p][i], books[p][last[p][i]]) for p in range(parts)) for i in range(len(rows))]
    of = {}
    for r, e in zip(rows, errors, strict=True):
        of[r[2]] = of.get(r[2], 0) + e
    h = hashlib.sha256(",".join(str(v) for b in books for e in b for v in e).encode()).hexdigest()
    fits = lambda v: v if v < 1 << 63 else None
    whole = {k: all(e < 1 << 63 for r, e in zip(rows, errors, strict=True) if r[2] == k) for k in of}
    return sorted((str(r[0]), "".join(f"{last[p][i]:02x}" for p in range(parts)), fits(errors[i]), fits(of[r[2]]) if whole[r[2]] else None, h) for i, r in enumerate(rows))


def run(spark, rows, kind="array<float>", **kw):
    ship(spark)
    df = spark.createDataFrame(rows, f"vec_id long, embedding {kind}, label int, code string").repartition(3)
    out = vc.vector_codes(df, **kw).drop("measured_share")
    assert out.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    return sorted((str(r[0]), *r[1:]) for r in out.collect())


@pytest.mark.parametrize("spread", [0.01, 1.0])
def test_equals_brute_force(spark, spread):
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, spread, (150, 32)), 2).astype(np.float32).astype(float).tolist()
    rows = [(int(i * 7 % 150), v, [None, 1, 2][i % 3], "x") for i, v in enumerate(x)]
    assert run(spark, rows) == brute(rows)


def test_dropped_rows_ties_and_copies(spark):
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (90, 16)).astype(float).tolist()
    rows = [(i // 2, v, 1, None) for i, v in enumerate(x)] + [(None, [0.0] * 16, None, None), (500, [0.0] * 16, 2, None)]
    odd = [(-5, None, 1, ""), (-4, [], 1, ""), (-3, [1.0] * 15, 1, ""), (-2, [float("nan")] * 16, 1, ""), (-1, [float("-inf")] + [0.0] * 15, 1, ""), (-1, [None] + [0.0] * 15, 1, ""), (900, [1.0] * 32, 1, "")]
    assert run(spark, rows + odd) == brute(rows)


def test_few_rows_and_none(spark):
    rows = [(2, [1.0] * 16, None, None), (1, [-0.001] * 16, None, None)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_integers_beyond_64_bits(spark):
    rows = [(i, [(-1) ** i * 1e30 * (i % 7 + 1)] * 8 + [float(i)] * 8, i % 2, None) for i in range(80)] + [(100 + i, [3e6 * i] * 16, 5, None) for i in range(40)]
    assert run(spark, rows, "array<double>") == brute(rows)
    assert [v for limbs in (vc._limbs(-5), vc._limbs(3 << 130)) for v in [sum(d << 40 * i for i, d in enumerate(limbs))]] == [-5, 3 << 130]


def test_many_labels_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(vc, "BROADCAST_LABELS", 0)
    rows = [(i, [float(i % 5)] * 16, None if i % 3 == 0 else i % 4, None) for i in range(70)]
    assert run(spark, rows) == brute(rows)


def test_annulus_measures_less_and_finds_the_same():
    rng = np.random.default_rng(5)
    for hard in (False, True):
        entries = rng.integers(-300, 300, (64, 4)) if not hard else rng.integers(-1, 2, (64, 4))
        x = rng.integers(-300, 300, (2000, 4)) if not hard else rng.integers(-1, 2, (2000, 4))
        index, best, measured = vc.Codebook(entries).nearest(x)
        d = ((x[:, None] - entries[None]) ** 2).sum(2)
        assert (index == d.argmin(1)).all() and (best == d.min(1)).all()
        assert measured < d.size  # by how much depends on how far the norms lie apart
    one = vc.Codebook(np.array([[5, 5]])).nearest(np.array([[1, 2], [5, 5]]))
    assert one[0].tolist() == [0, 0] and one[1].tolist() == [25, 0]
