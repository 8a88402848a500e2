import math

import numpy as np
from pyspark.sql import functions as F

import oracle
from uttera.llm import permutation_index as pi
from uttera.llm import queries
from uttera.session import ship


def exact(ids, x, query, k=10):
    q = x[ids.index(query)]
    d = [(math.dist(v, q), i) for i, v in zip(ids, x, strict=True) if i != query]
    return [i for _, i in sorted(d)[:k]]


def test_footrule_by_definition():
    rng = np.random.default_rng(0)
    pivots, x = rng.normal(size=(12, 4)), rng.normal(size=(30, 4))
    perm = pi.nearest_pivots(x, pivots, 5)
    files = pi.inverted_files(perm, 12)
    q = pi.nearest_pivots(rng.normal(size=(1, 4)), pivots, 5)[0]
    place = lambda p, row: int(np.flatnonzero(row == p)[0]) if p in row else 5
    got = pi.footrule(files, 30, q)
    assert got.tolist() == [sum(abs(place(p, row) - place(p, q)) for p in range(12)) for row in perm]


def test_recall(spark):
    ship(spark)
    rows = spark.read.parquet(f"{oracle.SF}/embeddings.parquet").collect()
    ids, x = [r.vec_id for r in rows], [list(map(float, r.embedding)) for r in rows]
    found = {}
    for r in queries.queries()["op6_permutation_index"](spark, oracle.SF).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(found) == {i for i in ids if i % 100 == 0}
    hits = 0
    for q, got in found.items():
        got.sort()
        assert [r for r, *_ in got] == list(range(1, 11)) and [(s, v) for _, v, s in got] == sorted((s, v) for _, v, s in got)
        assert all(abs(s - math.dist(x[ids.index(v)], x[ids.index(q)])) < 1e-12 for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(exact(ids, x, q)))
    assert hits >= 0.9 * 10 * len(found)


def test_recall_where_the_index_prunes(spark):
    """More rows than are reranked: the footrule order decides."""
    ship(spark)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = (centres[rng.integers(0, 40, 6000)] + rng.normal(0, 0.35, (6000, 16))).tolist()
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, v array<double>")
    rows = pi.usable(df, "vec_id", "v")
    found = {}
    for r in pi.nearest(rows, rows.where("vec_id % 100 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    a = np.array(x)
    hits = 0
    for q, got in found.items():
        d = ((a - a[q]) ** 2).sum(1)
        d[q] = np.inf
        hits += len(got & set(np.argsort(d)[:10].tolist()))
    assert len(found) == 60 and hits >= 0.9 * 600


def test_odd_rows(spark):
    ship(spark)
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, [1.0]), (None, [1.0, 0.0])]
    rows += [(k, [1.0, 0.0]) for k in range(100, 130)] + [(200, [0.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)).withColumn("block", F.lit(2))
    use = pi.usable(df, "vec_id", "embedding")
    got = {}
    for r in pi.nearest(use, use.where("vec_id % 100 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert [v for _, v, _ in sorted(got[0])] == [1, *range(100, 109)]
    assert [v for _, v, _ in sorted(got[100])] == [0, 1, *range(101, 109)]
    assert sorted(got[200])[0][1] == 0 and len(got[200]) == 10
    assert pi.nearest(use.limit(0), use.limit(0)).count() == 0
