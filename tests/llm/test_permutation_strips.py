"""Strips of query blocks against a block of rows: nothing is lost, counted twice or left unsearched."""

import numpy as np

from uttera.llm import permutation_index as pi
from uttera.session import ship


def nearest_by_force(a, q, k=10):
    d = np.sqrt(((a - a[q]) ** 2).sum(1))
    d[q] = np.inf
    return np.lexsort((np.arange(len(a)), d))[:k]


def test_every_block_meets_every_strip(spark, monkeypatch):
    ship(spark)
    for name, v in (("BLOCK", 150), ("QUERY_BLOCK", 7), ("STRIP", 3)):
        monkeypatch.setattr(pi, name, v)
    a = np.random.default_rng(3).normal(size=(1_200, 6))
    rows = pi.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(a)], "vec_id long, v array<double>"), "vec_id", "v")
    got = pi.nearest(rows, rows.where("vec_id % 12 = 0"), share=1.0).collect()
    assert len(got) == 1_000
    want = {q: nearest_by_force(a, q).tolist() for q in range(0, 1_200, 12)}
    for r in got:
        assert want[r.query_id][r["rank"] - 1] == r.vec_id
        assert abs(r.score - np.sqrt(((a[r.query_id] - a[r.vec_id]) ** 2).sum())) < 1e-12


def test_recall_on_the_table_and_on_50_000(spark):
    """At the shipped parameters, by brute force: 2,000 rows of the table, and 50,000 vectors in 200 clusters."""
    ship(spark)
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").orderBy("vec_id").toPandas()
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(200, 32))
    many = centres[rng.integers(0, 200, 50_000)] + rng.normal(0, 0.5, (50_000, 32))
    for ids, a in ((table["vec_id"].to_numpy(), np.stack(table["embedding"]).astype(float)), (np.arange(50_000), many)):
        rows = pi.usable(spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, a, strict=True)], "vec_id long, v array<double>"), "vec_id", "v")
        found = {}
        for r in pi.nearest(rows, rows.where("vec_id % 100 = 0")).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        at = {int(i): k for k, i in enumerate(ids)}
        assert set(found) == {i for i in at if i % 100 == 0}
        recall = sum(len(got & {int(ids[k]) for k in nearest_by_force(a, at[q])}) for q, got in found.items()) / (10 * len(found))
        print(f"recall on {len(a)}: {recall:.4f}")
        assert recall >= 0.9
