"""Buckets of very long documents: bounds are lengths that occur, and cuts below the budget are exact."""

import itertools

from pyspark.sql import functions as F

from uttera.llm import packing


def test_bounds_are_lengths(spark):
    lengths = [3, 10, 16_385, 21_845, 21_845, 21_846, 40_000, 65_536, 70_000, 70_001, 300_001]
    df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, n long")
    got = packing.packed(df, "n", ["doc_id", "n"], 4).collect()
    bounds = sorted({r.bucket_length for r in got})
    assert set(bounds) <= set(lengths) and all(r.bucket_length == min(b for b in bounds if b >= r.n) for r in got)
    least = min(sum(min(b for b in (*c, lengths[-1]) if b >= n) - n for n in lengths) for r in range(4) for c in itertools.combinations(sorted(set(lengths))[:-1], r))
    assert sum(r.bucket_length - r.n for r in got) == least
    whole = packing.packed(df.where("n = 21845"), "n", ["doc_id", "n"], 4).select(F.max("bucket_length")).first()[0]
    assert whole == 21_845  # three fit the budget of 65,536


def test_more_shards(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 2)
    monkeypatch.setattr(packing, "SHARDS", 3)
    got = packing.packed(spark.range(200).select("id", F.lit(1000).alias("n")), "n", ["id"]).collect()
    assert sorted((r.batch, r.slot) for r in got) == [(k // 65, k % 65) for k in range(200)]
