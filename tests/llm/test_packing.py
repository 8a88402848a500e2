import itertools
import random

import numpy as np
from pyspark.sql import functions as F

from uttera.llm import packing


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= n) - n) for n, c in zip(lengths, counts, strict=True))


def test_bounds_are_optimal():
    rng = random.Random(4)
    for _ in range(40):
        lengths = sorted(rng.sample(range(1, 60), rng.randrange(1, 9)))
        counts = [rng.randrange(1, 20) for _ in lengths]
        for k in (1, 2, 3):
            got = packing.optimal_bounds(np.array(lengths), np.array(counts), k)
            best = min(padding(lengths, counts, (*c, lengths[-1])) for r in range(min(k, len(lengths))) for c in itertools.combinations(lengths[:-1], r))
            assert len(got) <= k and got == sorted(got) and padding(lengths, counts, got) == best
    assert packing.optimal_bounds(np.array([]), np.array([])) == []


def test_bins(spark):
    values = [None, 0, 1, packing.EXACT, packing.EXACT + 1, 20_000, 10**9, 2**20]
    df = spark.createDataFrame([(v,) for v in values], "n long")
    got = [r.b for r in df.select(packing.bin_of(F.col("n")).alias("b")).collect()]
    assert got[:4] == [1, 1, 1, packing.EXACT] and all(b >= v and b <= v * (1 + 1 / 128) for v, b in zip(values[4:], got[4:], strict=True)) and got[-1] == 2**20


def check(rows, budget):
    batches = {}
    for r in rows:
        assert r.bucket_length >= max(1, r.n or 0)
        batches.setdefault((r.bucket_length, r.batch), []).append(r.slot)
    last = {}
    for (b, k), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= max(1, budget // b)
        last[b] = max(last.get(b, 0), k)
    for (b, k), slots in batches.items():
        if k < last[b]:
            assert len(slots) == max(1, budget // b)  # only a bucket's last batch has room
    return batches


def test_batches(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice([3, 3, 3, rng.randrange(1, 900)]), "c", "d") for i in range(700)] + [(1, 3, "c", "d"), (1, 3, "c", "d"), (None, None, None, None), (701, 5000, "c", "d")]
    df = spark.createDataFrame(rows, "doc_id long, n long, batch string, _pk_bin string")
    out = packing.packed(df, "n", ["doc_id", "n"], 5, 2000).withColumnRenamed("batch", "old").withColumnRenamed("_batch", "batch")
    got = out.collect()
    assert len(got) == len(rows) and {r.old for r in got} == {"c", None}
    check(got, 2000)
    assert packing.packed(df.limit(0), "n", ["doc_id", "n"]).count() == 0
