"""Packing: optimal length buckets by dynamic programming, token-budget batches inside each bucket.

1. One grouped aggregation makes the global histogram of lengths. Lengths up to EXACT, the token budget, have a bin each;
   above, bins widen by 1/256, so the histogram is bounded whatever the lengths. Each bin keeps its largest length.
2. Dynamic programming over the histogram picks at most `buckets` upper bounds with the least padding. A bound
   is the largest length of its bucket. Only cuts between lengths over EXACT are as coarse as the bins.
3. A document goes to the smallest bound that holds it. A batch of a bucket holds as many documents as
   fit the token budget when each is padded to the bound, one at least.

Batches are numbered over the whole bucket, yet no task sorts a whole bucket: documents are dealt to shards by a hash,
numbered inside (bucket, shard), and shifted by the sizes of the shards before, a table of at most buckets rows for each SHARD
documents.

Defined cases: a null length counts as 0, and documents of length 0 take a slot as of length 1. A document
longer than the budget is a batch of its own. Ties and repeated rows are ordered by the columns of the
row and numbered apart. An empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from uttera.llm.common import free_name, written

BUCKETS, BUDGET = 16, 65_536
EXACT = BUDGET
#: Shards at least, and documents for which there is one more.
SHARDS, SHARD = 256, 1_000_000


def bin_of(length: Column) -> Column:
    """Upper end of the bin of a length: itself up to EXACT, then steps of 1/256 of the next lower power of two."""
    length = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(1))
    step = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), F.floor(F.log2(length.cast("double"))) - 8)).cast("long")
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / step).cast("long") * step)


def optimal_bounds(lengths: np.ndarray, counts: np.ndarray, buckets: int = BUCKETS) -> list[int]:
    """Upper bounds, ascending, at most `buckets`, that minimise the sum of bound - length over all documents.

    cost[k][j] is the least padding of the j shortest bins in k buckets. The best split point doesn't
    fall as j grows (the cost is Monge), so each layer is solved by divide and conquer in n log n.
    """
    n = len(lengths)
    if not n:
        return []
    lengths, counts = lengths.astype(float), counts.astype(float)
    number, total = np.r_[0, counts.cumsum()], np.r_[0, (counts * lengths).cumsum()]
    best = np.r_[0, np.full(n, np.inf)]
    choice = []
    for _ in range(min(buckets, n)):
        nxt, at = np.full(n + 1, np.inf), np.zeros(n + 1, int)
        nxt[0] = 0
        stack = [(1, n, 0, n - 1)]
        while stack:
            lo, hi, left, right = stack.pop()
            if lo > hi:
                continue
            j = (lo + hi) // 2
            i = np.arange(left, min(right, j - 1) + 1)
            cost = best[i] + lengths[j - 1] * (number[j] - number[i]) - (total[j] - total[i])
            k = int(cost.argmin())
            nxt[j], at[j] = cost[k], i[k]
            stack += [(lo, j - 1, left, int(i[k])), (j + 1, hi, int(i[k]), right)]
        choice.append(at)
        best = nxt
    bounds, j = [], n
    for at in reversed(choice):
        if j == 0:
            break
        bounds.append(int(lengths[j - 1]))
        j = int(at[j])
    return bounds[::-1]


def histogram(docs: DataFrame, length: Column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bins, the largest length in each, and counts over all rows; at most EXACT bins + 256 for each further power of two."""
    true = F.greatest(F.coalesce(length.cast("long"), F.lit(0)), F.lit(1))
    rows = docs.groupBy(bin_of(length).alias("bin")).agg(F.max(true).alias("most"), F.count("*").alias("n")).collect()
    rows = sorted((r["bin"], r["most"], r["n"]) for r in rows)
    return tuple(np.array([r[k] for r in rows], np.int64) for k in range(3))


def packed(docs: DataFrame, length: str, order: list[str], buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """docs with bucket_length, batch (number in its bucket), slot (number in its batch).

    `order` are columns that order rows inside a shard. Names that docs has already stay, the new ones get underscores.
    """
    bins, lengths, counts = histogram(docs, F.col(length))
    bounds = optimal_bounds(lengths, counts, buckets)
    ends = dict(zip(lengths.tolist(), bins.tolist(), strict=True))  # of a bound the end of its bin
    shards = max(SHARDS, int(counts.sum()) // SHARD)
    names = {c: free_name(docs, c) for c in ("bucket_length", "batch", "slot")}
    bin_, shard, rn = (free_name(docs, x) for x in ("_pk_bin", "_pk_shard", "_pk_rn"))
    bucket = F.lit(bounds[-1] if bounds else 1).cast("long")
    for b in reversed(bounds[:-1]):
        bucket = F.when(F.col(bin_) <= ends[b], F.lit(b).cast("long")).otherwise(bucket)
    rows = docs.withColumn(bin_, bin_of(F.col(length))).withColumn(names["bucket_length"], bucket).drop(bin_)
    rows = rows.withColumn(shard, F.pmod(F.xxhash64(*order), F.lit(shards)).cast("int"))
    key = [names["bucket_length"], shard]
    start, size_of = free_name(docs, "_pk_start"), free_name(docs, "_pk_size")
    before = Window.partitionBy(key[0]).orderBy(shard).rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(*key).agg(F.count("*").alias(size_of)).withColumn(start, F.sum(size_of).over(before)).drop(size_of)
    rows = rows.withColumn(rn, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
    rows = rows.join(starts, key, "left")  # dealt as the window is, so rows don't move again
    at = F.coalesce(F.col(start), F.lit(0)) + F.col(rn) - 1
    size = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.col(key[0])))
    rows = rows.withColumn(names["batch"], F.floor(at / size).cast("long")).withColumn(names["slot"], (at - F.floor(at / size) * size).cast("long"))
    return rows.drop(shard, rn, start)


def packing_plan(docs: DataFrame, n_tokens: Column, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """doc_id, n_tokens, bucket_length, batch, slot; lengths are counted once and written, texts aren't shuffled."""
    light = written(docs.select("doc_id", n_tokens.alias("n_tokens")), "lengths")
    return packed(light, "n_tokens", ["doc_id", "n_tokens"], buckets, budget)
