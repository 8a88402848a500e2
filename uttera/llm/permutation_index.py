"""Permutation index: vectors as ordered nearest pivots, pivot inverted files, footrule ranking, exact rerank.

* Pivots are PIVOTS vectors, chosen by a hash of the id (a bounded, documented sample). All rows are indexed.
* A row is represented by its PREFIX nearest pivots in order. Rows are dealt by a hash to blocks of BLOCK
  rows. Inside a block each pivot has an inverted file of (row, position).
* Queries are packed in blocks, too, and STRIP of these meet a block of rows in one task, which builds the block's
  inverted files once; each block of rows meets each strip once. A query reads the inverted files of its own PREFIX pivots and sums the footrule distance |position in row - position in
  query|, a pivot missing on either side counting as position PREFIX. The SHARE of the block with the least
  distance, RERANK rows at least, is reranked by Euclidean distance in double precision.
* Each block of rows leaves k rows a query; the best k of these are the result.

Of rows with equal vectors only the k + 1 with the smallest ids can be among any k nearest, so only they are
indexed: however many copies a vector has, the result is the same.

Defined cases: null vectors, zero vectors, vectors with null or non-finite components, rows without an id and vectors
of another length than most take no part, neither as queries nor as candidates. Rows that repeat id and vector count
once. Ties go to the smaller id. Fewer than k candidates give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from uttera.llm.common import written

PIVOTS, PREFIX, BLOCK, QUERY_BLOCK, STRIP = 256, 64, 8192, 512, 16
RERANK, SHARE = 256, 0.08


def nearest_pivots(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Rows of x to their nearest pivots, nearest first, ties to the smaller number."""
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T
    return np.argsort(d, axis=1, kind="stable")[:, :prefix].astype(np.int16)


def inverted_files(perm: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each pivot the rows that have it and its position there."""
    rows = np.repeat(np.arange(len(perm), dtype=np.int32), perm.shape[1])
    at = np.tile(np.arange(perm.shape[1], dtype=np.int32), len(perm))
    order = np.argsort(perm.ravel(), kind="stable")
    cuts = np.searchsorted(perm.ravel()[order], np.arange(pivots + 1))
    return [(rows[order[a:b]], at[order[a:b]]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def footrule(files: list, n: int, query: np.ndarray) -> np.ndarray:
    """Footrule distance of n rows to one query's pivot order.

    Summed from the state in which no pivot is shared: each shared one replaces (prefix - i) + (prefix - j) by |i - j|.
    """
    prefix = len(query)
    out = np.full(n, prefix * (prefix + 1), np.int32)
    for i, p in enumerate(query):
        rows, at = files[p]
        out[rows] += np.abs(at - i) - (prefix - i) - (prefix - at)
    return out


def usable(vectors: DataFrame, id_: str, vector: str) -> DataFrame:
    """vec_id, v (array<double>) of the rows that take part, without repeated rows."""
    v = F.col(vector).cast("array<double>")
    good = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_).cast("long").alias("vec_id"), v.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.where(good).dropDuplicates(["vec_id", "v"])
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (sizes[0]["n"] if sizes else 0))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _block(table: pa.Table) -> pa.Table:
    """One block of rows as a single row: ids and vectors as bytes."""
    ids = table.column("vec_id").combine_chunks().to_numpy()
    order = np.argsort(ids, kind="stable")
    v = np.ascontiguousarray(_matrix(table.column("v"))[order])
    return pa.table({"block": [table.column("block")[0].as_py()], "ids": [ids[order].tobytes()], "data": [v.tobytes()]}, _BLOCKS)


_BLOCKS = pa.schema([("block", pa.int32()), ("ids", pa.binary()), ("data", pa.binary())])
_BLOCKS_SQL = "block int, ids binary, data binary"


def _search(pivots: np.ndarray, k: int, share: float):
    prefix = min(PREFIX, len(pivots))

    def run(block: pa.Table, strip: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if block.num_rows and strip.num_rows:
            ids = np.frombuffer(block.column("ids")[0].as_py(), np.int64)
            x = np.frombuffer(block.column("data")[0].as_py()).reshape(len(ids), -1)
            files = inverted_files(nearest_pivots(x, pivots, prefix), len(pivots))
            keep = min(len(ids), max(RERANK, int(np.ceil(share * len(ids)))))
            for qids, qdata in zip(strip.column("qids"), strip.column("qdata"), strict=True):
                qids = np.frombuffer(qids.as_py(), np.int64)
                q = np.frombuffer(qdata.as_py()).reshape(len(qids), -1)
                for i, order in enumerate(nearest_pivots(q, pivots, prefix)):
                    near = np.arange(len(ids))
                    if keep < len(ids):
                        near = np.argpartition(footrule(files, len(ids), order), keep - 1)[:keep]
                    near = near[ids[near] != qids[i]]
                    d = np.sqrt(((x[near] - q[i]) ** 2).sum(1))
                    best = np.lexsort((ids[near], d))[:k]
                    out += [(int(qids[i]), int(ids[near[j]]), float(d[j])) for j in best]
        return pa.table([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


def nearest(rows: DataFrame, queries: DataFrame, k: int = 10, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest rows found for each query. Both have vec_id and v, from usable()."""
    rows = written(rows, "vectors")
    w = Window.partitionBy("v").orderBy("vec_id")
    rows = written(rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).drop("r"), "distinct")
    pivots = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(PIVOTS).collect()
    pivots = np.array([r["v"] for r in sorted(pivots, key=lambda r: r["vec_id"])], float)
    n, n_queries = rows.count(), queries.count()
    blocks, query_blocks = max(1, -(-n // BLOCK)), max(1, -(-n_queries // QUERY_BLOCK))

    def packed(df: DataFrame, count: int, name: str) -> DataFrame:
        df = df.select(F.pmod(F.xxhash64("vec_id"), F.lit(count)).cast("int").alias("block"), "vec_id", "v")
        return written(df.groupBy("block").applyInArrow(_block, _BLOCKS_SQL), name)

    strips = -(-query_blocks // STRIP)
    left = packed(rows, blocks, "index").withColumn("strip", F.explode(F.sequence(F.lit(0), F.lit(strips - 1))))
    right = packed(queries, query_blocks, "queries").select((F.col("block") % strips).alias("strip"), F.col("ids").alias("qids"), F.col("data").alias("qdata"))
    right = right.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if not len(pivots):
        pivots = np.zeros((1, 1))
    pairs = left.groupBy("block", "strip").cogroup(right.groupBy("block", "strip"))
    found = pairs.applyInArrow(_search(pivots, k, share), "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
