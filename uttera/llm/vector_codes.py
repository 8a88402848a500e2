"""Vector codes: each part of a vector becomes the index of the nearest entry of its codebook, found by annular norm pruning.

* Components become integers, floor(256 x), so that every distance, sum and mean is exact. Vectors are cut into PARTS equal parts.
* A codebook's entries are sorted by norm. For a part x, the entry nearest in norm gives a first distance d. By the triangle
  inequality an entry nearer than d has a norm in [|x| - d, |x| + d]; binary search finds that interval, and its entries,
  bounds included, are measured exactly from the middle outward while each improvement narrows it. Ties go to the lower index,
  which is why the bounds belong to the interval; they are widened by the rounding error of the square roots.
* Lloyd's rounds: tasks sum parts by entry, Spark adds these sums, the driver gets one row for each component of an entry
  (ENTRIES x dimensions at most, whatever the table holds) and hands the next codebooks to all tasks.

Sums are carried in limbs of 40 bits, and parts whose integers could leave 64 bits are computed in Python integers: any finite
component is coded exactly.

Defined cases: rows whose vector is null, holds null or non-finite components, is empty or can't be cut into PARTS equal parts are
dropped, so are vectors of another length than that of the smallest id's. Zero vectors stay. The smallest ids are taken in order of id,
nulls last, then of vector; repeated rows and ids all stay. Under ENTRIES rows give as many entries. An empty table gives an empty
result. error and label_error are null where a sum leaves 64 bits. Null labels are one label. Other columns are passed over.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from uttera.llm.common import salted_lookup, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Integers up to this leave room for the squares of a part's differences in 64 bits.
SMALL = 1 << 28
#: A table of label sums up to this is broadcast.
BROADCAST_LABELS = 100_000
LIMB, LIMBS = 40, 4


def scaled(values: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x) as 64-bit integers, or as Python integers where they don't fit."""
    v = np.floor(values.astype(np.float64) * scale)
    if not v.size or np.abs(v).max() <= SMALL:
        return v.astype(np.int64)
    return np.frompyfunc(int, 1, 1)(v)


def _roots(x: np.ndarray) -> np.ndarray:
    """Norms of the rows of x, as doubles."""
    return np.sqrt((x * x).sum(1).astype(np.float64))


class Codebook:
    """Entries of one part, sorted by norm for the search; indexes are those of the given order."""

    def __init__(self, entries: np.ndarray):
        self.norms = _roots(entries)
        self.order = np.argsort(self.norms, kind="stable")
        self.norms, self.sorted = self.norms[self.order], entries[self.order]

    def interval(self, norm: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First entry of the annulus and the one after its last, by place in the order of norms."""
        d = np.sqrt(best.astype(np.float64))
        d = d + 1e-9 * (1 + d + norm)
        return np.searchsorted(self.norms, norm - d, "left"), np.searchsorted(self.norms, norm + d, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Index and squared distance of the entry nearest to each row, and the number of distances measured."""
        k, norm = len(self.norms), _roots(x)
        at = np.clip(np.searchsorted(self.norms, norm), 1, max(1, k - 1))
        start = np.minimum(at - (norm - self.norms[at - 1] <= self.norms[np.minimum(at, k - 1)] - norm), k - 1)
        best, index, measured = ((x - self.sorted[start]) ** 2).sum(1), self.order[start], len(x)
        low, high = self.interval(norm, best)
        for step in range(1, k):
            todo = 0
            for place in (start - step, start + step):
                rows = np.flatnonzero((place >= low) & (place < high))
                if not len(rows):
                    continue
                todo += len(rows)
                e = place[rows]
                d = ((x[rows] - self.sorted[e]) ** 2).sum(1)
                nearer = d < best[rows]
                take = (nearer | ((d == best[rows]) & (self.order[e] < index[rows]))).astype(bool)
                best[rows[take]], index[rows[take]] = d[take], self.order[e][take]
                if nearer.any():
                    narrowed = rows[nearer.astype(bool)]
                    low[narrowed], high[narrowed] = self.interval(norm[narrowed], best[narrowed])
            measured += todo
            if not todo:  # both sides have left every annulus, which has no gaps
                break
        return index, best, measured


def kept(vectors: DataFrame, vector: str, parts: int = PARTS) -> Column:
    """Whether a row's vector takes part, but for its length."""
    v = F.col(vector).cast("array<double>")
    whole = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(v) > 0) & (F.size(v) % parts == 0) & whole


def _matrix(column: pa.Array) -> np.ndarray:
    return scaled(column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)) if len(column) else np.zeros((0, 0), np.int64)


def _assigned(x: np.ndarray, books: list[Codebook]) -> tuple[np.ndarray, list[np.ndarray], int]:
    """Indexes (rows x parts), squared distances by part, and the number of distances measured."""
    found = [b.nearest(x[:, s]) for b, s in zip(books, _slices(x.shape[1], len(books)), strict=True)]
    return np.stack([f[0] for f in found], 1), [f[1] for f in found], sum(f[2] for f in found)


def _slices(n: int, parts: int) -> list[slice]:
    return [slice(i * n // parts, (i + 1) * n // parts) for i in range(parts)]


def _sums(codebooks: list[np.ndarray]):
    """From batches of vectors to the task's sums: part, entry, position, limbs of the sum, count."""
    books = [Codebook(b) for b in codebooks]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(b.shape, object) for b in codebooks]
        counts = [np.zeros(len(b), np.int64) for b in codebooks]
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(0))
            index = _assigned(x, books)[0]
            for p, s in enumerate(_slices(x.shape[1], len(books))):
                part = np.zeros(codebooks[p].shape, x.dtype)
                np.add.at(part, index[:, p], x[:, s])
                sums[p] += part
                counts[p] += np.bincount(index[:, p], minlength=len(counts[p]))
        rows = [(p, e, i, *_limbs(int(v)), int(counts[p][e])) for p, s in enumerate(sums) for e, row in enumerate(s) if counts[p][e] for i, v in enumerate(row)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), [pa.int32()] * 3 + [pa.int64()] * (LIMBS + 1), strict=True)], _SUM_NAMES)

    return run


_SUM_NAMES = ["part", "entry", "position", *[f"limb{i}" for i in range(LIMBS)], "n"]
_SUM_SQL = ", ".join(f"{c} {'int' if i < 3 else 'long'}" for i, c in enumerate(_SUM_NAMES))


def _limbs(v: int) -> list[int]:
    """v in digits of LIMB bits, the last one signed and without bound."""
    return [(v >> LIMB * i) & ((1 << LIMB) - 1) for i in range(LIMBS - 1)] + [v >> LIMB * (LIMBS - 1)]


def first_codebooks(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the vectors of the smallest ids: rows have vec_id and v, one length."""
    seeds = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()
    x = scaled(np.array([r["v"] for r in seeds], float))
    return [x[:, s] for s in _slices(x.shape[1], parts)] if len(seeds) else []


def next_codebooks(rows: DataFrame, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """Every entry replaced by the floored mean of its parts; entries without parts stay."""
    sums = rows.select("v").mapInArrow(_sums(codebooks), _SUM_SQL).groupBy("part", "entry", "position").agg(*[F.sum(c).alias(c) for c in _SUM_NAMES[3:]])
    out = [b.astype(object) for b in codebooks]
    for r in sums.collect():  # a row for each component of each entry at most
        out[r["part"]][r["entry"], r["position"]] = sum(r[f"limb{i}"] << LIMB * i for i in range(LIMBS)) // r["n"]
    return [b.astype(np.int64) if all(abs(int(v)) <= SMALL for v in b.ravel()) else b for b in out]


def _codes(codebooks: list[np.ndarray]):
    books = [Codebook(b) for b in codebooks]
    digits = np.array([f"{i:02x}" for i in range(max(len(b) for b in codebooks))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            index, far, measured = _assigned(_matrix(batch.column("v")), books)
            error = [e if (e := int(sum(map(int, d)))) < 1 << 63 else None for d in zip(*far, strict=True)]
            code = ["".join(r) for r in digits[index]]
            share = np.full(len(code), measured / (len(code) * len(books) * max(1, len(codebooks[0]))))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(code, pa.string()), pa.array(error, pa.int64()), pa.array(share)], ["vec_id", "label", "code", "error", "measured_share"])

    return run


def digest(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and position."""
    return hashlib.sha256(",".join(str(int(v)) for b in codebooks for v in b.ravel()).encode()).hexdigest()


def vector_codes(vectors: DataFrame, id_: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256, and the share of all distances that was measured in the row's batch."""
    if entries > 256:
        raise ValueError("a code has two hex digits: 256 entries at most")
    rows = vectors.where(kept(vectors, vector, parts)).select(F.col(id_).alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    first = rows.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not first:
        empty = rows.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"), F.lit(0.0).alias("measured_share"))
        return empty.where(F.lit(False))
    rows = rows.where(F.size("v") == len(first[0]["v"]))
    codebooks = first_codebooks(rows, parts, entries)
    for _ in range(rounds):
        codebooks = next_codebooks(rows, codebooks)
    kinds = dict(rows.dtypes)
    coded = written(rows.mapInArrow(_codes(codebooks), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long, measured_share double"), "codes")
    same = [F.col("label").isNull().alias("_none"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("_label")]
    whole = F.when(F.count("error") == F.count(F.lit(1)), F.try_sum("error"))
    sums = written(coded.select(*same, "error").groupBy("_none", "_label").agg(whole.alias("label_error")), "label_errors")
    coded = coded.select("*", *same)
    if sums.count() <= BROADCAST_LABELS:
        out = coded.join(F.broadcast(sums), ["_none", "_label"], "left")
    else:
        out = salted_lookup(coded, sums, ["_none", "_label"], F.col("code"), 8)
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"), "measured_share")
