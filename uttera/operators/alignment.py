"""Word alignment of whole texts in linear memory.

The distances from all prefixes of one text to the whole of the other come from the bit-parallel recurrence (two integers hold the steps of
a column). Divide and conquer halves the hypothesis, takes such a column from the front and one from the back, cuts the reference where their
sum is least, and goes on with both parts; parts whose steps fit in TABLE bits keep them all and are traced back. So a text of n words costs at most
about twice the time of its distance, and memory in proportion to n.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pairs of words of a part that is traced back from its stored steps, two bits each.
TABLE = 16_000_000
MATCH, SUBSTITUTION, DELETION, INSERTION = "match", "substitution", "deletion", "insertion"


def _columns(ref: list, hyp: list) -> Iterator[tuple[int, int]]:
    """After each word of hyp: the prefixes of ref, as bits, that cost one more than the prefix before them, and those that cost one less. ref isn't empty."""
    n, at = len(ref), {}
    for i, w in enumerate(ref):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << n) - 1
    up, down = full, 0
    for w in hyp:
        same = at.get(w, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        right, left = down | (full & ~(diagonal | up)), up & diagonal
        right, left = (right << 1 | 1) & full, (left << 1) & full
        up, down = left | (full & ~(diagonal | right)), right & diagonal
        yield up, down


def column(ref: list, hyp: list) -> np.ndarray:
    """Distances of the prefixes of ref, the empty one first, to the whole of hyp."""
    n = len(ref)
    if not n or not hyp:
        return np.arange(n + 1) + len(hyp)
    for up, down in _columns(ref, hyp):
        pass
    bits = lambda x: np.unpackbits(np.frombuffer(x.to_bytes(-(-n // 8), "little"), np.uint8), bitorder="little")[:n].astype(np.int64)
    return np.concatenate([[len(hyp)], len(hyp) + np.cumsum(bits(up) - bits(down))])


def _traced(ref: list, hyp: list, i0: int, j0: int) -> list[tuple[int, int]]:
    """Matched and replaced pairs of positions of a part, from all its columns."""
    columns = list(_columns(ref, hyp))
    out, i, j = [], len(ref), len(hyp)
    while i and j:
        if columns[j - 1][0] >> (i - 1) & 1:  # the prefix without this word is nearer: it is deleted
            i -= 1
        elif j > 1 and columns[j - 2][1] >> (i - 1) & 1:  # it was nearer before this word came: it is inserted
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i0 + i, j0 + j))
    return out[::-1]


def aligned(ref: list, hyp: list) -> list[tuple[int, int]]:
    """Pairs of positions (reference, hypothesis) of an alignment with the fewest edits; words in no pair are deleted or inserted."""
    out: list[tuple[int, int]] = []
    parts = [(0, len(ref), 0, len(hyp))]
    while parts:  # from the front to the back
        a, b, c, d = parts.pop()
        while a < b and c < d and ref[a] == hyp[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        tail = 0
        while a < b - tail and c < d - tail and ref[b - 1 - tail] == hyp[d - 1 - tail]:
            tail += 1
        if tail:
            parts.append((b - tail, b, d - tail, d))  # matches at once
            b, d = b - tail, d - tail
        if a == b or c == d:
            continue
        if (b - a) * (d - c) <= TABLE or d - c == 1:
            out += _traced(ref[a:b], hyp[c:d], a, c)
            continue
        middle = (c + d) // 2
        cost = column(ref[a:b], hyp[c:middle]) + column(ref[a:b][::-1], hyp[middle:d][::-1])[::-1]
        cut = a + int(cost.argmin())
        parts += [(cut, b, middle, d), (a, cut, c, middle)]
    return out


def counts(ref: list, hyp: list, pairs: list[tuple[int, int]]) -> tuple[int, int, int, int]:
    """Matches, substitutions, deletions, insertions."""
    hits = sum(ref[i] == hyp[j] for i, j in pairs)
    return hits, len(pairs) - hits, len(ref) - len(pairs), len(hyp) - len(pairs)


def alignment_counts(ref: Column, hyp: Column) -> Column:
    """hits, substitutions, deletions, insertions of two arrays of words; null where one is null."""

    @F.pandas_udf("hits long, substitutions long, deletions long, insertions long")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, b in batches:
            rows = [(None,) * 4 if x is None or y is None else counts(x, y, aligned(x, y)) for x, y in ((_list(x), _list(y)) for x, y in zip(a, b, strict=True))]
            yield pd.DataFrame(rows, columns=["hits", "substitutions", "deletions", "insertions"], dtype="Int64")

    out = run(ref, hyp)
    return F.when(ref.isNotNull() & hyp.isNotNull(), out)


def _list(x) -> list | None:
    return None if x is None else list(x)


def edits(ref: list, hyp: list, matches: bool = True) -> Iterator[tuple]:
    """kind, position in ref, in hyp, word of ref, of hyp for each word of either, in order; matches may be left out."""
    i = j = 0
    for a, b in [*aligned(ref, hyp), (len(ref), len(hyp))]:
        for k in range(i, a):
            yield DELETION, k, None, ref[k], None
        for k in range(j, b):
            yield INSERTION, None, k, None, hyp[k]
        if a < len(ref) and (matches or ref[a] != hyp[b]):
            yield MATCH if ref[a] == hyp[b] else SUBSTITUTION, a, b, ref[a], hyp[b]
        i, j = a + 1, b + 1


#: Rows of edits in an Arrow batch.
ROWS = 50_000


def edit_rows(df: DataFrame, id_: str, ref: str, hyp: str, matches: bool = True) -> DataFrame:
    """A row for each word of either text: id, kind, ref_at, hyp_at (0-based), ref_word, hyp_word; nulls on the side that has none."""
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    names = ["kind", "ref_at", "hyp_at", "ref_word", "hyp_word"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = [], []
            flushed = lambda: pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of)), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]], [id_, *names])  # noqa: B023, E731
            for k, (r, h) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                for row in edits(r or [], h or [], matches):
                    rows.append(row)
                    of.append(k)
                    if len(rows) == ROWS:
                        yield flushed()
                        rows, of = [], []
            if rows:
                yield flushed()

    rows = df.select(F.col(id_), F.col(ref), F.col(hyp))
    return rows.mapInArrow(run, f"{id_} {dict(df.dtypes)[id_]}, kind string, ref_at int, hyp_at int, ref_word string, hyp_word string")


def confusions(edits: DataFrame) -> DataFrame:
    """How often each reference word became each other one: ref_word, hyp_word (null: deleted, inserted), n."""
    return edits.where(F.col("kind") != MATCH).groupBy("ref_word", "hyp_word").agg(F.count(F.lit(1)).alias("n"))
