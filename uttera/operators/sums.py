"""Sums of dense arrays over all rows: each task adds up its own, Spark adds those of the tasks, the driver gets one array."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Numbers in a row of the shuffle.
WIDTH = 32


def matrix(column: pa.Array) -> np.ndarray:
    """A column of arrays of equal length as a matrix of doubles."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False)


def task_sum(rows: DataFrame, task: Callable[[Iterator[pa.RecordBatch]], np.ndarray | None], size: int) -> np.ndarray:
    """Sum over all tasks of task(batches), an array of `size` doubles: a task sends size / WIDTH rows, the driver gets `size` numbers."""
    chunks = max(1, -(-size // WIDTH))
    names = [f"c{i}" for i in range(WIDTH)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = task(b for b in batches if b.num_rows)
        if total is not None:
            grid = np.zeros((chunks, WIDTH))
            grid.ravel()[:size] = total
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(chunks, dtype=np.int32)), *[pa.array(c) for c in grid.T.copy()]], ["chunk", *names])

    sums = rows.mapInArrow(run, ", ".join(["chunk int", *[f"{n} double" for n in names]])).groupBy("chunk").agg(*[F.sum(n).alias(n) for n in names])
    out = np.zeros((chunks, WIDTH))
    for r in sums.collect():
        out[r[0]] = r[1:]
    return out.ravel()[:size]


def dense_sum(rows: DataFrame, part: Callable[[pa.RecordBatch], np.ndarray], size: int) -> np.ndarray:
    """Sum over all batches of part(batch), an array of `size` doubles."""

    def task(batches: Iterator[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            own = part(batch)
            total = own if total is None else total + own
        return total

    return task_sum(rows, task, size)
