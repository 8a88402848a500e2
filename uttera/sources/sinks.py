"""Sinks: submissions, predictions, result tables, feature caches, JSON metrics, WAV files."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def submission(dev: DataFrame, evl: DataFrame, order: str = "fileid") -> DataFrame:
    """fileId and Age with one decimal, dev rows before evl rows, either in the order of the column `order`: the place of each result where there is one."""
    part = lambda df, o: df.select(F.lit(o).alias("_o"), F.col(order).alias("_place"), F.col("fileid").cast("string").alias("fileId"), one_decimal(F.col("hyp")).alias("Age"))
    return part(dev, 0).unionByName(part(evl, 1)).orderBy("_o", "_place").select("fileId", "Age")


def one_decimal(c: Column) -> Column:
    """As Python's '%.1f': the binary value itself is rounded, so 0.15, a little less than that, gives 0.1. JVM formats round its decimal string."""
    @F.pandas_udf("string")
    def formatted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda v: None if v is None else f"{v:.1f}").astype(object)

    return F.when(c.isNull(), None).when(F.isnan(c.cast("double")), "nan").otherwise(formatted(c.cast("double")))


def write_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header; for result tables, which are small."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, nullValue="")


def append_results(df: DataFrame, path: str) -> None:
    """Rows added to a result table; a failed cell keeps its status and a null metric."""
    df.write.mode("append").parquet(path)


def cache_features(df: DataFrame, path: str) -> None:
    """Features by transform and partition; what is there already stays, pair by pair, and the others are added."""
    key = ["transform_id", "partition"]
    try:
        there = df.sparkSession.read.parquet(path).select(*[F.col(k).cast("string").alias(f"_{k}") for k in key]).distinct()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    else:
        df = df.join(there, [F.col(k).cast("string").eqNullSafe(F.col(f"_{k}")) for k in key], "left_anti")
    df.write.mode("append").partitionBy(*key).parquet(path)


def predictions_table(df: DataFrame, path: str, run: str) -> None:
    """A run's predictions (fileid, hyp and, where known, ref); a repeated run replaces its own rows only."""
    rows = df.select("fileid", "hyp", *[c for c in ("ref",) if c in df.columns])
    rows.write.mode("overwrite").parquet(f"{path}/run={run}")


def save_model(model, path: str) -> None:
    """A fitted pyspark.ml model; readers.load_model() gives it back."""
    model.write().overwrite().save(path)


def metrics_json(df: DataFrame) -> DataFrame:
    """One JSON text a row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def weights_wide(df: DataFrame, key: list[str], name: str, value: str, names: list[int]) -> DataFrame:
    """A column w_L<layer> for each layer."""
    out = df.groupBy(*key).pivot(name, names).agg(F.first(value))
    for n in names:
        out = out.withColumnRenamed(str(n), f"w_L{n}")
    return out


def wav_bytes(samples: list[float], rate: int = 16_000) -> bytes:
    """PCM16 mono WAV."""
    import numpy as np

    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(1)
        f.setsampwidth(2)
        f.setframerate(rate)
        f.writeframes((np.clip(np.asarray(samples, float), -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def wav_column(df: DataFrame, samples: str, rate: int = 16_000) -> DataFrame:
    """df with a column wav that holds the file's bytes."""
    @F.pandas_udf("binary")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b.map(lambda x: None if x is None else wav_bytes(x, rate))

    return df.withColumn("wav", encode(samples))
