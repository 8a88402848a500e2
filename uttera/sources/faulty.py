"""Parquet files from a source that fails at times: batches with bounded retries, then file by file, with a status row for each file and resume.

Every batch that can be read is written to the target at once, under a name that follows from its files, so a repeated or interrupted run
replaces its own rows and never adds them twice. What failed for good is named with its reason in the status table.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATUS = "url string, status string, attempts int, rows long, reason string, run long"
READ, RETRIED, GIVEN_UP = "read", "retried", "given up"
#: What the message of an error that stays says: fixed values of Spark's and its Parquet reader's.
MISSING = ("PATH_NOT_FOUND", "FileNotFound", "does not exist", "FILE_NOT_EXIST", "No such file")
BROKEN = ("is not a Parquet file", "CANNOT_READ_FILE_FOOTER", "FAILED_READ_FILE", "Snappy", "CORRUPT", "corrupt", "UNABLE_TO_INFER_SCHEMA", "ParquetDecodingException", "MALFORMED")


@dataclass(frozen=True)
class Policy:
    """How often a kind of failure is tried and how long the wait before the k-th further try is, in seconds."""

    transient: int = 7
    broken: int = 2
    missing: int = 1

    def tries(self, kind: str) -> int:
        return {"missing": self.missing, "broken": self.broken}.get(kind, self.transient)

    def wait(self, kind: str, k: int) -> float:
        return 10.0 if kind == "broken" else min(300.0, 15.0 * 2**k)


def kind_of(error: Exception) -> str:
    """missing, broken or transient, by an error's message and those of its causes."""
    text = f"{error.getCondition() if isinstance(error, PySparkException) else ''} {error}"
    return "missing" if any(m in text for m in MISSING) else "broken" if any(m in text for m in BROKEN) else "transient"


def _reason(error: Exception) -> str:
    return next((line.strip() for line in str(error).splitlines() if line.strip()), type(error).__name__)[:300]


def _statuses(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(STATUS).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], STATUS)


def status(spark: SparkSession, path: str) -> DataFrame:
    """The last status of each file."""
    w = Window.partitionBy("url").orderBy(F.desc("run"))
    return _statuses(spark, path).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def read_all(
    spark: SparkSession, urls: list[str], target: str, status_path: str, read: Callable[[SparkSession, list[str]], DataFrame] | None = None,
    batch: int = 20, policy: Policy = Policy(), sleep: Callable[[float], None] = time.sleep, again: bool = False,
) -> DataFrame:
    """Rows of all files that could be read, from `target`; status(status_path) says what became of each file.

    Files that an earlier run has read are skipped; those that it gave up are skipped unless `again`. read makes the rows of a list of files:
    by default all columns, without regard to corrupt ones being left out, so that a broken file is noticed.
    """
    read = read or (lambda s, some: s.read.option("ignoreCorruptFiles", False).option("ignoreMissingFiles", False).parquet(*some))
    earlier = {r["url"]: r["status"] for r in status(spark, status_path).select("url", "status").collect()}  # a row a file
    run = (_statuses(spark, status_path).agg(F.max("run")).first()[0] or 0) + 1
    todo = [u for u in dict.fromkeys(urls) if u not in earlier or (again and earlier[u] == GIVEN_UP)]
    chunks = [todo[i : i + batch] for i in range(0, len(todo), batch)]
    while chunks:
        some = chunks.pop(0)
        name = hashlib.sha256("\n".join(some).encode()).hexdigest()[:16]
        attempts, error = 0, None
        while True:
            attempts += 1
            try:
                rows = read(spark, some).withColumn("source_url", F.input_file_name())
                rows.write.mode("overwrite").parquet(f"{target}/batch={name}")
                error = None
                break
            except Exception as e:  # whatever a source throws is judged by its kind
                error, kind = e, kind_of(e)
                if attempts >= policy.tries(kind):
                    break
                sleep(policy.wait(kind, attempts - 1))
        if error is not None and len(some) > 1:  # one of them: each alone
            chunks = [[u] for u in some] + chunks
            continue
        if error is None:
            counts = {r[0]: r[1] for r in spark.read.parquet(f"{target}/batch={name}").groupBy("source_url").count().collect()}
            found = [(u, READ if attempts == 1 else RETRIED, attempts, _rows_of(u, counts, some), None, run) for u in some]
        else:
            found = [(some[0], GIVEN_UP, attempts, 0, _reason(error), run)]
        spark.createDataFrame(found, STATUS).coalesce(1).write.mode("append").parquet(status_path)
    try:
        return spark.read.parquet(target)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], "source_url string, batch string")


def _rows_of(url: str, counts: dict[str, int], some: list[str]) -> int:
    """Rows whose file is the url or lies in it; all rows of a batch of one."""
    if len(some) == 1:
        return sum(counts.values())
    tail = url.split("://")[-1].rstrip("/").lstrip("/")
    return sum(n for f, n in counts.items() if (at := f.split("://")[-1].lstrip("/").removeprefix("/")) == tail or at.startswith(f"{tail}/") or at.endswith(f"/{tail}") or f"/{tail}/" in at)
