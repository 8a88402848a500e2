"""What a session needs beyond its settings."""

from __future__ import annotations

import functools
import io
import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers, once for each application: they may not have it on their path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root, data = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = os.path.join(tempfile.mkdtemp(prefix="uttera-"), "uttera_package.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shipped(fn):
    """fn(spark, ...) with the package sent first."""

    @functools.wraps(fn)
    def run(spark, *args):
        ship(spark)
        return fn(spark, *args)

    return run


def small_batches(spark: SparkSession, rows: int = 1_000, megabytes: int = 4) -> None:
    """Let no more than `rows` rows, and about `megabytes`, go to a Python worker at a time: texts and signals can be long.

    The default of 10,000 rows holds several copies of tens of megabytes in each worker. Smaller settings stay.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", megabytes << 20)):
        now = spark.conf.get(key, None)
        if now is None or not now.isdigit() or int(now) <= 0 or int(now) > most:
            spark.conf.set(key, most)
