"""Event-time windows over the events stream; an extension beyond batch evaluation."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Number and mean of values by window and type; rows later than `late` are dropped by the watermark."""
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    g = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return g.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean_s")).select(F.col("window.start").alias("start"), "event_type", "n", "mean_s")


def latency_stream(spark: SparkSession, path: str) -> DataFrame:
    """The windows of a folder or file of Parquet rows, read as a stream until all is consumed."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema)
    if spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(spark._jvm.org.apache.hadoop.fs.Path(path)).isDirectory():
        stream = source.parquet(path)
    else:
        stream = source.option("pathGlobFilter", name).parquet(folder)
    out = "w" + uuid.uuid4().hex
    q = windowed(stream).writeStream.outputMode("complete").format("memory").queryName(out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(out)
