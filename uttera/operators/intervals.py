"""Interval join: the word that holds the midpoint of a phone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def midpoint_join(inner: DataFrame, outer: DataFrame, key: str, width: float = 10.0) -> DataFrame:
    """Rows of inner (key, start, end, label) with the outer interval that holds their midpoint.

    Intervals are cut by buckets of `width`: outer rows go to each bucket they touch, inner rows to that of
    their midpoint, so the join is by key and bucket and no group of a key is compared with all of another.
    A row of inner that equals an outer one in span and label is left out.
    """
    a = inner.withColumn("mid", (F.col("start") + F.col("end")) / 2).withColumn("_b", F.floor(F.col("mid") / width))
    b = outer.select(key, F.col("start").alias("w_start"), F.col("end").alias("w_end"), F.col("label").alias("w_label"))
    b = b.withColumn("_b", F.explode(F.sequence(F.floor(F.col("w_start") / width), F.floor(F.col("w_end") / width))))
    hit = a.join(b, [key, "_b"]).where("w_start <= mid and mid < w_end")
    return hit.where("not (start = w_start and end = w_end and label = w_label)").drop("_b")
