"""Ranks, samples and splits by a hash of the id: the same rows whatever the partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def order_key(id_: Column, seed: int = 42) -> Column:
    return F.md5(F.concat(id_.cast("string"), F.lit(f"|{seed}")))


def hash_rank(df: DataFrame, id_: str, by: list[str] | None = None, seed: int = 42, name: str = "rank") -> DataFrame:
    """df with the 0-based rank of each row by order_key, in each group of `by` or over all rows.

    No task sorts all rows: ranks are taken inside the 256 first bytes of the key and shifted by the
    counts of the bytes before, a table of 256 rows a group.
    """
    by = by or []
    rows = df.withColumn("_key", order_key(F.col(id_), seed)).withColumn("_byte", F.substring("_key", 1, 2))
    counts = rows.groupBy(*by, "_byte").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_byte").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*by, "_byte").orderBy("_key", id_))
    rows = rows.withColumn("_in", inside)
    on = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_byte")]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    joined = rows.alias("a").join(starts.alias("b"), cond)
    return joined.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col("_start") + F.col("_in") - 1).alias(name))


def sample_per_group(df: DataFrame, group: str, id_: str, n: int, seed: int = 42) -> DataFrame:
    """At most n rows of each group, without replacement; none for n = 0.

    row_number() <= n is cut down before the shuffle too, so a hot group costs n rows a task.
    """
    if n == 0:
        return df.limit(0)
    w = Window.partitionBy(group).orderBy("_key", id_)
    rows = df.withColumn("_key", order_key(F.col(id_), seed)).withColumn("_rn", F.row_number().over(w))
    return rows.where(F.col("_rn") <= n).drop("_key", "_rn")


def kfold(df: DataFrame, id_: str, k: int, strata: list[str] | None = None, seed: int = 42) -> DataFrame:
    """df with a column fold: sizes differ by one at most, in each stratum if there are any."""
    return hash_rank(df, id_, strata, seed, "_r").withColumn("fold", F.pmod("_r", F.lit(k))).drop("_r")


def holdout(df: DataFrame, id_: str, strata: list[str], share: float = 0.8, seed: int = 42) -> DataFrame:
    """df with a column split: the first ceil(share * n) rows of each stratum train, the rest dev."""
    sizes = df.groupBy(*strata).agg(F.count("*").alias("_n"))
    ranked = hash_rank(df, id_, strata, seed, "_r").alias("a")
    cond = None
    for c in strata:
        x = F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        cond = x if cond is None else cond & x
    rows = ranked.join(sizes.alias("b"), cond)
    train = F.col("_r") < F.ceil(F.lit(share) * F.col("_n"))
    return rows.select(*[F.col(f"a.`{c}`") for c in df.columns], F.when(train, "train").otherwise("dev").alias("split"))


def disjoint_split(df: DataFrame, speaker: str, sixteenths: int = 4, seed: int = 42) -> DataFrame:
    """df with a column split by a hash of the speaker, so that no speaker is on both sides."""
    digit = F.substring(order_key(F.col(speaker), seed), 1, 1)
    return df.withColumn("split", F.when(digit < F.lit("0123456789abcdef"[sixteenths]), "dev").otherwise("train"))


def dense_index(df: DataFrame, key: str, name: str = "idx") -> DataFrame:
    """Distinct keys with their 0-based place in string order. For dimension tables: distinct keys are sorted together."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return keys.withColumn(name, F.row_number().over(Window.orderBy(F.col(key).cast("string"))) - 1)


def places(df: DataFrame, by: str, out: str = "place", pieces: int = 256) -> DataFrame:
    """df with the place of each row in the order of `by` (numbers, no two equal), from 1. Rows are sorted in pieces between quantiles, never in one task."""
    cuts = df.agg(F.percentile_approx(by, F.array(*[F.lit(i / pieces) for i in range(1, pieces)]), 100_000).alias("c")).first()["c"]
    cuts = F.array(*[F.lit(c) for c in dict.fromkeys(cuts or [0])])
    rows = df.withColumn("_piece", F.size(F.filter(cuts, lambda c: c < F.col(by))))
    sizes = rows.groupBy("_piece").count().collect()  # a row a piece
    before, starts = 0, {}
    for r in sorted(sizes, key=lambda r: r["_piece"]):
        starts[r["_piece"]], before = before, before + r["count"]
    start = F.create_map(*[F.lit(x) for kv in (starts or {0: 0}).items() for x in kv])
    within = F.row_number().over(Window.partitionBy("_piece").orderBy(by))
    return rows.withColumn(out, (within + F.try_element_at(start, F.col("_piece"))).cast("long")).drop("_piece")
