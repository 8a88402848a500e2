"""Prediction sets: alignment, ensembles, metrics, leaderboards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ensemble(pred: DataFrame, weights: dict, id_: str, source: str, value: str, keep_partial: bool = False) -> DataFrame:
    """Weighted mean over the sources of each id: one shuffle of long rows in place of a chain of full joins.

    Without keep_partial ids must be in all sources. With it, weights are normalised over those present;
    a weight sum of 0 gives 0. Repeated (id, source) rows are averaged first.
    """
    total = sum(weights.values())
    table = F.create_map(*[F.lit(x) for k, w in weights.items() for x in (k, w / total)])
    rows = pred.where(F.col(value).isNotNull()).groupBy(id_, source).agg(F.avg(value).alias("_v"))
    rows = rows.withColumn("_w", F.try_element_at(table, F.col(source))).where("_w is not null")
    out = rows.groupBy(id_).agg(F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_t"), F.count("*").alias("n_sources"))
    if not keep_partial:
        out = out.where(F.col("n_sources") == len(weights))
    return out.select(id_, "n_sources", F.when(F.col("_t") == 0, 0.0).otherwise(F.col("_s") / F.col("_t")).alias("hyp"))


def regression(ref: Column, hyp: Column) -> dict[str, Column]:
    err = hyp - ref
    return {
        "n": F.count(err),
        "mae": F.round(F.avg(F.abs(err)), 6),
        "mse": F.round(F.avg(err * err), 6),
        "rmse": F.round(F.sqrt(F.avg(err * err)), 6),
        "bias": F.round(F.avg(err), 6),
    }


def metrics(df: DataFrame, by: list[str], ref: str = "ref", hyp: str = "hyp") -> DataFrame:
    aggs = [c.alias(k) for k, c in regression(F.col(ref), F.col(hyp)).items()]
    return df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)


def leaderboard(runs: DataFrame, metric: str, tie: str, top: int | None = None) -> DataFrame:
    """runs with rank, best first. Runs are a small table, one row for each model."""
    out = runs.withColumn("rank", F.row_number().over(Window.orderBy(metric, tie)))
    return out.where(F.col("rank") <= top) if top else out


def confusion(df: DataFrame, ref: str, hyp: str) -> DataFrame:
    """ref, hyp, n for all pairs of labels, zero where a pair doesn't occur."""
    counts = df.groupBy(F.col(ref).alias("ref"), F.col(hyp).alias("hyp")).agg(F.count("*").alias("n"))
    labels = df.select(F.explode(F.array(ref, hyp)).alias("l")).distinct()
    grid = labels.select(F.col("l").alias("ref")).crossJoin(labels.select(F.col("l").alias("hyp")))  # classes squared
    return grid.join(counts, ["ref", "hyp"], "left").select("ref", "hyp", F.coalesce("n", F.lit(0)).alias("n"))


def classification_report(matrix: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support of each class, then macro and weighted averages; 0 for 0 / 0. From confusion()."""
    hit = F.sum(F.when(F.col("ref") == F.col("l"), F.when(F.col("hyp") == F.col("l"), F.col("n")).otherwise(0)).otherwise(0))
    rows = matrix.withColumn("l", F.explode(F.array_distinct(F.array("ref", "hyp"))))
    sums = rows.groupBy("l").agg(hit.alias("tp"), F.sum(F.when(F.col("hyp") == F.col("l"), F.col("n")).otherwise(0)).alias("ph"), F.sum(F.when(F.col("ref") == F.col("l"), F.col("n")).otherwise(0)).alias("support"))
    safe = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    per = sums.select(F.col("l").cast("string").alias("label"), safe(F.col("tp"), F.col("ph")).alias("precision"), safe(F.col("tp"), F.col("support")).alias("recall"), "support")
    per = per.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    keys = ("precision", "recall", "f1")
    macro = per.agg(F.lit("macro avg").alias("label"), *[F.avg(k).alias(k) for k in keys], F.sum("support").alias("support"))
    weighted = per.agg(F.lit("weighted avg").alias("label"), *[(F.sum(F.col(k) * F.col("support")) / F.sum("support")).alias(k) for k in keys], F.sum("support").alias("support"))
    out = per.unionByName(macro).unionByName(weighted)
    return out.select("label", *[F.round(k, 6).alias(k) for k in keys], "support")


def early_stop(trace: DataFrame, by: list[str], step: str, loss: str, gain: float, patience: int) -> DataFrame:
    """Best loss, its step and the step of the stop of each trace, as a loop over its steps would find them.

    The best moves only when the loss falls by more than `gain`. A trace is the history of one training run.
    """
    seq = F.array_sort(F.collect_list(F.struct(F.col(step).cast("long").alias("step"), F.col(loss).cast("double").alias("loss"))))
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(-1).cast("long").alias("best_step"), F.lit(0).alias("bad"), F.lit(None).cast("long").alias("stop"))

    def fold(s: Column, x: Column) -> Column:
        better = x["loss"] < s["best"] - gain
        bad = F.when(better, 0).otherwise(s["bad"] + 1)
        moved = F.struct(
            F.when(better, x["loss"]).otherwise(s["best"]).alias("best"),
            F.when(better, x["step"]).otherwise(s["best_step"]).alias("best_step"),
            bad.alias("bad"),
            F.when(bad >= patience, x["step"]).alias("stop"),
        )
        return F.when(s["stop"].isNotNull(), s).otherwise(moved)

    g = trace.groupBy(*by) if by else trace.groupBy()
    out = g.agg(seq.alias("seq")).withColumn("s", F.aggregate("seq", start, fold))
    return out.select(*by, F.col("s.best").alias("best"), F.col("s.best_step").alias("best_step"), F.col("s.stop").alias("stop_step"))


def aligned(a: DataFrame, b: DataFrame, key: str, label: str, vec: str, tol: float = 1e-6) -> DataFrame:
    """Inner join of two encoders' vectors; raises when read if ids are missing or repeated on a side or labels differ."""
    x = a.select(key, F.col(label).alias("y1"), F.col(vec).alias("v1"))
    y = b.select(F.col(key), F.col(label).alias("y2"), F.col(vec).alias("v2"))
    both = x.join(y, key, "full")
    same = F.abs(F.col("y1") - F.col("y2")) <= tol
    ok = F.assert_true(F.coalesce(same, F.lit(False)), F.concat(F.lit("missing id or other label: "), F.col(key).cast("string")))
    return both.withColumn("_ok", ok).where("_ok is null").drop("_ok")


def histogram(df: DataFrame, value: str, low: float, width: float, bins: int) -> DataFrame:
    """bin_start and n of left-closed bins, zero where empty; values outside are left out."""
    at = F.floor((F.col(value) - low) / width).cast("int")
    counts = df.where((F.col(value) >= low) & (F.col(value) < low + width * bins)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    spine = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(counts), "bin", "left").select((F.lit(low) + F.col("bin") * width).alias("bin_start"), F.coalesce("n", F.lit(0)).alias("n"))


def quantile_bins(df: DataFrame, value: str, q: int) -> DataFrame:
    """df's known values with bin: right-closed, the lowest included; equal edges fall together."""
    edges = df.agg(F.array_distinct(F.percentile(value, F.array(*[F.lit(i / q) for i in range(q + 1)]))).alias("_e"))
    rows = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(edges))  # one row
    return rows.withColumn("bin", F.greatest(F.lit(0), F.size(F.filter("_e", lambda e: e < F.col(value))) - 1)).drop("_e")


def fold_statistics(df: DataFrame, fold: str, value: str, folds: int) -> DataFrame:
    """fold, n, mean, std of the value over the rows outside each fold (std of the population; under 1e-6 it is 1): what its held-out rows are scaled by.

    One aggregation: a fold's statistics are the sums of all less its own, around a centre that keeps them exact.
    """
    centre = df.agg(F.avg(value).alias("c")).first()["c"] or 0.0
    d = F.col(value) - F.lit(float(centre))
    own = df.where(F.col(value).isNotNull()).groupBy(F.col(fold).alias("fold")).agg(F.count(value).alias("n"), F.sum(d).alias("s"), F.sum(d * d).alias("q"))
    spine = df.sparkSession.range(folds).select(F.col("id").alias("fold"))
    total = own.agg(F.sum("n").alias("tn"), F.sum("s").alias("ts"), F.sum("q").alias("tq"))  # one row
    rows = spine.join(F.broadcast(own), "fold", "left").crossJoin(F.broadcast(total))  # a row a fold
    rest = rows.select("fold", *[(F.col(f"t{k}") - F.coalesce(k, F.lit(0))).alias(k) for k in ("n", "s", "q")])
    mean = F.try_divide("s", "n")
    std = F.sqrt(F.greatest(F.lit(0.0), F.try_divide("q", "n") - mean * mean))
    return rest.select("fold", "n", (mean + float(centre)).alias("mean"), F.when(std < 1e-6, 1.0).otherwise(std).alias("std"))
