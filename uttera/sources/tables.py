"""Tables and the views over them that stand in for speech data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows from events; age_raw is '?' where the age is unknown."""
    e = table(spark, sf_dir, "events")
    age = (20 + (F.col("user_id") * 7 + F.col("event_id") % 9) % 70).cast("string")
    return e.select(
        F.col("event_id").alias("fileid"),
        F.col("user_id").alias("speaker_id"),
        F.when(F.col("user_id") % 2 == 0, "F").otherwise("M").alias("gender"),
        F.when(F.col("event_id") % 50 == 0, "?").otherwise(age).alias("age_raw"),
        (2 + F.col("event_id") % 31).alias("duration"),
    ).withColumn("age", F.expr("try_cast(age_raw AS double)"))


UTT_SQL = """utt AS (
  SELECT event_id AS fileid, user_id AS speaker_id, CASE WHEN user_id % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
    CASE WHEN event_id % 50 = 0 THEN '?' ELSE CAST(20 + (user_id * 7 + event_id % 9) % 70 AS VARCHAR) END AS age_raw,
    2 + event_id % 31 AS duration FROM events
), man AS (SELECT *, try_cast(age_raw AS DOUBLE) AS age FROM utt)"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three deterministic models over embeddings, long form: model, vec_id, ref, hyp. Model 3 misses every tenth id."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("long").alias("label"))
    models = F.explode(F.array(*[F.struct(F.lit(k).alias("model"), F.lit(m).cast("long").alias("m")) for k, m in enumerate((3, 5, 7), 1)]))
    rows = e.select("vec_id", "label", models.alias("x")).where("not (x.model = 3 and vec_id % 10 = 0)")
    return rows.select(
        F.col("x.model").alias("model"),
        "vec_id",
        (20 + 7 * F.col("label")).cast("double").alias("ref"),
        (20 + 7 * F.col("label") + F.pmod(F.col("vec_id") * F.col("x.m"), F.lit(11)) - 5).cast("double").alias("hyp"),
    )


PRED_SQL = """pred AS (
  SELECT m.model, vec_id, CAST(20 + 7 * label AS DOUBLE) AS ref,
    CAST(20 + 7 * label + (vec_id * m.m) % 11 - 5 AS DOUBLE) AS hyp
  FROM embeddings CROSS JOIN (VALUES (1, 3), (2, 5), (3, 7)) AS m(model, m)
  WHERE NOT (m.model = 3 AND vec_id % 10 = 0)
)"""


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each embedding as a sequence of 64 one-dimensional frames: fileid, x array<double>."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("fileid"), F.col("embedding").cast("array<double>").alias("x"), F.col("label").cast("long").alias("label"))


FRAMES_SQL = "fr AS (SELECT vec_id AS fileid, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x, CAST(label AS BIGINT) AS label FROM embeddings)"


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user turn with the assistant turn right after it: conv_id, turn, question, answer."""
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = c.withColumn("next_role", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w))
    rows = rows.where("role = 'user' and next_role = 'assistant'")
    return rows.select("conv_id", "turn", F.col("text").alias("question"), "answer")


TURNS_SQL = """nxt AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS answer
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)
), turns AS (SELECT conv_id, turn, text AS question, answer FROM nxt WHERE role = 'user' AND next_role = 'assistant')"""


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference and hypothesis from whole documents: each 5th word dropped and each 7th replaced."""
    d = table(spark, sf_dir, "documents")
    words = F.filter(F.split("text", "\\s+"), lambda w: w != "")
    rows = d.select("doc_id", "lang", words.alias("w"))
    kept = F.filter(F.transform("w", lambda w, i: F.when((i + 1) % 5 == 0, None).when((i + 1) % 7 == 0, "eight").otherwise(w)), lambda w: w.isNotNull())
    return rows.select("doc_id", "lang", F.array_join("w", " ").alias("ref"), F.array_join(kept, " ").alias("hyp"))


def spread(df: DataFrame, *by: str) -> DataFrame:
    """df dealt to at least four tasks a core, evenly or by the columns `by`: for work on texts that costs far more than moving them, whatever lay in one file or row group."""
    return df.repartition(max(4 * df.sparkSession.sparkContext.defaultParallelism, df.rdd.getNumPartitions()), *by)
