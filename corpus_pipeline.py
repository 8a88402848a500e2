"""The corpus pipeline: rules, classifier, near duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read back
as the next stage's docs. All but the last return the columns of documents. Each sends the package to the executors first, so that it can
be called alone where they don't have it.

Defined cases, stage by stage: a null, blank or short text fails the base rules and goes in the first. Without labels the
two quality stages reject by the base rules alone. Rows that repeat id and text are copies, one stays; rows without an id stay
in the third stage. A null text stays null where personal data is masked. Each row that is left gets one slot. Columns
beyond those of documents pass through all stages but the last; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from uttera.llm import ngram_join, packing, pii, quality_classifier, quality_rules, token_counts
from uttera.llm.common import free_name, table, written
from uttera.llm.queries import gpt_pattern, tokenizer_path
from uttera.session import shipped


@shipped
def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the decision list keeps. The list is learned from the labelled rows of the documents table."""
    learned = quality_rules.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = free_name(docs, "quality_rules")
    return quality_rules.apply(docs, learned).where(F.col(name)["kept"]).drop(name)


@shipped
def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the site-aware classifier keeps."""
    model = quality_classifier.fit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    name = free_name(docs, "quality")
    return quality_classifier.classify(docs, model, F.col("source"), F.col("lang")).where(F.col(name)["kept"]).drop(name)


@shipped
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return ngram_join.deduplicated(docs)


@shipped
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked; n_chars follows the new text."""
    out = pii.masked(docs)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.char_length("text").cast("long"))) if "n_chars" in docs.columns else out


@shipped
def packing_plan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bucket, batch and slot of each document."""
    docs = docs.select("doc_id", "text")
    return packing.packing_plan(docs, token_counts.tokens_column(docs, tokenizer_path("byte_bpe_50k.json"), gpt_pattern()))


STAGES = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("ngram_jaccard_join", near_duplicates),
    ("pii", personal_data),
    ("packing", packing_plan),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents table on."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


#: The learned stages can't be said in SQL; tests hold each stage against brute force.
ORACLE_SQL = None
