"""The corpus pipeline: language ID, near duplicates, benchmark decontamination, secrets, packing.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame; run() writes
each as Parquet in the shared folder and rereads it. All but the last return the columns of documents. Rows that repeat
are judged alike, an empty table passes every stage, and columns beyond those of documents are carried along. A session
in which a stage runs keeps the smaller Arrow batches of common.bound_batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmeter.llm import decontaminate, jaccard_join, language, packing, secrets
from glyphmeter.llm.common import bound_batches, stored, table
from glyphmeter.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go, as do those without a letter and without text."""
    bound_batches(spark)
    return language.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays; empty texts are no duplicates."""
    bound_batches(spark)
    return jaccard_join.keep_one_of_each(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go; null and empty texts contain none."""
    bound_batches(spark)
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark", "item_id", "text"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced within their texts; n_chars follows where there is a text. Every row stays."""
    bound_batches(spark)
    clean = secrets.redact_documents(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("bigint"), F.col("n_chars"))) if "n_chars" in docs.columns else clean


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All pieces of all documents, packed into sequences; a null text is the end id alone."""
    bound_batches(spark)
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Compression, tokenising and packing have no SQL; the stages are tested against plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
