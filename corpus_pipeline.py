"""The training-corpus pipeline: five stages over documents, each one operator of quirelight.llm.

Every stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and is written as
Parquet and read again before the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm import decontamination, minhash_dedup, quality_rules, secret_scan, source_mixing
from quirelight.llm.common import Scratch, shared_folder, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.filter_documents(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays, the one with the smallest doc_id."""
    return minhash_dedup.filter_documents(docs).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontamination.filter_documents(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; n_chars, where it is a column, follows the text."""
    out = docs.withColumn("text", secret_scan.redacted_column("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """How often the mixture uses each document."""
    return source_mixing.mix_sources(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scans", redact_secrets),
    ("source_mixing", mix),
]

#: Near-duplicate classes and compressed sizes can't be expressed in SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with each result written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            Scratch(spark).remove(before)  # nothing reads it any more
        docs, before = spark.read.parquet(path), path
    return docs
