"""Documents to training sequences: quality rules, near copies, benchmark passages, secrets, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.llm import decontam, jaccard_join, packing, quality, secrets
from postsift.session import write_stage

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the policy go."""
    return quality.keep_passing(docs)


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays."""
    return jaccard_join.keep_one(docs, jaccard_join.near_copies(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover a benchmark item go."""
    return decontam.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are struck out; every document stays."""
    rows = secrets.redacted(docs)
    return rows.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per training sequence, with its token ids."""
    return packing.pack(docs, TOKENIZER)


STAGES = [("quality_rules", quality_stage), ("near_copies", near_copy_stage), ("decontamination", decontamination_stage),
          ("secrets", secret_stage), ("packing", packing_stage)]

#: Packing needs a tokenizer, which SQL has not; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read back as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs, _ = write_stage(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return docs
