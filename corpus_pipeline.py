"""The corpus pipeline: quality rules, near copies, benchmark passages, secrets, and the mix.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` applies them to the table
``documents`` one after another, each on what its predecessor kept, written as Parquet and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillrow.llm import decontamination, mixing, near_copies, quality, secrets
from quillrow.llm.workspace import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; every row has its own verdict."""
    return quality.without_rejected(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: SimHash and minimum hashes, similarity 0.8 or more of five-word shingles."""
    return near_copies.one_of_each(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of ``benchmark``."""
    return decontamination.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with every secret masked."""
    return secrets.redact(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix's manifest: what it takes of each document, and when."""
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("source_mix", source_mix),
]

#: The second stage compares fingerprints and shingle sets, which SQL can't express at these sizes.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
