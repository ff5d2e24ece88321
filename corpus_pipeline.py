"""Corpus preparation in five stages; each is written as Parquet and reread as the next one's documents.

Every stage works on all rows that its predecessor kept, whatever their text; null and empty
texts and null ids pass through the operators as their docstrings say. All stages but the last
return the columns of their input; the last adds ``ids``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from brindle.llm import decontaminate, near_dedup, pieces, quality, secrets
from brindle.llm.tables import Scratch


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays (five-word shingles, similarity 0.8)."""
    return near_dedup.keep_one(docs)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    return decontaminate.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are replaced in the texts; every document stays."""
    return secrets.redact(docs, secrets.train(secrets.labelled_findings(spark)))


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts are encoded with merge-dropout; they decode to themselves."""
    return pieces.encode(docs)


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("secrets", secrets_stage),
    ("pieces", pieces_stage),
]

# SQL can't express the classifier, the forest or the encoding; tests compare the near-duplicate, decontamination and
# pieces stages with brute force, the classifier with held-out labels, and the scan with planted keys.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.write(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
