"""Corpus pipeline: language, near duplicates, secrets, mixture, packing; every stage reads what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from florapark.llm import langid, mixing, neardup, packing, secrets
from florapark.llm._store import pin

STAGES = [
    ("language_id", langid.stage),
    ("near_duplicates", neardup.stage),
    ("secret_scan", secrets.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

# the language model, the classifier of the mixture and the tokenizer have no SQL form
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, step in STAGES[:-1]:
        docs = pin(step(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
