"""Corpus pipeline: rules, near duplicates, secrets, mixing, encoding; each stage is a written table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from priorlake.llm import stages
from priorlake.llm.shared import stored

STAGES = [
    ("quality_rules", stages.quality_stage),
    ("ngram_jaccard", stages.near_duplicate_stage),
    ("secret_scan", stages.secret_stage),
    ("mixing", stages.mixing_stage),
    ("byte_bpe", stages.encoding_stage),
]
# Trained trees, decoded layers and byte-pair merges are not SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
