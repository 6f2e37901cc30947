"""Clean a corpus in stages, each a DataFrame job written as Parquet and read again by the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ravelin.llm import stages

STAGES = [
    ("quality_classifier", stages.keep_quality),
    ("near_duplicates", stages.drop_near_duplicates),
    ("substring_dedup", stages.strip_repeated_passages),
    ("secret_scans", stages.mask_secrets),
    ("best_fit_packing", stages.pack_bins),
]

ORACLE_SQL = None  # SQL cannot express the fitted classifier and the packing; a test has a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stages.written(stage(spark, docs, sf_dir), name)
    return docs
