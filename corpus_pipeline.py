"""The training-data pipeline over ``documents``: each stage's rows are written and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codexlake.llm import stages

STAGES = [
    ("quality", stages.quality),
    ("near_dedup", stages.near_dedup),
    ("suffix_dedup", stages.suffix),
    ("mixing", stages.mixing),
    ("packing", stages.packing),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run(STAGES, spark, sf_dir)
