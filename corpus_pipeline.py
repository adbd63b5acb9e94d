"""The corpus pipeline: toxicity, language, near duplicates, source mix, packing.

Each stage works on all rows that its predecessor kept. The first four return the columns of
``documents``; the last returns a row per piece of every document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from retentio.llm import stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", stages.drop_toxic),
    ("language", stages.drop_unknown_language),
    ("near_duplicates", stages.keep_one_of_each),
    ("mix", stages.mix_sources),
    ("pack", stages.pack),
]

# Stages that learn, search neighbours or pack are not expressible in SQL; their operators are tested
# against brute force, the stages themselves on small tables.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.run_all(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir, STAGES)
