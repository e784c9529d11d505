"""A corpus pipeline: each stage takes the documents that its predecessor kept.

run(spark, sf_dir) applies STAGES to the documents table, each result written as Parquet and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from liftwork.llm import exact_dedup, language, near_dedup, packing, quality
from liftwork.llm.common import documents, scratch
from liftwork.sources.scratch import discard, made

STAGES = [
    ("quality rules", quality.stage),
    ("language identification", language.stage),
    ("exact dedup", exact_dedup.stage),
    ("near dedup", near_dedup.stage),
    ("best-fit packing", packing.stage),
]

#: Robust estimates, trained models and tokenizers cannot be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, start = documents(spark, sf_dir), made()
    for name, stage in STAGES:
        docs = scratch(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        discard(spark, start, made() - 1)  # the stage's own tables and what it read
    return docs
