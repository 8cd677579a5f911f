"""The corpus pipeline: quality, language, near duplicates, benchmark leaks, packing.

Each stage gets what the one before kept, stored as Parquet. The stages are not expressible in SQL; the tests
hold the pipeline against a plain version on a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hushgrid.llm import common, decontaminate, language_id, packing, quality, simhash

STAGES = [
    ("quality", quality.stage),
    ("language", language_id.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("packing", packing.stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
