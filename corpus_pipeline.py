"""The corpus pipeline: documents without toxic ones, exact copies and near copies, mixed to target
weights, then encoded and decoded. Each stage reads what the one before has written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import queries as q

STAGES = [
    ("toxicity", q.stage_toxicity),
    ("exact_dedup", q.stage_exact_dedup),
    ("near_dedup", q.stage_near_dedup),
    ("mixing", q.stage_mixing),
    ("byte_bpe", q.stage_byte_bpe),
]

#: No SQL for run(): a trained classifier, sketches and merges are not expressible in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.run_stages(spark, STAGES, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)
