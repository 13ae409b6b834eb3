"""The corpus pipeline over ``documents``: toxicity filter, exact and near deduplication, decontamination, tokenization.

Each stage is a function of (spark, docs, sf_dir). Its result is written as Parquet to the shared folder and read again as
the next one's input, so a lost executor never costs more than a stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxlake.llm.stages import STAGES as _STAGES
from voxlake.session import materialize

STAGES = list(_STAGES)
#: Stages fit models and merge components, which SQL cannot express; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of the documents that pass all stages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
