"""A training corpus from raw documents: each stage works on all that the one before has kept.

Stages are functions of (spark, docs, sf_dir); their results are written as Parquet in the shared
folder and read again as the next stage's documents. All but the last return the columns of
documents. SQL cannot express the stages, so ORACLE_SQL is None and tests hold each of them against
brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bizlens.llm.common import settled, table
from bizlens.llm.decontam import decontamination_stage
from bizlens.llm.language import language_stage
from bizlens.llm.lines import line_stage
from bizlens.llm.neardup import neardup_stage
from bizlens.llm.packing import packing_stage

STAGES = [
    ("language_id", language_stage),
    ("line_dedup", line_stage),
    ("near_dedup", neardup_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settled(stage(spark, docs, sf_dir), name)
    return docs
