"""From raw documents to packed training sequences, stage after stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import stages
from faultline.llm.common import documents
from faultline.session import materialize

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", stages.quality_rules),
    ("language ID", stages.language_id),
    ("exact dedup", stages.exact_dedup),
    ("SimHash near-dedup", stages.near_dedup),
    ("best-fit packing", stages.best_fit_packing),
]
# Learned rules and tokenizers have no SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage over all documents; each stage reads what the one before has written."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
