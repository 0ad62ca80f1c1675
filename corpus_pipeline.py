"""The corpus pipeline: each stage reads what the one before kept.

Language ID drops documents of no known language, line dedup deletes later
copies of long line runs, near-duplicate detection keeps one document of each
class, mixing repeats and drops documents to meet the sources' targets, and
packing adds length buckets and batches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from skein.llm import langid, linededup, mixing, neardup, packing
from skein.scratch import dropped, written

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", langid.stage),
    ("line_dedup", linededup.stage),
    ("near_dedup", neardup.stage),
    ("mixing", mixing.stage),
    ("packing", packing.stage),
]

#: Classifier, hashes and dynamic programming are beyond SQL; tests hold the pipeline against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; what a stage returns is written before the next one reads it, and kept until that one is written."""
    docs = before = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, f"pipeline-{name}")
            dropped(before)
            before = docs
    return docs
