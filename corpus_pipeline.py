"""A corpus pipeline: language ID, quality classifier, MinHash near-dedup, mixing to target weights, BPE encoding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from arandu.llm import stages

STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", stages.language_id),
    ("quality classifier", stages.quality),
    ("MinHash near-dedup", stages.near_dedup),
    ("mixing sources to target weights", stages.mixing),
    ("BPE encoding and decoding", stages.bpe),
]
#: Models, sketches and an automaton: SQL cannot express them; tests/llm/test_pipeline.py holds the rows against a plain version of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents, each written to the shared folder and read again by the next."""
    from arandu.llm.common import drop_stored, stored

    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{k}")
            if before is not None:
                drop_stored(before)
            before = docs
    return docs
