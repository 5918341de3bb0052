"""Cleaning and packing of the documents table: five stages, each stored as Parquet before the next reads it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qualab.llm import ngram_join, packing, passages, secrets, toxicity
from qualab.llm.common import stored, table

STAGES = [
    ("toxicity", toxicity.stage),  # documents that are predicted toxic go
    ("n-gram Jaccard join", ngram_join.stage),  # of each group of near copies one document stays
    ("substring dedup", passages.stage),  # a passage stays where it comes first
    ("secret scans", secrets.stage),  # secrets are replaced in the text
    ("best-fit packing", packing.stage),  # the packed pieces
]

#: Trained weights, quantile packing and span alignment are beyond SQL: checked against brute force in tests/llm.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table; the last stage's rows (packed pieces)."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stored(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
