"""From raw documents to token ids: language ID, exact and near dedup, mixing, SentencePiece."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import stages
from weftgraph.plans.shared import materialize

#: (name, function of (spark, docs, sf_dir)); each one's rows are written as Parquet and read again by the next.
STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", stages.identify_language),
    ("exact_dedup", stages.drop_exact_copies),
    ("jaccard_join", stages.drop_near_copies),
    ("mix_sources", stages.mix_to_targets),
    ("sentencepiece", stages.encode_pieces),
]

#: Language ID, mixing and encoding are beyond SQL; tests hold the run against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
