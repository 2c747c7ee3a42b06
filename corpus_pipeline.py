"""A training corpus from documents: language, line dedup, near-dedup, mixing and token ids, each stage written as Parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from scrivano.llm import stages
from scrivano.llm.store import drop, materialise

STAGES = [
    ("language ID", stages.language),
    ("line dedup", stages.line_dedup),
    ("SimHash near-dedup", stages.near_dedup),
    ("mixing", stages.mix),
    ("BPE", stages.tokens),
]

#: SQL expresses neither the language model nor the token ids; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, f"stage-{i}")
            if before:  # what this run has written itself, and has read for the last time
                drop(before)
            before = docs
    return docs
