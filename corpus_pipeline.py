"""The stages that make training sequences from ``documents``, in their order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import stages
from pairloom.llm.tables import table
from pairloom.session import materialise

#: ``(name, function)``; a function takes (spark, docs, sf_dir) and returns a DataFrame.
STAGES = [
    ("known_language", stages.known_language),
    ("good_quality", stages.good_quality),
    ("near_deduplicated", stages.near_deduplicated),
    ("without_repeats", stages.without_repeats),
    ("best_fit_packing", stages.best_fit_packing),
]

#: SQL can express neither the learned models nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each writes its result, the next one reads it."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
