"""Corpus totals and length profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import word_count

SEQUENCE_LENGTH = 1024


def corpus_totals(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Pairs and tokens of a corpus (``n_src``, ``n_tgt``)."""
    return pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum("n_src").cast("bigint").alias("src_tokens"),
        F.sum("n_tgt").cast("bigint").alias("tgt_tokens"),
        F.sum(F.col("n_src") + F.col("n_tgt")).cast("bigint").alias("tokens"),
    )


def length_profile(texts: DataFrame, text: str, tokens: Column, by: list[str]) -> DataFrame:
    """Words, tokens, their ratio, and the words that fit 1024 tokens."""
    sums = texts.groupBy(*by).agg(
        F.sum(word_count(F.col(text))).cast("bigint").alias("words"),
        F.sum(tokens).cast("bigint").alias("tokens"),
    )
    ratio = F.col("tokens") / F.nullif(F.col("words"), F.lit(0))
    return sums.select(
        "*",
        ratio.alias("tokens_per_word"),
        F.round(SEQUENCE_LENGTH / F.nullif(ratio, F.lit(0.0))).cast("bigint").alias("words_in_1024"),
    )
