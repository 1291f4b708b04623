"""Stages of the corpus pipeline; all but the last return the columns of ``documents``.

In every stage a null text is an empty one, null keys are smaller than any other, an empty
table gives an empty one, and further columns, whatever their names, pass unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import bestfit, chosen_path, languages, phrases, quality
from pairloom.llm.queries import END_ID, vocabulary
from pairloom.llm.tables import table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which one language makes up a large part.

    Texts that are null, empty or without letters go; repeated rows are judged alike; if no row
    has a language, no language is known and all go.
    """
    return languages.keep_known(docs)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that neither the fixed rules nor the learned list reject.

    Null and empty texts have no words and go; repeated rows are judged alike; without
    labels only the fixed rules reject.
    """
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest key of each group of near-duplicates.

    Null and empty texts are like nothing and stay; rows of one key, null keys too, are one
    document, so they stay or go together.
    """
    return chosen_path.keep_one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that also occur earlier.

    Every row stays; null and empty texts are unchanged; rows of one key do not count against
    each other, so repeated rows lose the same words.
    """
    return phrases.without_repeats(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of at most 1024 tokens; one row per piece of a document.

    Null and empty texts are the end id alone; every row is packed, also repeated ones and
    those without a key.
    """
    return bestfit.pack(docs, vocabulary("byte_bpe_50k.json"), END_ID)
