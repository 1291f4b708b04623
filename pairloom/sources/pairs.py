"""Pair rows from nested and line-aligned sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.text import language


def from_nested(nested: DataFrame) -> DataFrame:
    """``translation`` (a map from language to text) and ``lang_pair`` to flat pairs."""
    others = [c for c in nested.columns if c != "translation"]
    return nested.select(
        *others,
        F.try_element_at("translation", language(F.col("lang_pair"), 0)).alias("src_text"),
        F.try_element_at("translation", language(F.col("lang_pair"), 1)).alias("tgt_text"),
    )


def align_lines(source: DataFrame, target: DataFrame) -> DataFrame:
    """Line i of a source file with line i of the target file of the same number.

    Both tables have ``file_no, line_no, line``; other columns of the source
    stay. The shorter file ends the pair; empty lines stay. ``(file_no,
    line_no)`` is unique, so no key is hot.
    """
    return source.withColumnRenamed("line", "src_text").join(
        target.select("file_no", "line_no", F.col("line").alias("tgt_text")), ["file_no", "line_no"]
    )
