"""Bounded samples of labelled rows for fitting models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_SAMPLE = 20_000  # labelled documents that a model is fitted on, at most


def sample_rows(rows: DataFrame, key: str, seed: int, limit: int = MAX_SAMPLE) -> DataFrame:
    """The ``limit`` rows with the smallest hash of their key; all, if there are fewer.

    The order is kept in each task for ``limit`` rows only. A row is a few numbers, so
    that the result may be broadcast.
    """
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), F.col(key)).limit(limit)


def one_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key that is smallest by ``order``, so that repeated keys add none."""
    others = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.min_by(F.struct(*others), order).alias("row")).select(key, "row.*")


def crc_of_key(key: str) -> Column:
    """crc32 of the decimal key; 0 for a null key."""
    return F.coalesce(F.crc32(F.col(key).cast("string")), F.lit(0).cast("bigint"))
