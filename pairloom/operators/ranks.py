"""Distribution of shards and sequences over ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.operators.prefix import int_div, row_positions
from pairloom.operators.segment import loader_keys
from pairloom.session import join_null_safe, materialise


def rank_shards(shards: DataFrame, world_size: int) -> DataFrame:
    """Every ``world_size``-th shard of the sorted list goes to a rank.

    The place in the list of its language pair and split counts, not the shard number.
    """
    return row_positions(shards, "shard_idx", by=loader_keys(shards)).withColumn(
        "rank", F.pmod("position", F.lit(world_size))
    )


def rank_sequences(seqs: DataFrame, world_size: int, position: str = "position") -> DataFrame:
    """Every ``world_size``-th sequence of a language pair and split goes to a rank; the
    first sequences are given out again where the ranks would not get equally many.

    ``rank_row`` is the place of the sequence in its rank.
    """
    keys = loader_keys(seqs)
    # a constant key stands for a table without language pair and split
    one = seqs.withColumn("_one", F.lit(0))
    # a row for each language pair and split: written, so that the planner broadcasts it
    totals = materialise(one.groupBy("_one", *keys).agg(F.count(F.lit(1)).alias("_total")), "totals")
    placed = join_null_safe(one, totals, ["_one", *keys])
    total = F.col("_total")
    missing = F.pmod(-total, F.lit(world_size))
    # when there are fewer sequences than missing places, they repeat more than once
    last = F.call_function("div", total + missing - 1 - F.col(position), total)
    filled = placed.withColumn(
        "_turn", F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    ).withColumn("_slot", F.col("_turn") * total + F.col(position))
    return filled.select(
        *seqs.columns,
        F.pmod("_slot", F.lit(world_size)).alias("rank"),
        int_div(F.col("_slot"), world_size).alias("rank_row"),
    )
