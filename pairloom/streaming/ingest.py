"""Streaming ingest: pairs arrive in files and leave in token shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.functions.tokenizers import Tokenizer
from pairloom.operators import pack, tokens
from pairloom.sources.shards import FOLDERS

STATE_SCHEMA = "grp string, open_tokens bigint, shard bigint"


def ingest(
    pairs: DataFrame,
    out: str,
    checkpoint: str,
    tokenizer: Tokenizer,
    max_len: int | None,
    shard_size: int,
) -> StreamingQuery:
    """Strip, tokenise, filter and pack a stream of ``pair_id, lang_pair,
    src_text, tgt_text`` into shards at ``out``.

    Each micro-batch goes on with the shard the batch before left open; what is
    open is kept as one row per language pair, written under the number of the
    batch like the data, so that a repeated batch overwrites its own output.

    The shards equal those of the batch job when the micro-batches arrive in
    the order of ``pair_id``: files appear in that order, and the source rows
    are whole pairs. The run ends when all files present have been read.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        counted = tokens.count_tokens(tokens.strip_pairs(batch), tokenizer, "first")
        kept = tokens.within_length(counted, max_len)
        carried = _state(spark, out, epoch - 1)
        packed = pack.pack_greedy(kept, shard_size, carry=carried)
        # files hold many shards, each shard in one file of the epoch; texts move, not their ids
        placed = packed.repartition("lang_pair", "shard_idx").sortWithinPartitions("lang_pair", "shard_idx", "pair_id")
        encoded = tokens.encode_pairs(placed, tokenizer, "first").withColumn(
            "split", pack.split_name()
        )
        target = f"{out}/pairs/epoch={epoch}"
        (
            encoded.drop("src_text", "tgt_text")
            .write.mode("overwrite")
            .partitionBy(*FOLDERS)
            .parquet(target)
        )
        written = spark.read.schema(encoded.drop("src_text", "tgt_text").schema).parquet(target)
        _next_state(written, carried, shard_size).write.mode("overwrite").parquet(
            f"{out}/state/epoch={epoch}"
        )

    return (
        pairs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _state(spark: SparkSession, out: str, epoch: int) -> DataFrame:
    if epoch < 0:
        return spark.createDataFrame([], STATE_SCHEMA)
    return spark.read.schema(STATE_SCHEMA).parquet(f"{out}/state/epoch={epoch}")


def _next_state(written: DataFrame, carried: DataFrame, shard_size: int) -> DataFrame:
    """Open shard and its tokens for each language pair, after this batch."""
    totals = written.groupBy(F.col("lang_pair").alias("grp"), F.col("shard_idx").alias("shard")).agg(
        F.sum(F.col("n_src") + F.col("n_tgt")).alias("open_tokens")
    )
    open_shards = (
        totals.unionByName(carried)
        .groupBy("grp", "shard")
        .agg(F.sum("open_tokens").cast("bigint").alias("open_tokens"))
        .groupBy("grp")
        .agg(F.max(F.struct("shard", "open_tokens")).alias("s"))
    )
    full = F.col("s.open_tokens") >= shard_size
    return open_shards.select(
        "grp",
        F.when(full, 0).otherwise(F.col("s.open_tokens")).cast("bigint").alias("open_tokens"),
        (F.col("s.shard") + F.when(full, 1).otherwise(0)).cast("bigint").alias("shard"),
    )
