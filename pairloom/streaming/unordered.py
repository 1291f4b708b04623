"""Streaming ingest of pairs that arrive in any order.

Each language pair has a state: the next ``pair_id``, the open shard and its tokens, and the sizes
of the pairs that came too early. Pairs get their shard when all before them have come. Texts
are written as they arrive and wait for their shard on disk, so the state is a few numbers
for each pair that waits.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairloom.functions.tokenizers import Tokenizer
from pairloom.operators import pack, tokens
from pairloom.sources.shards import write_shards

PLACED = "lang_pair string, pair_id bigint, shard_idx bigint"
STATE = "next_id bigint, open_tokens bigint, shard bigint, ids array<bigint>, sizes array<bigint>"


def placed(counted: DataFrame, shard_size: int, max_len: int | None) -> DataFrame:
    """``PLACED`` of a stream of ``lang_pair, pair_id, n_src, n_tgt``.

    ``pair_id`` is dense from 0 in its language pair. A pair that is too long takes its number, but
    no place. A pair that comes again is left out.
    """
    fits = F.lit(True) if max_len is None else (F.col("n_src") <= max_len) & (F.col("n_tgt") <= max_len)
    sized = counted.select(
        "lang_pair", "pair_id",
        F.when(fits, F.col("n_src") + F.col("n_tgt")).otherwise(-1).cast("bigint").alias("size"),
    )

    def release(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        next_id, open_tokens, shard, waiting = 0, 0, 0, {}
        if state.exists:
            next_id, open_tokens, shard, ids, sizes = state.get
            waiting = dict(zip(ids, sizes))
        for part in parts:
            for pair_id, size in zip(part["pair_id"].tolist(), part["size"].tolist()):
                if pair_id >= next_id:
                    waiting[pair_id] = size
        out = []
        while next_id in waiting:
            size = waiting.pop(next_id)
            if size >= 0:
                out.append((key[0], next_id, shard))
                open_tokens += size
                if open_tokens >= shard_size:
                    shard, open_tokens = shard + 1, 0
            next_id += 1
        state.update((next_id, open_tokens, shard, list(waiting), list(waiting.values())))
        yield pd.DataFrame(out, columns=["lang_pair", "pair_id", "shard_idx"])

    return sized.groupBy("lang_pair").applyInPandasWithState(
        release, PLACED, STATE, "append", GroupStateTimeout.NoTimeout
    )


def ingest(
    pairs: DataFrame, out: str, checkpoint: str, tokenizer: Tokenizer, max_len: int | None, shard_size: int
) -> list[StreamingQuery]:
    """Read what has arrived of ``pair_id, lang_pair, src_text, tgt_text``: texts go to ``out/arrived``,
    places to ``out/placed``. A restart goes on with the states. ``finish`` makes the shards."""
    counted = tokens.count_tokens(tokens.strip_pairs(pairs), tokenizer, "first")

    def write(rows: DataFrame, name: str) -> StreamingQuery:
        return (
            rows.writeStream.format("parquet").outputMode("append")
            .option("path", f"{out}/{name}").option("checkpointLocation", f"{checkpoint}/{name}")
            .trigger(availableNow=True).start()
        )

    places = counted.select("lang_pair", "pair_id", "n_src", "n_tgt")
    return [write(counted, "arrived"), write(placed(places, shard_size, max_len), "placed")]


def finish(spark: SparkSession, out: str, tokenizer: Tokenizer) -> None:
    """Write the shards of all placed pairs to ``out/shards``."""
    arrived = spark.read.parquet(f"{out}/arrived").dropDuplicates(["lang_pair", "pair_id"])
    places = spark.read.schema(PLACED).parquet(f"{out}/placed")
    packed = arrived.join(places, ["lang_pair", "pair_id"]).withColumn("split", pack.split_name())

    def encode(rows: DataFrame) -> DataFrame:
        return tokens.encode_pairs(rows, tokenizer, "first").drop("src_text", "tgt_text")

    write_shards(packed, f"{out}/shards", encode=encode)
