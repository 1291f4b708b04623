"""A succinct index of the markers of token streams, and access to sequences by number.

The marker positions of a stream are an Elias-Fano list: the low bits of each position
side by side, and the high bits in unary, so that a marker takes about two bits more
than the logarithm of its mean distance. ``select`` gives the i-th position from the two bit
strings. A sequence number becomes a shard by the counts of the index, and a range of
tokens by ``select``; only then are tokens read, of the shards asked for alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import arrays
from pairloom.operators.prefix import int_div, ordered_prefix
from pairloom.operators.segment import loader_keys, shard_keys, stream_keys
from pairloom.session import join_null_safe, materialise

PRUNED_SHARDS = 1000  # named one by one in the filter of a scan; more are told apart by the join
LIST = "n bigint, n_tokens bigint, width int, low binary, high binary"


def encode(positions: np.ndarray, universe: int) -> tuple[int, bytes, bytes]:
    """``(width, low, high)`` of rising positions below ``universe``."""
    n = len(positions)
    width = max(0, (universe // max(1, n)).bit_length() - 1)
    positions = positions.astype(np.uint64)
    shifts = np.arange(width, dtype=np.uint64)[::-1]
    low = (positions[:, None] >> shifts & np.uint64(1)).astype(np.uint8)
    high = np.zeros(n + (universe >> width) + 1, np.uint8)
    high[(positions >> np.uint64(width)).astype(np.int64) + np.arange(n)] = 1
    return width, np.packbits(low.reshape(-1)).tobytes(), np.packbits(high).tobytes()


def select(width: int, low: bytes, high: bytes, at: np.ndarray) -> np.ndarray:
    """The positions number ``at`` (from 0)."""
    bits = np.frombuffer(high, np.uint8)
    ones = np.cumsum(np.bitwise_count(bits).astype(np.int64))
    byte = np.searchsorted(ones, at, "right")
    rank = at - np.where(byte > 0, ones[byte - 1], 0)
    inside = np.cumsum(np.unpackbits(bits[byte][:, None], axis=1), axis=1)
    place = (inside == rank[:, None] + 1).argmax(axis=1)
    out = (8 * byte + place - at) << width
    if width:
        packed = np.frombuffer(low, np.uint8)
        where = at[:, None] * width + np.arange(width)
        digits = packed[where >> 3] >> (7 - (where & 7)).astype(np.uint8) & 1
        out = out | (digits.astype(np.int64) << np.arange(width)[::-1]).sum(axis=1)
    return out


def build_index(runs: DataFrame, marker: int) -> DataFrame:
    """The keys of each stream with its marker list (``LIST``). A stream is a side of a shard, so of bounded size."""
    stream = stream_keys(runs)
    offsets = F.transform(arrays.marker_offsets(F.col("tokens"), marker), lambda i: F.col("pos") + i)
    gathered = runs.select(*stream, "pos", F.size("tokens").alias("n"), offsets.alias("at")).groupBy(*stream).agg(
        F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "at"))), lambda r: r["at"])).alias("at"),
        F.sum("n").alias("n_tokens"),
    )
    kinds = dict(runs.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in stream] + [LIST])

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *keys, at, n_tokens = batch.columns
            lists = [np.asarray(x.values if x.values is not None else []) for x in at]
            made = [encode(p, u) for p, u in zip(lists, n_tokens.to_pylist())]
            width, low, high = zip(*made) if made else ((), (), ())
            columns = [
                *keys, pa.array(list(map(len, lists)), pa.int64()), n_tokens,
                pa.array(width, pa.int32()), pa.array(low, pa.binary()), pa.array(high, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[f.split()[0] for f in schema.split(", ")])

    return gathered.select(*stream, "at", F.col("n_tokens").cast("bigint")).mapInArrow(make, schema)


def located(index: DataFrame, requests: DataFrame) -> DataFrame:
    """Requests (``idx`` and the loader's keys) with ``n``, their shard and ``seq_id``.

    Numbers past the end start again at 0. The shard is the last one that starts at or before the
    number: a running maximum over starts and distinct numbers in one order.
    """
    loader = loader_keys(index)
    counts = index.where((F.col("side") == "src") & (F.col("n") > 0)).select(*loader, "shard_idx", "n")
    starts = materialise(
        ordered_prefix(counts, "shard_idx", {"start": ("sum", F.col("n"))}, by=loader, inclusive=False), "starts"
    )
    one = F.lit(0).alias("_one")  # stands for a table without loader keys
    totals = materialise(starts.groupBy(*loader).agg(F.sum("n").alias("_total")).select("*", one), "totals")
    asked = join_null_safe(requests.select("*", one), totals, [*loader, "_one"]).withColumn(
        "n", F.pmod("idx", F.col("_total"))
    )
    asked = materialise(asked.drop("_total", "_one"), "asked")
    numbers = asked.select(*loader, "n", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("start"))
    both = numbers.distinct().unionByName(
        starts.select(*loader, F.col("start").alias("n"), F.lit(0).alias("kind"), "start")
    )
    found = ordered_prefix(
        both, ["n", "kind"], {"begin": ("max", F.col("start"))}, by=loader, block=int_div(F.col("n"), 1 << 16)
    ).where(F.col("kind") == 1)
    shards = starts.select(*loader, F.col("start").alias("begin"), "shard_idx")
    places = join_null_safe(found.select(*loader, "n", "begin"), shards, [*loader, "begin"]).select(
        *loader, "n", "shard_idx", (F.col("n") - F.col("begin")).alias("seq_id")
    )
    return join_null_safe(asked, places, [*loader, "n"])


def token_ranges(index: DataFrame, wanted: DataFrame, marker_at: str = "first") -> DataFrame:
    """Shard, ``seq_id``, ``side``, ``begin`` and ``stop`` of the sequences ``wanted`` (shard, ``seq_id``).

    The numbers asked of a shard are gathered, so that its list is read once.
    """
    shard = shard_keys(index)
    gathered = wanted.groupBy(*shard).agg(F.collect_set("seq_id").alias("asked"))
    rows = join_null_safe(index, gathered, shard).select(*shard, "side", "n", "n_tokens", "width", "low", "high", "asked")
    kinds = dict(index.dtypes)
    schema = ", ".join([f"{c} {kinds[c]}" for c in [*shard, "side"]] + ["seq_id bigint, begin bigint, stop bigint"])
    names = [*shard, "side", "seq_id", "begin", "stop"]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, n_tokens, width, low, high, asked = (c[i] for c in batch.columns[len(shard) + 1 :])
                count, end = n.as_py(), n_tokens.as_py()
                at = np.sort(np.asarray(asked.values))
                at = at[at < count]

                def marker(k: np.ndarray) -> np.ndarray:
                    known = np.clip(k, 0, count - 1)
                    place = select(width.as_py(), low.as_py(), high.as_py(), known)
                    return np.where(k >= count, end, place)

                if marker_at == "first":
                    from_, to = marker(at), marker(at + 1)
                else:
                    from_, to = np.where(at > 0, marker(at - 1) + 1, 0), marker(at)
                own = batch.slice(i, 1).columns[: len(shard) + 1]
                keys = [c.take(pa.array(np.zeros(len(at), np.int64))) for c in own]
                yield pa.RecordBatch.from_arrays([*keys, *[pa.array(x, pa.int64()) for x in (at, from_, to)]], names=names)

    return rows.mapInArrow(find, schema)


def only_shards(runs: DataFrame, asked: DataFrame) -> DataFrame:
    """``runs`` without the folders of shards that nobody has asked for."""
    shard = shard_keys(runs)
    named = asked.select(*shard).distinct().limit(PRUNED_SHARDS + 1).collect()
    if len(named) > PRUNED_SHARDS:
        return runs
    each = [reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(row[c])) for c in shard]) for row in named]
    return runs.where(reduce(lambda a, b: a | b, each, F.lit(False)))


def read_sequences(runs: DataFrame, ranges: DataFrame, chunk: int) -> DataFrame:
    """Shard, ``seq_id``, ``source`` and ``target`` of token ranges; the runs begin at multiples of ``chunk``."""
    stream, shard = stream_keys(runs), shard_keys(runs)
    last = F.greatest(F.col("stop") - 1, F.col("begin"))
    pieces = ranges.select(
        *stream, "seq_id", "begin", "stop",
        F.explode(F.sequence(int_div(F.col("begin"), chunk), int_div(last, chunk))).alias("chunk"),
    )
    stored = only_shards(runs, ranges).withColumn("chunk", int_div(F.col("pos"), chunk))
    start = F.greatest(F.col("begin"), F.col("pos"))
    end = F.least(F.col("stop"), F.col("pos") + F.size("tokens"))
    piece = F.slice("tokens", (start - F.col("pos") + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
    found = join_null_safe(pieces, stored, [*stream, "chunk"], "left").select(
        *stream, "seq_id", "pos", F.coalesce(piece, F.array().cast("array<int>")).alias("tokens")
    )

    def side(name: str):
        own = F.collect_list(F.when(F.col("side") == name, F.struct("pos", "tokens")))
        return F.flatten(F.transform(F.sort_array(own), lambda p: p["tokens"]))

    return found.groupBy(*shard, "seq_id").agg(side("src").alias("source"), side("tgt").alias("target"))
