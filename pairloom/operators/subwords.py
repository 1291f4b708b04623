"""Byte-pair merges learned from a corpus, and the tokeniser that they make.

A text is cut into chunks (a word with the blank before it, or another character). The
symbols of a chunk are its bytes at first; the pair of neighbours that is most frequent over
all chunks, on ties the smallest, becomes a symbol, and so on.

Learning works on distinct chunks with their counts. Pair counts are kept as a table; a round
changes them by what the chunks that hold a merged pair lose and gain. A round takes several
merges, those that the rule would take one after the other anyway (``independent``).

Bytes are written as the characters U+0000 to U+00FF, so that symbols are strings.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pairloom.functions.tokenizers import EOS_ID, FIRST_ID, PAD_ID, UNK_ID
from pairloom.session import materialise

CHUNK_PATTERN = r" ?[\p{L}\p{N}]+|[^\p{L}\p{N}]"
AT_ONCE = 64  # the most frequent pairs that a round looks at
MIN_COUNT = 2
STATE = "n bigint, symbols array<string>, left string, right string"
Pair = tuple[str, str]


def chunks(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(CHUNK_PATTERN), F.lit(0))


def count_chunks(texts: DataFrame, column: str) -> DataFrame:
    """``chunk, n`` of all texts; counted in each task before the shuffle."""
    return (
        texts.select(F.explode(chunks(F.col(column))).alias("chunk"))
        .groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))
    )


def independent(ranked: Sequence[tuple[str, str, int]], most: int) -> list[Pair]:
    """The first pairs, in order, that the rule takes one after the other whatever they change.

    Pairs without a common symbol do not change each other's counts. A merge can make new pairs
    only out of pairs with one of its symbols; if all of those are less frequent than
    the last pair taken, no new pair can come before it.
    """
    taken: list[Pair] = []
    symbols: set[str] = set()
    best = 1
    for k, (left, right, n) in enumerate(ranked[:most]):
        if symbols & {left, right}:
            break
        taken.append((left, right))
        symbols |= {left, right}
        if k + 1 < len(ranked) and ranked[k + 1][2] < n:
            best = k + 1
    return taken[:best]


def merge_symbols(symbols: Sequence[str], merged: set[Pair]) -> list[str]:
    """Join the neighbours that are a merged pair, from the left."""
    out: list[str] = []
    at = 0
    while at < len(symbols):
        if at + 1 < len(symbols) and (symbols[at], symbols[at + 1]) in merged:
            out.append(symbols[at] + symbols[at + 1])
            at += 2
        else:
            out.append(symbols[at])
            at += 1
    return out


def _state_batch(words: list[tuple[int, list[str]]], changes: Counter) -> pa.RecordBatch:
    """Rows of chunks with their symbols, and rows of pairs with what their counts change by."""
    pairs = [(left, right, n) for (left, right), n in changes.items() if n]
    k, m = len(words), len(pairs)
    columns = [
        pa.array([n for n, _ in words] + [n for *_, n in pairs], pa.int64()),
        pa.array([s for _, s in words] + [None] * m, pa.list_(pa.string())),
        pa.array([None] * k + [p[0] for p in pairs], pa.string()),
        pa.array([None] * k + [p[1] for p in pairs], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["n", "symbols", "left", "right"])


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words, changes = [], Counter()
        for chunk, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            symbols = list(chunk.encode().decode("latin-1"))
            if len(symbols) > 1:  # others have no pairs
                words.append((n, symbols))
                for pair in zip(symbols, symbols[1:]):
                    changes[pair] += n
        yield _state_batch(words, changes)


def _after(merged: set[Pair]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, changes = [], Counter()
            for n, symbols in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                pairs = list(zip(symbols, symbols[1:]))
                if not merged.isdisjoint(pairs):
                    symbols = merge_symbols(symbols, merged)
                    for pair in pairs:
                        changes[pair] -= n
                    for pair in zip(symbols, symbols[1:]):
                        changes[pair] += n
                if len(symbols) > 1:
                    words.append((n, symbols))
            yield _state_batch(words, changes)

    return run


def learn_merges(counted: DataFrame, merges: int, min_count: int = MIN_COUNT) -> list[tuple[str, str, int]]:
    """``(left, right, n)`` of at most ``merges`` merges, in order, from ``chunk, n`` of distinct chunks.

    ``n`` is the number of the pair when it was merged. The driver sees the most frequent
    pairs of a round only; chunks and counts are tables, written in each round.
    """
    state = materialise(counted.select("chunk", "n").mapInArrow(_begin, STATE), "subwords")
    counts = None
    learned: list[tuple[str, str, int]] = []
    while len(learned) < merges:
        changes = state.where("left is not null").select("left", "right", "n")
        every = changes if counts is None else counts.unionByName(changes)
        counts = materialise(
            every.groupBy("left", "right").agg(F.sum("n").alias("n")).where(F.col("n") >= 1), "pair-counts"
        )
        top = counts.where(F.col("n") >= min_count).orderBy(F.desc("n"), "left", "right").limit(AT_ONCE + 1).collect()
        ranked = [(r["left"], r["right"], r["n"]) for r in top]
        taken = independent(ranked, min(AT_ONCE, merges - len(learned)))
        if not ranked or not taken:
            break
        learned += ranked[: len(taken)]
        words = state.where("symbols is not null").select("n", "symbols")
        state = materialise(words.mapInArrow(_after(set(taken)), STATE), "subwords")
    return learned


class SubwordTokenizer:
    """Ids of bytes (byte + 3) and of merges, in their order, behind them; decoding gives the text back."""

    pad_id, eos_id, unk_id = PAD_ID, EOS_ID, UNK_ID

    def __init__(self, merges: Sequence[Pair]):
        self.merges = [tuple(m[:2]) for m in merges]

    def encode(self, text: Column) -> Column:
        rank = {pair: i for i, pair in enumerate(self.merges)}
        ids = {chr(b): FIRST_ID + b for b in range(256)}
        ids |= {left + right: FIRST_ID + 256 + i for i, (left, right) in reversed(list(enumerate(self.merges)))}

        def chunk_ids(chunk: str) -> list[int]:
            symbols = list(chunk.encode().decode("latin-1"))
            while len(symbols) > 1:
                first = min(zip(symbols, symbols[1:]), key=lambda pair: rank.get(pair, len(rank)))
                if first not in rank:
                    break
                symbols = merge_symbols(symbols, {first})
            return [ids[s] for s in symbols]

        def encode(lists: pa.Array) -> pa.Array:
            coded = lists.flatten().dictionary_encode()  # each distinct chunk of a batch once
            own = pa.array([chunk_ids(c) for c in coded.dictionary.to_pylist()], pa.list_(pa.int32()))
            found = own.take(coded.indices)
            sizes = np.concatenate([[0], np.cumsum(pc.list_value_length(found).to_numpy(zero_copy_only=False))])
            lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
            ends = sizes[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
            return pa.ListArray.from_arrays(
                pa.array(ends), found.flatten(), mask=lists.is_null() if lists.null_count else None
            )

        return arrow_udf(encode, "array<int>")(chunks(text))

    def count(self, text: Column) -> Column:
        return F.size(self.encode(text))

    def decode(self, ids: Column) -> Column:
        values = [bytes([b]) for b in range(256)] + [(left + right).encode("latin-1") for left, right in self.merges]

        def decode(lists: pa.Array) -> pa.Array:
            out = []
            for row in lists.to_pylist():
                known = None if row is None else b"".join(values[i - FIRST_ID] for i in row if i >= FIRST_ID)
                out.append(known if known is None else known.decode("utf-8", "replace"))
            return pa.array(out, pa.string())

        return arrow_udf(decode, "string")(ids)
