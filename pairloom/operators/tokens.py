"""From text pairs to token pairs: tokenising, length filter, pair limits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions import arrays, text
from pairloom.functions.tokenizers import Tokenizer
from pairloom.operators.prefix import number_rows, row_positions
from pairloom.session import join_null_safe, materialise


def strip_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns(
        {"src_text": text.strip(F.col("src_text")), "tgt_text": text.strip(F.col("tgt_text"))}
    )


def count_tokens(
    pairs: DataFrame, tokenizer: Tokenizer, marker: str | None = None, max_len: int | None = None
) -> DataFrame:
    """Add ``n_src`` and ``n_tgt``, the lengths ``encode_pairs`` will give.

    Filters and totals that need lengths only never make the ids.
    """

    def count(column: str):
        n = tokenizer.count(F.col(column)) + (1 if marker else 0)
        return F.least(n, F.lit(max_len)) if marker == "last" else n

    return pairs.withColumns({"n_src": count("src_text"), "n_tgt": count("tgt_text")})


def encode_pairs(
    pairs: DataFrame, tokenizer: Tokenizer, marker: str | None = None, max_len: int | None = None
) -> DataFrame:
    """Add ``src_ids`` and ``tgt_ids``.

    ``marker="first"`` puts the end-of-text id before the ids; ``"last"`` puts it
    behind them and truncates to ``max_len``, marker included.
    """

    def encode(column: str):
        ids = tokenizer.encode(F.col(column))
        if marker == "first":
            return arrays.marker_first(ids, tokenizer.eos_id)
        if marker == "last":
            return arrays.marker_last(ids, tokenizer.eos_id, max_len)
        return ids

    return pairs.withColumns({"src_ids": encode("src_text"), "tgt_ids": encode("tgt_text")})


def within_length(pairs: DataFrame, max_len: int | None) -> DataFrame:
    """Keep pairs whose both sides have at most ``max_len`` tokens, if there is a limit."""
    if max_len is None:
        return pairs
    return pairs.where((F.col("n_src") <= max_len) & (F.col("n_tgt") <= max_len))


def number_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Add ``pair_id``, dense from 0 in the order of ``keys`` in each language pair.

    The pairs are written on the way, so later stages scan a numbered table.
    """
    numbered = number_rows(pairs, ["lang_pair", *keys], "_n")
    # one row per language pair: written, so that the planner can broadcast it
    starts = materialise(
        numbered.groupBy("lang_pair").agg(F.min("_n").alias("_first")), "language-starts"
    )
    return join_null_safe(numbered, starts, ["lang_pair"]).select(
        *pairs.columns, (F.col("_n") - F.col("_first")).alias("pair_id")
    )


def limit_examined(pairs: DataFrame, max_pairs: int | None) -> DataFrame:
    """The first ``max_pairs`` input pairs of a language pair, before any filter.

    ``pair_id`` is dense in the language pair.
    """
    if max_pairs is None:
        return pairs
    return pairs.where(F.col("pair_id") < max_pairs)


def limit_kept(pairs: DataFrame, max_pairs: int | None) -> DataFrame:
    """The first ``max_pairs`` pairs of a language pair that earlier filters kept.

    Only ids are put in order, to find the last one of each language pair; the
    pairs themselves are filtered where they are.
    """
    if max_pairs is None:
        return pairs
    if max_pairs <= 0:
        return pairs.where(F.lit(False))
    last = (
        row_positions(pairs.select("lang_pair", "pair_id"), "pair_id", "_kept", by=["lang_pair"])
        .where(F.col("_kept") == max_pairs - 1)
        .select("lang_pair", F.col("pair_id").alias("_last"))
    )
    bounded = join_null_safe(pairs, materialise(last, "last-kept"), ["lang_pair"], "left")
    return bounded.where(F.col("_last").isNull() | (F.col("pair_id") <= F.col("_last"))).drop(
        "_last"
    )
