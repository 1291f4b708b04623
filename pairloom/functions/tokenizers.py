"""Tokenisers as column builders.

A tokeniser offers ``encode`` (text to ids), ``count`` (number of ids, without
making them where that is possible) and ``decode`` (ids to text). The Arrow
functions work on whole record batches; nothing is done row by row.
"""

from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Fixed values of the published byte scheme, also used for the word tokeniser.
PAD_ID, EOS_ID, UNK_ID, FIRST_ID = 0, 1, 2, 3

DECODED_IDS = 1 << 20  # about so many are decoded in one step

WORD_PATTERN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"


class Tokenizer(Protocol):
    eos_id: int

    def encode(self, text: Column) -> Column: ...

    def count(self, text: Column) -> Column: ...

    def decode(self, ids: Column) -> Column: ...


def _lists(values, like: pa.Array) -> pa.Array:
    """Lists with the lengths and nulls of ``like`` and new ``values``."""
    lengths = pc.fill_null(pc.list_value_length(like), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(ends), values, mask=like.is_null() if like.null_count else None
    )


def _byte_encode(text: pa.Array) -> pa.Array:
    raw = text.cast(pa.binary())
    starts = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset : raw.offset + len(raw) + 1]
    data = raw.buffers()[2]
    data = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data else np.empty(0, np.uint8)
    return pa.ListArray.from_arrays(
        pa.array(starts - starts[0]),
        pa.array(data.astype(np.int32) + FIRST_ID),
        mask=text.is_null() if text.null_count else None,
    )


def _byte_decode(ids: pa.Array) -> pa.Array:
    """Texts of a batch, some of its rows at a time: the steps take many times the room of a text."""
    ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False))
    last = int(ends[-1]) if len(ends) else 0
    cuts = np.unique(np.searchsorted(ends, np.arange(DECODED_IDS, last, DECODED_IDS)) + 1)
    at = [0, *cuts[cuts < len(ids)].tolist(), len(ids)]
    return pa.concat_arrays([_decode_rows(ids.slice(a, b - a)) for a, b in zip(at, at[1:])])


def _decode_rows(ids: pa.Array) -> pa.Array:
    flat = ids.flatten()
    if pc.any(pc.greater(flat, FIRST_ID + 255)).as_py():
        raise ValueError("an id is no byte")
    kept = pc.fill_null(pc.greater_equal(flat, FIRST_ID), False)
    flags = np.concatenate([[0], np.cumsum(kept.to_numpy(zero_copy_only=False))])
    lengths = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    ends = flags[np.concatenate([[0], np.cumsum(lengths)])].astype(np.int32)
    data = (ids.flatten().filter(kept).to_numpy() - FIRST_ID).astype(np.uint8)
    text = pa.Array.from_buffers(
        pa.binary(), len(ids), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes())]
    )
    try:
        text = text.cast(pa.string())
    except pa.ArrowInvalid:  # ids that are no UTF-8: replaced, as decoders of ids do
        text = pa.array([x.as_py().decode("utf-8", "replace") for x in text], pa.string())
    return pc.if_else(ids.is_valid(), text, None) if ids.null_count else text


class ByteTokenizer:
    """One id for each UTF-8 byte (byte + 3)."""

    pad_id, eos_id, unk_id = PAD_ID, EOS_ID, UNK_ID

    def encode(self, text: Column) -> Column:
        return arrow_udf(_byte_encode, "array<int>")(text)

    def count(self, text: Column) -> Column:
        return F.octet_length(text)

    def decode(self, ids: Column) -> Column:
        return arrow_udf(_byte_decode, "string")(ids)

    def encode_native(self, text: Column) -> Column:
        """The same ids without a Python worker, for small texts."""

        def one(char: Column) -> Column:
            digits = F.hex(F.encode(char, "UTF-8"))
            return F.transform(
                F.sequence(F.lit(1), F.octet_length(char)),
                lambda i: F.conv(F.substring(digits, 2 * i - 1, F.lit(2)), 16, 10).cast("int")
                + FIRST_ID,
            )

        return F.flatten(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), one))


def word_tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, and single other characters."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))


def count_words(texts: DataFrame, column: str) -> DataFrame:
    """``token, n`` of all words; counted in each task before the shuffle."""
    return (
        texts.select(F.explode(word_tokens(F.col(column))).alias("token"))
        .groupBy("token")
        .agg(F.count(F.lit(1)).alias("n"))
    )


class WordTokenizer:
    """Words of a short list, from id 3 on; ``operators.vocabulary`` is for larger ones."""

    pad_id, eos_id, unk_id = PAD_ID, EOS_ID, UNK_ID

    def __init__(self, vocabulary: Sequence[str]):
        self.vocabulary = list(vocabulary)

    def encode(self, text: Column) -> Column:
        known = pa.array(self.vocabulary, pa.string())

        def encode(tokens: pa.Array) -> pa.Array:
            at = pc.index_in(tokens.flatten(), value_set=known)
            ids = pc.fill_null(pc.add(at, FIRST_ID), UNK_ID).cast(pa.int32())
            return _lists(ids, tokens)

        return arrow_udf(encode, "array<int>")(word_tokens(text))

    def count(self, text: Column) -> Column:
        return F.regexp_count(F.lower(text), F.lit(WORD_PATTERN))

    def decode(self, ids: Column) -> Column:
        """Words joined by a blank; special ids are left out."""
        known = pa.array(self.vocabulary, pa.string())

        def decode(lists: pa.Array) -> pa.Array:
            at = pc.subtract(lists.flatten(), FIRST_ID)
            inside = pc.and_(pc.greater_equal(at, 0), pc.less(at, len(known)))
            words = known.take(pc.if_else(inside, at, None))
            return _lists(words, lists)

        found = arrow_udf(decode, "array<string>")(ids)
        return F.array_join(found, " ")
