"""Token-array columns: markers, truncation, padding, masks, shifts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_LIMIT = 1 << 32


def marker_first(ids: Column, marker: int) -> Column:
    return F.concat(F.array(F.lit(marker)), ids)


def marker_last(ids: Column, marker: int, max_len: int | None) -> Column:
    """Truncate to ``max_len`` ids, if there is a limit, of which the marker is the last."""
    if max_len is None:
        return F.concat(ids, F.array(F.lit(marker)))
    return F.concat(F.slice(ids, 1, max_len - 1), F.array(F.lit(marker)))


def truncate(ids: Column, max_len: int) -> Column:
    return F.slice(ids, 1, max_len)


def tokens_in_range(ids: Column, limit: int = TOKEN_LIMIT) -> Column:
    """Whether every id fits an unsigned integer of the shard format."""
    return F.forall(ids, lambda t: (t >= 0) & (t < F.lit(limit)))


def require_in_range(ids: Column, limit: int = TOKEN_LIMIT) -> Column:
    """``ids``, or the end of the job when one does not fit."""
    return F.when(tokens_in_range(ids, limit), ids).otherwise(
        F.raise_error(F.lit("token outside the range of the shard format"))
    )


def pad_right(ids: Column, length: Column, pad: int = 0) -> Column:
    return F.concat(ids, F.array_repeat(F.lit(pad), (length - F.size(ids)).cast("int")))


def padding_mask(padded: Column, pad: int = 0) -> Column:
    """True where the id is the pad id (also where that id is a real token)."""
    return F.transform(padded, lambda t: t == pad)


def attention_mask(padded: Column, pad: int = 0) -> Column:
    return F.transform(padded, lambda t: (t != pad).cast("float"))


def attention_mask_of_length(padded: Column, length: Column) -> Column:
    """Attention mask by position, for vocabularies whose pad id is a real token."""
    return F.transform(padded, lambda _, i: (i < length).cast("float"))


def shift_input(padded: Column) -> Column:
    """All ids but the last."""
    return F.slice(padded, F.lit(1), F.greatest(F.size(padded) - 1, F.lit(0)))


def shift_output(padded: Column) -> Column:
    """All ids but the first."""
    return F.slice(padded, F.lit(2), F.greatest(F.size(padded) - 1, F.lit(0)))


def marker_offsets(ids: Column, marker: int) -> Column:
    """Positions of ``marker`` in the array, from 0."""
    return F.filter(
        F.transform(ids, lambda t, i: F.when(t == marker, i)), lambda i: i.isNotNull()
    )


def marker_count(ids: Column, marker: int) -> Column:
    return F.size(ids) - F.size(F.array_remove(ids, marker))


def argmax(scores: Column) -> Column:
    """Position of the largest score, from 0; the first one of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")
