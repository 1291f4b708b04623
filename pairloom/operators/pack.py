"""Greedy packing of an ordered corpus into shards of a given token size.

A shard is closed by the first pair that brings its total to ``size``; the next
shard starts empty, so every boundary depends on the one before it. To find all
boundaries in parallel, the order is cut into segments of a bounded number of
rows and each segment is reduced to a step function: from the number of tokens
still missing on entry to the number missing on exit, and how many shards were
closed on the way. Different entries soon meet at the same boundary, so the
functions are small. They are composed in a tree (``fan`` at a time), the entry
of each segment is read back down the tree, and each segment then places its own
boundaries. No step is longer than ``fan`` segments, and the number of Spark
jobs depends on the depth of the tree only.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.prefix import int_div
from pairloom.session import join_null_safe, materialise

SEGMENT_ROWS = 1 << 22
FAN = 16
CALL_ROWS = 1 << 12  # keys of the small segments that a call takes together

_STEPS_SCHEMA = "grp string, seg bigint, total bigint, missing array<bigint>, left array<bigint>, closed array<bigint>"
_ENTRY_SCHEMA = "grp string, seg bigint, missing bigint, shard bigint"
_BOUNDS_SCHEMA = "grp string, blk bigint, base bigint, bounds array<bigint>"


# --- step functions of segments (numpy, inside tasks) ---------------------------


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64, copy=False)


def _segment_rows(table: pa.Table):
    """Segments of rows in order: each with its order keys and running token totals."""
    segs, keys, tokens = (_column(table, c) for c in ("seg", "ord", "tok"))
    order = np.lexsort((keys, segs))
    segs, keys, tokens = segs[order], keys[order], tokens[order]
    found, starts = np.unique(segs, return_index=True)
    for seg, a, b in zip(found.tolist(), starts, [*starts[1:], len(segs)]):
        yield seg, keys[a:b], np.cumsum(tokens[a:b])


def _steps_of_rows(ends: np.ndarray, size: int):
    """Step function of one segment from its running totals."""
    first = min(len(ends), int(np.searchsorted(ends, size)) + 1)
    last = np.arange(first)
    closed = np.ones(first, dtype=np.int64)
    while True:
        following = np.searchsorted(ends, ends[last] + size)
        inside = following < len(ends)
        if not inside.any():
            break
        last = np.where(inside, following, last)
        closed += inside
    total = int(ends[-1])
    return _merge_steps(total, ends[:first], ends[last] + size - total, closed)


def _merge_steps(total: int, missing: np.ndarray, left: np.ndarray, closed: np.ndarray):
    """Keep only the upper end of each run of entries with the same outcome."""
    keep = np.ones(len(missing), dtype=bool)
    keep[:-1] = (left[1:] != left[:-1]) | (closed[1:] != closed[:-1])
    return total, missing[keep], left[keep], closed[keep]


def _advance(steps, missing: np.ndarray, closed: np.ndarray):
    """Carry entries (tokens missing, shards closed) through one segment."""
    total, upper, left, count = steps
    inside = missing <= total
    at = np.searchsorted(upper, np.minimum(missing, total))
    at = np.minimum(at, len(upper) - 1)
    return (
        np.where(inside, left[at], missing - total),
        closed + np.where(inside, count[at], 0),
    )


def _compose(parts, size: int):
    """Step function of consecutive segments taken together."""
    upper, total = [], 0
    for part in parts:
        if total < size:
            upper.append(part[1] + total)
        total += part[0]
    upper = np.unique(np.concatenate(upper))
    upper = upper[: int(np.searchsorted(upper, size)) + 1]
    missing, closed = upper, np.zeros(len(upper), dtype=np.int64)
    for part in parts:
        missing, closed = _advance(part, missing, closed)
    return _merge_steps(total, upper, missing, closed)


def _steps_table(group: str, segment: int, steps) -> pa.Table:
    total, missing, left, closed = steps
    lists = [pa.array([values], pa.list_(pa.int64())) for values in (missing, left, closed)]
    return pa.table(
        [pa.array([group], pa.string()), pa.array([segment], pa.int64()), pa.array([total], pa.int64()), *lists],
        names=["grp", "seg", "total", "missing", "left", "closed"],
    )


def _read_steps(table: pa.Table):
    """Segments of a steps table in order, each with its step function."""
    table = table.sort_by("seg").combine_chunks()
    lists = {name: table.column(name) for name in ("missing", "left", "closed")}
    for i in range(table.num_rows):
        yield table.column("seg")[i].as_py(), (
            table.column("total")[i].as_py(),
            *[lists[name][i].values.to_numpy() for name in ("missing", "left", "closed")],
        )


# --- Spark jobs ----------------------------------------------------------------


def _reduce_rows(size: int) -> Callable:
    def reduce(key, table):
        return pa.concat_tables(
            [_steps_table(key[0].as_py(), seg, _steps_of_rows(ends, size)) for seg, _, ends in _segment_rows(table)]
        ).combine_chunks()

    return reduce


def _reduce_steps(size: int) -> Callable:
    def reduce(key, table):
        parts = [steps for _, steps in _read_steps(table)]
        return _steps_table(key[0].as_py(), key[1].as_py(), _compose(parts, size))

    return reduce


def _hand_down(key, children, entry):
    missing, shard = _column(entry, "missing"), _column(entry, "shard")
    out = []
    for segment, steps in _read_steps(children):
        out.append((key[0].as_py(), segment, int(missing[0]), int(shard[0])))
        missing, shard = _advance(steps, missing, shard)
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.table(
        [pa.array(values, kind) for values, kind in zip(zip(*out), kinds)],
        names=["grp", "seg", "missing", "shard"],
    )


def _place_bounds(size: int, width: int) -> Callable:
    def place(group: str | None, keys: np.ndarray, ends: np.ndarray, missing: int, shard: int) -> pa.Table:
        at = int(np.searchsorted(ends, missing))
        closing = []
        while at < len(ends):
            closing.append(at)
            at = int(np.searchsorted(ends, ends[at] + size))
        closing = keys[closing] if closing else np.empty(0, dtype=np.int64)
        blocks = np.unique(keys // width)
        lows = np.searchsorted(closing, blocks * width)
        highs = np.searchsorted(closing, (blocks + 1) * width)
        return pa.table(
            [
                pa.array([group] * len(blocks), pa.string()),
                pa.array(blocks),
                pa.array(lows + shard, pa.int64()),
                pa.array(
                    [closing[a:b] for a, b in zip(lows, highs)], pa.list_(pa.int64())
                ),
            ],
            names=["grp", "blk", "base", "bounds"],
        )

    return place


def _from_entry(size: int, width: int) -> Callable:
    place = _place_bounds(size, width)

    def placed(key, rows, entry):
        entries = dict(zip(entry.column("seg").to_pylist(), zip(*(entry.column(c).to_pylist() for c in ("missing", "shard")))))
        group = key[0].as_py()
        return pa.concat_tables(
            [place(group, keys, ends, *entries[seg]) for seg, keys, ends in _segment_rows(rows)]
        ).combine_chunks()

    return placed


def greedy_bounds(
    rows: DataFrame,
    size: int,
    carry: DataFrame | None = None,
    segment_rows: int = SEGMENT_ROWS,
    fan: int = FAN,
) -> tuple[DataFrame, int]:
    """Shard boundaries of ``rows`` (``grp``, ``ord``, ``tok``).

    ``ord`` is a unique BIGINT, at least 0, and the packing is independent for
    each ``grp``. ``carry`` (``grp``, ``open_tokens``, ``shard``) continues
    packings begun before. Returns a table with one row per block of ``ord``
    that holds rows (shards closed before the block, and the keys that close one
    inside it) and the width of those blocks. ``segment_rows`` is a power of two.
    """
    stats = rows.agg(
        F.min("ord").alias("lo"), F.max("ord").alias("hi"), F.sum("tok").alias("tokens")
    ).first()
    low, high = stats["lo"] or 0, stats["hi"] or 0
    first = low // segment_rows
    segments = high // segment_rows - first + 1
    shards = max(1, (stats["tokens"] or 0) // size)
    # about eight boundaries in a block, so that looking one up stays cheap
    width = min(segment_rows, max(64, 8 * (high - low + 1) // shards))
    width = 1 << (width.bit_length() - 1)

    # a call takes many small segments, or a large one; tasks go by their number, not by bytes
    bundle = max(1, CALL_ROWS // segment_rows)
    calls = -(-segments // bundle)
    tasks = min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), calls)
    seg = int_div(F.col("ord"), segment_rows) - first
    rows = rows.withColumns({"seg": seg, "call": int_div(seg, bundle)}).repartition(tasks, "grp", "call")
    in_calls = rows.groupBy("grp", "call")

    # up: reduce the segments, then groups of them, until one group holds all
    levels: list[DataFrame] = []
    count = segments
    while count > 1:
        if levels:
            grouped = levels[-1].withColumn("up", int_div(F.col("seg"), fan)).groupBy("grp", "up")
            table = grouped.applyInArrow(_reduce_steps(size), _STEPS_SCHEMA)
        else:
            table = in_calls.applyInArrow(_reduce_rows(size), _STEPS_SCHEMA)
        levels.append(materialise(table, "pack-steps"))
        count = -(-count // fan)

    # down: from the start of the order to the entry of each segment
    # (the group column is a new one, since the entries meet the rows again)
    entry = rows.select(F.col("grp").alias("grp")).distinct()
    missing, shard = F.lit(size), F.lit(0)
    if carry is not None:
        entry = join_null_safe(entry, carry, ["grp"], "left")
        missing = missing - F.coalesce("open_tokens", F.lit(0))
        shard = F.coalesce("shard", F.lit(0))
    entry = entry.select(
        F.col("grp").alias("grp"),
        F.lit(0).cast("bigint").alias("seg"),
        missing.cast("bigint").alias("missing"),
        shard.cast("bigint").alias("shard"),
    )
    for level in reversed(levels):
        children = level.withColumn("up", int_div(F.col("seg"), fan))
        entry = (
            children.groupBy("grp", "up")
            .cogroup(entry.withColumnRenamed("seg", "up").groupBy("grp", "up"))
            .applyInArrow(_hand_down, _ENTRY_SCHEMA)
        )
    entry = entry.withColumn("call", int_div(F.col("seg"), bundle))
    bounds = in_calls.cogroup(entry.groupBy("grp", "call")).applyInArrow(
        _from_entry(size, width), _BOUNDS_SCHEMA
    )
    return materialise(bounds, "pack-bounds"), width


def shard_of(
    df: DataFrame, order: str, group: Column, bounds: DataFrame, width: int, name: str = "shard_idx"
) -> DataFrame:
    """Add the shard of each row, from boundaries by order key (not by total,
    which a pair without tokens shares with the pair before it)."""
    keyed = df.select(
        "*", group.alias("grp"), int_div(F.col(order), width).alias("blk")
    )
    before = F.size(F.filter("bounds", lambda bound: bound < F.col(order)))
    return join_null_safe(keyed, bounds, ["grp", "blk"]).select(
        *df.columns, (F.col("base") + before).cast("bigint").alias(name)
    )


def pack_greedy(
    df: DataFrame,
    size: int,
    order: str = "pair_id",
    by: str = "lang_pair",
    tokens: Column | None = None,
    carry: DataFrame | None = None,
    **tuning: int,
) -> DataFrame:
    """Add ``shard_idx``: pairs fill a shard in order until it holds ``size`` tokens."""
    tokens = F.col("n_src") + F.col("n_tgt") if tokens is None else tokens
    rows = materialise(
        df.select(
            F.col(by).alias("grp"),
            F.col(order).cast("bigint").alias("ord"),
            tokens.cast("bigint").alias("tok"),
        ),
        "pack-rows",
    )
    bounds, width = greedy_bounds(rows, size, carry, **tuning)
    return shard_of(df, order, F.col(by), bounds, width)


def pack_batched(
    df: DataFrame,
    size: int,
    batch_rows: int = 1000,
    order: str = "pair_id",
    by: str = "lang_pair",
    **tuning: int,
) -> DataFrame:
    """As ``pack_greedy``, but a shard is closed only after a whole input batch.

    ``order`` numbers the input pairs, kept or not, so a batch holds
    ``batch_rows`` of them; only kept pairs are in ``df`` and count tokens.
    """
    batch = int_div(F.col(order), batch_rows)
    batched = df.withColumn("_batch", batch)
    rows = materialise(
        batched.groupBy(F.col(by).alias("grp"), F.col("_batch").alias("ord")).agg(
            F.sum(F.col("n_src") + F.col("n_tgt")).cast("bigint").alias("tok")
        ),
        "pack-rows",
    )
    bounds, width = greedy_bounds(rows, size, **tuning)
    return shard_of(batched, "_batch", F.col(by), bounds, width).drop("_batch")


def split_name(shard: str = "shard_idx") -> Column:
    """The first shard of a language pair validates, the others train."""
    return F.when(F.col(shard) == 0, "val").otherwise("train")
