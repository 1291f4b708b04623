"""Running totals in a global order, without a single-partition window.

Rows are cut into blocks of the order key. Block totals are aggregated before
the shuffle and written; their running totals come from two levels of windows, over
groups of blocks and inside each group. Only the rows of one block meet in one task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.session import join_null_safe, materialise

BLOCK_WIDTH = 1 << 16
BLOCKS_PER_GROUP = 1 << 12
ROW_ID_BITS = 33  # fixed value: place of a row in its partition

_AGGREGATE = {"sum": F.sum, "min": F.min, "max": F.max}


def int_div(column: Column, divisor: int) -> Column:
    """Whole-number division, exact beyond 2**53."""
    return F.call_function("div", column, F.lit(divisor))


def _combine(op: str, left: Column, right: Column) -> Column:
    if op == "sum":
        return F.coalesce(left, F.lit(0)) + F.coalesce(right, F.lit(0))
    return F.least(left, right) if op == "min" else F.greatest(left, right)


def ordered_prefix(
    df: DataFrame,
    order: str | Sequence[str],
    values: Mapping[str, tuple[str, Column]],
    by: Sequence[str] = (),
    block: Column | None = None,
    inclusive: bool = True,
) -> DataFrame:
    """Add running aggregates of ``values`` in ``order`` within ``by``.

    ``values`` maps an output name to ``(op, column)``, with op ``sum``,
    ``min`` or ``max``. ``block`` must not fall while the order rises; by
    default it is the (single, BIGINT) order key divided by ``BLOCK_WIDTH``, so
    that unique keys put at most that many rows into one block. With
    ``inclusive=False`` the row itself is left out.
    """
    order = [order] if isinstance(order, str) else list(order)
    by = list(by)
    if block is None:
        block = int_div(F.col(order[0]), BLOCK_WIDTH)
    inputs = {name: f"_in_{name}" for name in values}
    rows = df.select(
        "*",
        block.cast("bigint").alias("_block"),
        *[column.alias(inputs[name]) for name, (_, column) in values.items()],
    )

    def totals(table: DataFrame, keys: Sequence[str]) -> DataFrame:
        return table.groupBy(*by, *keys).agg(
            *[_AGGREGATE[op](inputs[name]).alias(inputs[name]) for name, (op, _) in values.items()]
        )

    def before(table: DataFrame, keys: Sequence[str], at: str, prefix: str) -> DataFrame:
        parts = [*by, *keys] or [F.lit(0)]
        frame = Window.partitionBy(*parts).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
        return table.select(
            "*",
            *[
                _AGGREGATE[op](inputs[name]).over(frame).alias(f"{prefix}{name}")
                for name, (op, _) in values.items()
            ],
        )

    per_block = materialise(totals(rows, ["_block"]), "block-totals")
    grouped = per_block.withColumn("_group", int_div(F.col("_block"), BLOCKS_PER_GROUP))
    per_group = before(totals(grouped, ["_group"]), [], "_group", "_g_").drop(*inputs.values())
    in_group = before(grouped, ["_group"], "_block", "_b_").drop(*inputs.values())
    offsets = join_null_safe(in_group, per_group, [*by, "_group"]).select(
        *by,
        "_block",
        *[
            _combine(op, F.col(f"_g_{name}"), F.col(f"_b_{name}")).alias(inputs[name])
            for name, (op, _) in values.items()
        ],
    )
    # the offset of a block comes before its rows in the same window: the rows move once
    frame = (
        Window.partitionBy(*by, "_block")
        .orderBy("_row", *order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow if inclusive else -1)
    )
    both = rows.withColumn("_row", F.lit(1)).unionByName(
        offsets.withColumn("_row", F.lit(0)), allowMissingColumns=True
    )

    def running(name: str, op: str) -> Column:
        value = _AGGREGATE[op](inputs[name]).over(frame)
        return F.coalesce(value, F.lit(0)) if op == "sum" else value

    placed = both.select(
        *df.columns, "_row", *[running(name, op).alias(f"_out_{name}") for name, (op, _) in values.items()]
    )
    return placed.where(F.col("_row") == 1).select(
        *df.columns, *[F.col(f"_out_{name}").alias(name) for name in values]
    )


def row_positions(
    df: DataFrame,
    order: str | Sequence[str],
    name: str = "position",
    by: Sequence[str] = (),
    block: Column | None = None,
) -> DataFrame:
    """Add the position of each row, from 0, in ``order`` within ``by``."""
    return ordered_prefix(
        df, order, {name: ("sum", F.lit(1).cast("bigint"))}, by, block, inclusive=False
    )


def number_rows(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Dense row numbers from 0 in the order of the unique ``keys``, of any types.

    The rows are range partitioned and sorted (a hot leading key is split by the
    keys after it), and written with their place in the range, because sampled
    ranges may differ when a lost partition is computed again. The rows move
    once; the offsets of the ranges, one row each, join them afterwards.
    """
    ranged = materialise(
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_place", F.monotonically_increasing_id()),
        "ranges",
    )
    # a row id is the number of its partition, then the place in it
    ranged = ranged.withColumn("_range", F.shiftright("_place", ROW_ID_BITS))
    counts = ranged.groupBy("_range").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    offsets = materialise(
        ordered_prefix(counts, "_range", {"_start": ("sum", F.col("_rows"))}, inclusive=False),
        "range-offsets",
    )
    return ranged.join(offsets, "_range").select(
        *df.columns, (F.col("_start") + F.col("_place") - F.col("_first")).alias(name)
    )
