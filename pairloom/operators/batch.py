"""Batches of sequences: order, padding, masks, shifted targets, step plan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import arrays
from pairloom.operators.prefix import int_div, row_positions

TOKENS_PER_STEP = 524_288
HASH_DIGITS = 15
MIN_HASH_BITS = 6


def shuffled_positions(
    df: DataFrame,
    key: str,
    seed: int,
    epoch: int,
    name: str = "position",
    by: Sequence[str] = (),
) -> DataFrame:
    """Position of each row in a shuffled order fixed by seed, epoch and ``key``,
    within ``by``.

    The order is that of ``md5("seed:epoch:key")``, the same on any
    partitioning. The leading hash digits cut it into blocks of even size.
    """
    bits = max(MIN_HASH_BITS, (df.count() >> 16).bit_length())
    hashed = df.withColumn(
        "_hash", F.md5(F.concat(F.lit(f"{seed}:{epoch}:"), F.col(key).cast("string")))
    )
    leading = F.conv(F.substring("_hash", 1, HASH_DIGITS), 16, 10).cast("bigint")
    block = F.shiftright(leading, 4 * HASH_DIGITS - bits)
    return row_positions(hashed, ["_hash", key], name, by, block).drop("_hash")


def assign_batches(seqs: DataFrame, batch_size: int, position: str = "position") -> DataFrame:
    """Consecutive positions form a batch; the last one may be shorter."""
    return seqs.select(
        "*",
        int_div(F.col(position), batch_size).alias("batch_id"),
        F.pmod(F.col(position), F.lit(batch_size)).alias("row_in_batch"),
    )


def batch_widths(batched: DataFrame, keys: Sequence[str] = ("batch_id",)) -> DataFrame:
    """Add ``src_width`` and ``tgt_width``, the largest ``src_lengths`` and ``tgt_lengths`` of the batch.

    ``keys`` tell the batches apart. The rows need not have their tokens yet.
    """
    batch = Window.partitionBy(*keys)
    return batched.withColumns(
        {f"{side}_width": F.max(f"{side}_lengths").over(batch) for side in ("src", "tgt")}
    )


def pad_to_width(batched: DataFrame, pad: int = 0) -> DataFrame:
    """Pad each side with ``pad`` to the width of its batch, which goes."""
    return batched.withColumns(
        {
            "source": arrays.pad_right(F.col("source"), F.col("src_width"), pad),
            "target": arrays.pad_right(F.col("target"), F.col("tgt_width"), pad),
        }
    ).drop("src_width", "tgt_width")


def pad_batches(
    batched: DataFrame, pad: int = 0, keys: Sequence[str] = ("batch_id",)
) -> DataFrame:
    """Pad each side with ``pad`` to the longest sequence of the batch, and add
    the lengths before padding (``src_lengths``, ``tgt_lengths``). ``keys``
    tell the batches apart."""
    lengths = {"src_lengths": F.size("source"), "tgt_lengths": F.size("target")}
    return pad_to_width(batch_widths(batched.withColumns(lengths), keys), pad)


def collate(
    batched: DataFrame,
    pad: int = 0,
    mask_from: str = "value",
    shifted_masks: bool = False,
    keys: Sequence[str] = ("batch_id",),
) -> DataFrame:
    """The training columns of each row of a padded batch.

    ``mask_from="length"`` masks by position, for vocabularies in which the pad
    id is a real token. The target masks cover the full target, one longer than
    its shifted forms; ``shifted_masks`` adds masks of that length. Rows that have the
    widths of their batches (``batch_widths``) are padded without a shuffle.
    """
    known = "src_width" in batched.columns
    padded = pad_to_width(batched, pad) if known else pad_batches(batched, pad, keys)

    def masks(side: str, ids: str) -> dict[str, Column]:
        if mask_from == "length":
            attend = arrays.attention_mask_of_length(F.col(ids), F.col(f"{side}_lengths"))
            return {
                f"{side}_padding_mask": F.transform(attend, lambda a: a == 0),
                f"{side}_attn_mask": attend,
            }
        return {
            f"{side}_padding_mask": arrays.padding_mask(F.col(ids), pad),
            f"{side}_attn_mask": arrays.attention_mask(F.col(ids), pad),
        }

    out = padded.withColumns({**masks("src", "source"), **masks("tgt", "target")}).withColumns(
        {
            "target_input": arrays.shift_input(F.col("target")),
            "target_output": arrays.shift_output(F.col("target")),
        }
    )
    if shifted_masks:
        out = out.withColumns(
            {
                "input_attn_mask": arrays.shift_input(F.col("tgt_attn_mask")),
                "output_attn_mask": arrays.shift_output(F.col("tgt_attn_mask")),
            }
        )
    return out.drop("target")


def labels(collated: DataFrame, split: Column) -> DataFrame:
    """Training uses the shifted input as labels, other splits the shifted output."""
    return collated.withColumn(
        "labels",
        F.when(split == "train", F.col("target_input")).otherwise(F.col("target_output")),
    )


def add_prompt(collated: DataFrame, prompt_ids: list[int]) -> DataFrame:
    """Put the instruction before the source; its masks and length grow with it."""
    n = len(prompt_ids)
    ids = F.array(*[F.lit(i) for i in prompt_ids])
    before = {
        "source": ids,
        "src_attn_mask": F.array_repeat(F.lit(1.0).cast("float"), n),
        "src_padding_mask": F.array_repeat(F.lit(False), n),
    }
    grown = {c: F.concat(new, F.col(c)) for c, new in before.items() if c in collated.columns}
    if "src_lengths" in collated.columns:
        grown["src_lengths"] = F.col("src_lengths") + n
    return collated.withColumns(grown)


def accumulation_steps(
    batch_size: int, max_len: int, ranks: int, tokens_per_step: int = TOKENS_PER_STEP
) -> int:
    """Micro batches in one optimiser step; the step size must be a multiple."""
    micro = batch_size * max_len * ranks
    if tokens_per_step % micro:
        raise ValueError(f"{tokens_per_step} tokens per step are no multiple of {micro}")
    return tokens_per_step // micro


def step_plan(batched: DataFrame, accumulation: int) -> DataFrame:
    """Optimiser step of each batch (``batch_id``), and the place of the batch in it."""
    return batched.select(
        "*",
        int_div(F.col("batch_id"), accumulation).alias("step"),
        F.pmod(F.col("batch_id"), F.lit(accumulation)).alias("micro_step"),
    )
