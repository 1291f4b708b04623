"""The text log of a training run and what is read from it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairloom.operators.prefix import int_div, ordered_prefix
from pairloom.session import join_null_safe, materialise

LOG_LINE = r"^(\d+) (val|train) (\S+)$"

# Fixed values of the trainer.
EVALUATE_EVERY = 225
SAVE_EVERY = 2000
EVALUATION_BATCHES = 20


def checked(lines: DataFrame, column: str = "line") -> DataFrame:
    """``step, split, loss`` of all lines with the ``reason`` why one is no entry, else null.

    The line itself stays in ``line``; other columns are kept.
    """
    line = F.col(column)
    others = [c for c in lines.columns if c != column]
    part = [F.regexp_extract(line, LOG_LINE, i) for i in (1, 2, 3)]
    step, loss = part[0].try_cast("bigint"), part[2].try_cast("double")
    is_entry = F.regexp_like(line, F.lit(LOG_LINE))
    return lines.select(
        *others,
        line.alias("line"),
        F.when(is_entry, step).alias("step"),
        F.when(is_entry, part[1]).alias("split"),
        F.when(is_entry, loss).alias("loss"),
        F.when(line.isNull(), "no line")
        .when(~is_entry, "no entry")
        .when(step.isNull(), "step out of range")
        .when(loss.isNull(), "loss is no number")
        .alias("reason"),
    )


def parse(lines: DataFrame, column: str = "line") -> DataFrame:
    """``step, split, loss`` of the entries; ``rejects`` has the other lines."""
    return checked(lines, column).where(F.col("reason").isNull()).drop("line", "reason")


def rejects(lines: DataFrame, column: str = "line") -> DataFrame:
    """Lines that are no entries, with the reason."""
    return checked(lines, column).where(F.col("reason").isNotNull()).drop("step", "split", "loss")


def best_so_far(
    runlog: DataFrame, best_before: float | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Validation rows with the best loss before them and whether they beat it.

    The first row always does; an equal loss does not. ``by`` tells runs apart; of the rows
    of one step the smaller loss comes first.
    """
    before = ordered_prefix(
        runlog.where(F.col("split") == "val"),
        ["step", "loss"],
        {"best_before": ("min", F.col("loss"))},
        by=by,
        inclusive=False,
    )
    if best_before is not None:
        before = before.withColumn("best_before", F.least("best_before", F.lit(best_before)))
    return before.withColumn(
        "is_best", F.col("best_before").isNull() | (F.col("loss") < F.col("best_before"))
    )


def best_step(runlog: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The validation row with the smallest loss, of each run; the first of equals."""
    key = F.struct("loss", "step")
    return runlog.where(F.col("split") == "val").groupBy(*by).agg(
        F.min_by("step", key).alias("step"), F.min("loss").alias("loss")
    )


def mean_loss(
    runlog: DataFrame, steps_per_epoch: int, batches: int | None = None, by: Sequence[str] = ()
) -> DataFrame:
    """Mean loss by run, epoch and split, each batch with the same weight.

    ``batches`` takes only the first ones of each group, which holds no more
    than the steps of one epoch.
    """
    rows = runlog.withColumn("epoch", int_div(F.col("step"), steps_per_epoch))
    keys = [*by, "epoch", "split"]
    if batches is not None:
        order = Window.partitionBy(*keys).orderBy("step", "loss")
        rows = rows.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= batches)
    return rows.groupBy(*keys).agg(
        F.avg("loss").alias("mean_loss"), F.count(F.lit(1)).alias("batches")
    )


def events(runlog: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Which steps evaluate and which save a checkpoint (the last one of a run always saves)."""
    by = list(by)
    one = F.lit(0).alias("_one")  # stands for a log of one run
    last = materialise(runlog.groupBy(*by).agg(F.max("step").alias("_last")).select("*", one), "last-steps")
    rows = join_null_safe(runlog.select("*", one), last, [*by, "_one"])
    step = F.col("step")
    return rows.select(
        *runlog.columns,
        (step % EVALUATE_EVERY == 0).alias("evaluates"),
        (
            ((step % EVALUATE_EVERY == 0) & (step > 0) & (step % SAVE_EVERY == 0))
            | (step == F.col("_last"))
        ).alias("saves"),
    )


def throughput(
    steps: DataFrame, batch_size: int, max_len: int, accumulation: int, ranks: int
) -> DataFrame:
    """Tokens per second of each step from its seconds ``dt``."""
    tokens = batch_size * max_len * accumulation * ranks
    return steps.select(
        "*",
        F.lit(tokens).cast("bigint").alias("tokens"),
        (F.lit(float(tokens)) / F.nullif(F.col("dt"), F.lit(0.0))).alias("tokens_per_sec"),
    )
