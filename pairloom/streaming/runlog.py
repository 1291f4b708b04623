"""Following a run log while it grows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pairloom.sources import runlog

STATE_SCHEMA = "best double"


def follow(lines: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Write the validation rows of a stream of log lines (``value``) to ``out``
    with the best loss before each, as ``runlog.best_so_far`` gives them.

    Lines arrive in the order of their steps. The best loss is carried from one
    micro-batch to the next under the number of the batch.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        before = _best(spark, out, epoch - 1)
        rows = runlog.best_so_far(runlog.parse(batch, "value"), before)
        target = f"{out}/rows/epoch={epoch}"
        rows.write.mode("overwrite").parquet(target)
        (
            spark.read.schema(rows.schema)
            .parquet(target)
            .agg(F.least(F.min("loss"), F.lit(before).cast("double")).alias("best"))
            .write.mode("overwrite")
            .parquet(f"{out}/state/epoch={epoch}")
        )

    return (
        lines.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _best(spark: SparkSession, out: str, epoch: int) -> float | None:
    if epoch < 0:
        return None
    state = spark.read.schema(STATE_SCHEMA).parquet(f"{out}/state/epoch={epoch}").first()
    return state["best"] if state else None
