"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can read, as named by ``spark.checkpoint.dir``.

    A local session without the setting gets a temporary folder; a cluster
    session without it is refused, since a machine-local folder would be lost
    with its machine.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        configured = spark.conf.get("spark.checkpoint.dir", None)
        if configured is None:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            configured = tempfile.mkdtemp(prefix="pairloom-")
        sc.setCheckpointDir(configured)
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has been written to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, of which a null equals a null; the keys stay once."""
    if not keys:
        raise ValueError("no keys")
    renamed = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    same = [left[k].eqNullSafe(renamed[f"_r_{k}"]) for k in keys]
    return left.join(renamed, same, how).drop(*[f"_r_{k}" for k in keys])


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and return the written table.

    Cuts the lineage, survives the loss of executors, fixes values that depend
    on the physical partitioning, and gives the planner the real size of small
    tables, so that it alone decides whether they are broadcast.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def write_bucketed(df: DataFrame, path: str, keys: list[str]) -> None:
    """Write ``df`` at ``path`` so that rows of equal ``keys`` lie in one bucket.

    What groups the rows by ``keys``, and by more than them, reads the buckets (``read_bucketed``)
    without moving rows again.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartition(n, *keys)  # each task has one bucket and writes one file
    placed.write.bucketBy(n, *keys).option("path", path).format("parquet").saveAsTable(_table_of(path))


def read_bucketed(spark: SparkSession, path: str) -> DataFrame:
    return spark.table(_table_of(path))


def _table_of(path: str) -> str:
    return "pairloom_" + re.sub(r"\W", "_", path.rstrip("/").rsplit("/", 1)[-1])
