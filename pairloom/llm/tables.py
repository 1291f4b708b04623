"""Reading of input tables and running of Arrow functions over whole texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from pairloom.llm.spans import slices


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a variant that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def map_texts(
    df: DataFrame,
    inputs: Sequence,
    schema: str,
    fn: Callable[[pa.Array, list[pa.Array]], dict[str, object]],
) -> DataFrame:
    """Run ``fn(texts, others)`` on slices of whole texts; it returns columns of ``schema``.

    ``inputs`` are columns, the text first. Only these reach Python, and a column that
    is named twice reaches it once.
    """
    out = to_arrow_schema(T.StructType.fromDDL(schema))  # any types: callers pass columns through
    sent, place = [], []
    for c in inputs:
        known = [i for i, x in enumerate(sent) if isinstance(c, str) and isinstance(x, str) and x == c]
        place.append(known[0] if known else len(sent))
        if not known:
            sent.append(c)
    columns = [
        (F.col(c) if isinstance(c, str) else c).alias(f"c{i}") for i, c in enumerate(sent)
    ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(0)):
                others = [batch.column(i).slice(at, len(texts)) for i in place[1:]]
                found = fn(texts, others)
                yield pa.RecordBatch.from_arrays(
                    [as_arrow(found[f.name], f.type) for f in out], schema=out
                )

    return df.select(*columns).mapInArrow(run, schema)


HOT_SHARE = 1024  # a key with more than this part of all the weight is hot; fewer than so many can be


def join_weighted(rows: DataFrame, table: DataFrame, keys: Sequence[str], weight: str) -> DataFrame:
    """Inner join of written ``rows`` with ``table`` (unique, non-null ``keys``), no key in one task.

    ``weight`` says about how many rows a key has. Keys with more than a ``HOT_SHARE``-th
    of all weight, fewer than ``HOT_SHARE`` of them, are broadcast, so that their rows
    stay where they are; the others move by key.
    """
    total = table.agg(F.sum(weight)).first()[0] or 0
    is_hot = F.col(weight) * HOT_SHARE > F.lit(total)
    hot, cold = table.where(is_hot), table.where(~is_hot)
    at_rest = rows.join(F.broadcast(hot), list(keys))
    moved = rows.join(F.broadcast(hot.select(*keys)), list(keys), "left_anti")
    return at_rest.unionByName(moved.join(cold.hint("merge"), list(keys)))


def as_arrow(values, kind: pa.DataType) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        values = values.combine_chunks()
    if isinstance(values, pa.Array):
        return values if values.type == kind else values.cast(kind)
    return pa.array(values, kind)


_KINDS = {
    "bigint": pa.int64(),
    "int": pa.int32(),
    "double": pa.float64(),
    "string": pa.string(),
    "boolean": pa.bool_(),
    "binary": pa.binary(),
    "array<bigint>": pa.list_(pa.int64()),
    "array<int>": pa.list_(pa.int32()),
    "array<double>": pa.list_(pa.float64()),
}


def _arrow_schema(schema: str) -> pa.Schema:
    """Arrow types of a schema of simple types, as ``name type, …``."""
    fields = [x.split() for x in schema.split(",")]
    return pa.schema([(name, _KINDS[kind]) for name, kind in fields])


def record_batch(schema: str, columns: dict[str, object]) -> pa.RecordBatch:
    out = _arrow_schema(schema)
    return pa.RecordBatch.from_arrays(
        [as_arrow(columns[f.name], f.type) for f in out], schema=out
    )
