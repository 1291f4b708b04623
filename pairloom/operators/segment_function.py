"""Sequences of token streams as a table function, for SQL.

    spark.udtf.register("segment_tokens", SegmentTokens)
    SELECT * FROM segment_tokens(TABLE(runs), marker => 1, marker_at => 'first')

The table has runs (``pos, tokens`` and the keys of their stream). All other columns are
keys: the function asks for rows partitioned by them and ordered by ``pos``, and gives the keys,
``seq_id`` and ``tokens``. It holds one sequence at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import types as T
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf


class _Segments:
    def __init__(self):
        self.keys: tuple | None = None
        self.number = -1  # of the open sequence
        self.tokens: list[int] | None = None
        self.at_first = True

    @staticmethod
    def analyze(
        runs: AnalyzeArgument,
        marker: AnalyzeArgument,
        marker_at: AnalyzeArgument | None = None,
        max_len: AnalyzeArgument | None = None,
    ) -> AnalyzeResult:
        if not runs.isTable or not {"pos", "tokens"} <= set(runs.dataType.names):
            raise ValueError("the first argument is a table with the columns pos and tokens")
        if marker_at is not None and marker_at.value not in ("first", "last"):
            raise ValueError("marker_at is 'first' or 'last'")
        keys = [f for f in runs.dataType.fields if f.name not in ("pos", "tokens")]
        kind = runs.dataType["tokens"].dataType
        return AnalyzeResult(
            schema=T.StructType([*keys, T.StructField("seq_id", T.LongType()), T.StructField("tokens", kind)]),
            partitionBy=[PartitioningColumn(f"`{f.name}`") for f in keys],
            withSinglePartition=not keys,
            orderBy=[OrderingColumn("pos")],
        )

    def _closed(self) -> tuple:
        return (*self.keys, self.number, self.tokens)

    def eval(self, runs, marker: int, marker_at: str = "first", max_len: int | None = None) -> Iterator[tuple]:
        row = runs.asDict()
        self.keys = tuple(v for k, v in row.items() if k not in ("pos", "tokens"))
        self.at_first = marker_at == "first"
        if not self.at_first and self.tokens is None:
            self.number, self.tokens = 0, []
        for token in row["tokens"] or ():
            if token == marker:
                if not self.at_first or self.tokens is not None:
                    yield self._closed()
                self.number += 1
                self.tokens = []
                if not self.at_first:
                    continue
            if self.tokens is not None and (max_len is None or len(self.tokens) < max_len):
                self.tokens.append(token)

    def terminate(self) -> Iterator[tuple]:
        # behind the last marker a sequence is open where markers come first, else it is none
        if self.at_first and self.tokens is not None:
            yield self._closed()


SegmentTokens = udtf(_Segments)
