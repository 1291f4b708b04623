"""Bounded-space online best-fit packing of token pieces into sequences.

Each task packs its documents slice by slice, in a slice the long pieces first. It holds at most ``OPEN_BINS`` open
sequences, in lists keyed by free space, with one bit for each free space that
occurs: the best fit is the lowest bit at or above the piece's length. A piece
that fits nowhere opens a sequence; when too many are open, the fullest closes.
Sequences still open at the end of a task are packed again, whole, with those of
other tasks, in groups of bounded size, so that tasks leave little room unused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.chunk_ids import tokenizers_encoder
from pairloom.llm.spans import slices
from pairloom.llm.tables import record_batch
from pairloom.session import materialise

OPEN_BINS = 1024
TASKS_PER_GROUP = 64
TASK_BITS = 32  # sequence ids: task, then number in the task
PIECES = (
    "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint,"
    "bin bigint, at bigint, task bigint, open bigint"
)
MOVED = "bin bigint, sequence_id bigint, shift bigint"


class BestFit:
    """Open bins of one packer; ``put`` returns the bin and offset of a piece."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS):
        self.capacity, self.limit = capacity, open_bins
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.bits = 0
        self.n_open = 0
        self.n_bins = 0

    def _add(self, bin_id: int, free: int) -> None:
        self.by_free[free].append(bin_id)
        self.bits |= 1 << free
        self.n_open += 1

    def _take(self, free: int) -> int:
        bin_id = self.by_free[free].pop()
        if not self.by_free[free]:
            self.bits &= ~(1 << free)
        self.n_open -= 1
        return bin_id

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_id = self._take(free)
        else:
            free, bin_id = self.capacity, self.n_bins
            self.n_bins += 1
        if free > length:
            self._add(bin_id, free - length)
            if self.n_open > self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
        return bin_id, self.capacity - free

    def still_open(self) -> dict[int, int]:
        """Used length of each open bin."""
        return {b: self.capacity - free for free, bins in enumerate(self.by_free) for b in bins}


def pieces_of(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, ...]:
    """``(document, piece, start, length)``: longer documents are cut, the first piece may be shorter."""
    counts = np.maximum(1, -(-lengths // capacity))
    doc = np.repeat(np.arange(len(lengths)), counts)
    piece = np.arange(len(doc)) - np.repeat(np.cumsum(counts) - counts, counts)
    head = lengths - (counts - 1) * capacity
    start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
    return doc, piece, start, np.where(piece == 0, head[doc], capacity)


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    capacity: int = 1024,
    open_bins: int = OPEN_BINS,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """One row per piece with its ``sequence_id`` and ``offset``.

    Null and empty texts are documents of the end id alone. Null keys and repeated
    rows are packed like others; other columns are not read. An empty table gives
    no rows. The packed pieces are written once, so that a lost executor cannot
    give a piece two places.
    """
    encode = tokenizers_encoder(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, task = BestFit(capacity, open_bins), 0
        for batch in batches:
            for at, texts in slices(batch.column(0)):
                task = batch.column(2)[0].as_py()
                ids, bounds = encode(texts)
                n = np.diff(bounds)
                flat = np.insert(ids, bounds[1:], end_id).astype("<u4").tobytes()
                begins = np.concatenate([[0], np.cumsum(n + 1)])
                doc, piece, start, length = pieces_of(n + 1, capacity)
                placed = [(0, 0)] * len(length)
                for k in np.argsort(-length, kind="stable").tolist():  # long pieces first
                    placed[k] = packer.put(int(length[k]))
                view = memoryview(flat)
                from_ = (begins[doc] + start).tolist()
                yield record_batch(
                    PIECES,
                    {
                        "doc_id": batch.column(1).slice(at, len(texts)).take(pa.array(doc)),
                        "piece": piece,
                        "start": start,
                        "length": length,
                        "ids_crc32": [
                            zlib.crc32(view[4 * a : 4 * (a + k)])
                            for a, k in zip(from_, length.tolist())
                        ],
                        "bin": [(task << TASK_BITS) + b for b, _ in placed],
                        "at": [o for _, o in placed],
                        "task": np.full(len(doc), task),
                        "open": np.full(len(doc), -1),
                    },
                )
        ids_of_open = packer.still_open()
        if ids_of_open:
            k = len(ids_of_open)
            none = pa.nulls(k, pa.int64())
            yield record_batch(
                PIECES,
                {
                    "doc_id": none,
                    "piece": none,
                    "start": none,
                    "length": none,
                    "ids_crc32": none,
                    "bin": [(task << TASK_BITS) + b for b in ids_of_open],
                    "at": none,
                    "task": np.full(k, task),
                    "open": list(ids_of_open.values()),
                },
            )

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("open", "descending"), ("bin", "ascending")])
        packer, targets, out = BestFit(capacity, open_bins), {}, []
        for bin_id, used in zip(rows["bin"].to_pylist(), rows["open"].to_pylist()):
            number, shift = packer.put(used)
            out.append((bin_id, targets.setdefault(number, bin_id), shift))
        names = ("bin", "sequence_id", "shift")
        return pa.table({k: pa.array(v, pa.int64()) for k, v in zip(names, zip(*out))})

    rows = docs.select(
        F.col(text).alias("text"),
        F.col(doc_id).alias("doc_id"),
        F.spark_partition_id().cast("bigint").alias("task"),
    ).mapInArrow(run, PIECES)
    packed = materialise(rows, "packed-pieces")
    moved = (
        packed.where(F.col("open") >= 0)
        .select("bin", "open", F.expr(f"task div {TASKS_PER_GROUP}").alias("near"))
        .groupBy("near")
        .applyInArrow(merge, MOVED)
    )
    return (
        packed.where(F.col("open") < 0)
        .join(moved, "bin", "left")
        .select(
            "doc_id",
            "piece",
            "start",
            "length",
            "ids_crc32",
            F.coalesce("sequence_id", "bin").alias("sequence_id"),
            (F.col("at") + F.coalesce("shift", F.lit(0))).alias("offset"),
        )
    )
