"""Token ids in wavelet matrices: one compressed file per shard, with rank and select.

A wavelet matrix keeps one bit-plane for each bit of an id, from the highest; below
a plane the ids are split, stably, into those with a 0 and those with a 1. Access,
counting and the place of the k-th occurrence follow one path through the planes.

File: ``MAGIC``, length of the header (8 bytes, little endian), header (JSON), the
document table and the planes. A plane is cut into blocks of ``BLOCK_BITS``, each
compressed alone; the header has their places and the number of ones before each,
so a lookup opens one block a plane.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.chunk_ids import tokenizers_encoder
from pairloom.llm.sharedfs import read_file, write_file
from pairloom.llm.spans import slices
from pairloom.llm.tables import record_batch
from pairloom.operators.prefix import ordered_prefix
from pairloom.session import materialise, new_path

MAGIC = b"WAVMTX01"
BLOCK_BITS = 1 << 20
SHARD_TOKENS = 2 << 20  # a shard ends with the document that reaches this
SHARDS_PER_RANGE = 1 << 20  # more than one task writes
MANIFEST = "seq bigint, path string, n_docs bigint, n_tokens bigint"
READ = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"


def build(ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> bytes:
    """The file of one shard."""
    bits = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    squeeze = zstandard.ZstdCompressor(level=1).compress
    body: list[bytes] = []
    size = 0

    def put(data: bytes) -> list[int]:
        nonlocal size
        body.append(packed := squeeze(data))
        size += len(packed)
        return [size - len(packed), len(packed)]

    table = json.dumps({"doc_ids": doc_ids, "lengths": lengths.tolist()}).encode()
    header = {"n": len(ids), "bits": bits, "docs": put(table), "planes": []}
    if bits <= 16:
        ids = ids.astype(np.uint16)  # half the memory to move
    for level in range(bits - 1, -1, -1):
        plane = (ids & (1 << level)) != 0
        ones, blocks = 0, []
        for at in range(0, len(ids), BLOCK_BITS):
            part = plane[at : at + BLOCK_BITS]
            blocks.append([*put(np.packbits(part).tobytes()), ones])
            ones += int(np.count_nonzero(part))
        header["planes"].append({"zeros": len(ids) - ones, "blocks": blocks})
        if level:
            zeros = len(ids) - ones
            below = np.empty_like(ids)  # places are found once, then moved without a test each
            np.take(ids, np.flatnonzero(~plane), out=below[:zeros], mode="clip")
            np.take(ids, np.flatnonzero(plane), out=below[zeros:], mode="clip")
            ids = below
    head = json.dumps(header).encode()
    return b"".join([MAGIC, len(head).to_bytes(8, "little"), head, *body])


class WaveletMatrix:
    """Queries on the bytes of one file."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        at = 16 + int.from_bytes(data[8:16], "little")
        header = json.loads(data[16:at])
        self.data, self.base = data, at
        self.n, self.bits, self.planes = header["n"], header["bits"], header["planes"]
        table = json.loads(self._open(*header["docs"]))
        self.doc_ids, self.lengths = table["doc_ids"], np.array(table["lengths"], np.int64)
        self._block = lru_cache(4 * self.bits)(self._load_block)

    def _open(self, start: int, length: int) -> bytes:
        start += self.base
        return zstandard.ZstdDecompressor().decompress(self.data[start : start + length])

    def _load_block(self, plane: int, block: int) -> tuple[np.ndarray, np.ndarray]:
        start, length, ones = self.planes[plane]["blocks"][block]
        packed = np.frombuffer(self._open(start, length), np.uint8)
        counts = np.bitwise_count(packed).astype(np.int64)
        return packed, ones + np.cumsum(counts) - counts  # ones before each byte

    def _bit_rank(self, plane: int, i: int) -> tuple[int, int]:
        """Bit ``i`` of a plane and the ones before it; at the end of the plane bit 0."""
        if i >= self.n:
            return 0, self.n - self.planes[plane]["zeros"]
        packed, before = self._block(plane, i // BLOCK_BITS)
        byte, bit = divmod(i % BLOCK_BITS, 8)
        value = int(packed[byte])
        return value >> (7 - bit) & 1, int(before[byte]) + (value >> (8 - bit)).bit_count()

    def access(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        token = 0
        for p, plane in enumerate(self.planes):
            bit, ones = self._bit_rank(p, i)
            token = token << 1 | bit
            i = plane["zeros"] + ones if bit else i - ones
        return token

    def _path(self, token: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``token`` begin in the last order, and those before ``i`` end."""
        low = 0
        for p, plane in enumerate(self.planes):
            if token >> (self.bits - 1 - p) & 1:
                low = plane["zeros"] + self._bit_rank(p, low)[1]
                i = plane["zeros"] + self._bit_rank(p, i)[1]
            else:
                low -= self._bit_rank(p, low)[1]
                i -= self._bit_rank(p, i)[1]
        return low, i

    def rank(self, token: int, i: int | None = None) -> int:
        """Occurrences of ``token`` before place ``i`` (in the shard)."""
        if token >> self.bits:
            return 0
        low, high = self._path(token, self.n if i is None else i)
        return high - low

    def select(self, token: int, k: int) -> int:
        """Place of occurrence ``k`` (from 0) of ``token``."""
        if not 0 <= k < self.rank(token):
            raise IndexError(k)
        at = self._path(token, 0)[0] + k
        for p in range(self.bits - 1, -1, -1):
            zeros = self.planes[p]["zeros"]
            wanted = token >> (self.bits - 1 - p) & 1
            at = self._bit_select(p, wanted, at - zeros if wanted else at)
        return at

    def _bit_select(self, plane: int, bit: int, k: int) -> int:
        low, high = 0, self.n
        while low < high:  # last place with at most k such bits before it
            mid = (low + high + 1) // 2
            ones = self._bit_rank(plane, mid)[1]
            low, high = (mid, high) if (ones if bit else mid - ones) <= k else (low, mid - 1)
        return low

    def occurrences(self, token: int) -> list[int]:
        return [self.select(token, k) for k in range(self.rank(token))]

    def tokens(self) -> np.ndarray:
        """All ids, in order: from the last plane upwards each undoes its split."""
        low = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for p in range(self.bits - 1, -1, -1):
            plane = self.planes[p]
            bits = np.concatenate(
                [
                    np.unpackbits(
                        np.frombuffer(self._open(*block[:2]), np.uint8),
                        count=min(BLOCK_BITS, self.n - k * BLOCK_BITS),
                    )
                    for k, block in enumerate(plane["blocks"])
                ]
                or [np.zeros(0, np.uint8)]
            )
            ones = bits.view(bool)
            above = np.empty_like(low)
            above[np.flatnonzero(~ones)] = low[: plane["zeros"]]
            above[np.flatnonzero(ones)] = low[plane["zeros"] :] | low.dtype.type(1 << (self.bits - 1 - p))
            low = above
        return low


def write_shards(
    docs: DataFrame,
    tokenizer: str,
    end_id: int,
    folder: str,
    doc_id: str = "doc_id",
    text: str = "text",
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Write the ids of all texts in ascending order of ``doc_id``; return the manifest.

    A null text is empty; every document ends with ``end_id``. Null keys come first,
    equal keys in the order of the digests of their texts. The table is range partitioned by
    key and digest, so only a range's own rows meet in one task. Manifest: ``seq`` (order of shards),
    ``path``, ``n_docs``, ``n_tokens``, ``start`` (ids in all shards before).
    """
    encode = tokenizers_encoder(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, keys, lengths, parts, held = 0, [], [], [], 0
        task = 0

        def close() -> pa.RecordBatch:
            seq = task * SHARDS_PER_RANGE + shard
            path = f"{folder}/shard-{task:08d}-{shard:07d}.wm"
            flat = np.concatenate(parts)
            write_file(path, build(flat, keys, np.concatenate(lengths)))
            row = {"seq": [seq], "path": [path], "n_docs": [len(keys)], "n_tokens": [len(flat)]}
            return record_batch(MANIFEST, row)

        for batch in batches:
            for at, texts in slices(batch.column(0)):
                task = batch.column(2)[0].as_py()
                own = batch.column(1).slice(at, len(texts)).to_pylist()
                ids, bounds = encode(texts)
                flat = np.full(len(ids) + len(own), end_id, np.int32)
                ends = bounds[1:] + np.arange(1, len(own) + 1)
                is_id = np.ones(len(flat), bool)
                is_id[ends - 1] = False
                flat[is_id] = ids
                starts = np.concatenate([[0], ends[:-1]])
                first = 0
                while first < len(own):
                    to = int(np.searchsorted(ends, starts[first] + shard_tokens - held)) + 1
                    to = min(to, len(own))
                    parts.append(flat[starts[first] : ends[to - 1]])
                    lengths.append(ends[first:to] - starts[first:to])
                    keys.extend(own[first:to])
                    held += len(parts[-1])
                    if held >= shard_tokens:
                        yield close()
                        shard, keys, lengths, parts, held = shard + 1, [], [], [], 0
                    first = to
        if keys:
            yield close()

    ranged = (
        docs.select(F.col(text).alias("text"), F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("digest"))
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), "digest")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "digest")
        .select("text", "doc_id", F.spark_partition_id().cast("bigint").alias("task"))
    )
    manifest = materialise(ranged.mapInArrow(run, MANIFEST), "token-manifest")
    return ordered_prefix(
        manifest, "seq", {"start": ("sum", F.col("n_tokens"))}, inclusive=False
    )


def read_shards(manifest: DataFrame) -> DataFrame:
    """Per document, from the files: ``start``, ``n_tokens`` and the crc32 of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                matrix = WaveletMatrix(read_file(path))
                raw = matrix.tokens().astype("<u4").tobytes()
                ends = np.cumsum(matrix.lengths)
                starts = ends - matrix.lengths
                view = memoryview(raw)
                yield record_batch(
                    READ,
                    {
                        "doc_id": matrix.doc_ids,
                        "start": starts + start,
                        "n_tokens": matrix.lengths,
                        "ids_crc32": [
                            zlib.crc32(view[4 * a : 4 * b])
                            for a, b in zip(starts.tolist(), ends.tolist())
                        ],
                    },
                )

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(parts, "path").mapInArrow(run, READ)


def token_files(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents into wavelet matrices in the shared folder and read them back."""
    folder = new_path(docs.sparkSession, "token-files")
    return read_shards(write_shards(docs, tokenizer, end_id, folder))
