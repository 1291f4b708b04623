"""Corpus manifests and members of zip archives.

An archive is read by byte ranges: its end and central directory give a row for each
member, and members are spread over the tasks, each of which inflates its own range as a
stream. So one archive is read by many tasks, and none holds more than a block of it.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.session import materialise
from pairloom.sources.lines import base_name
from pairloom.sources.ranges import create_file, open_file

_MANIFEST = "corpora array<struct<url:string>>"
_ROWS_PER_BATCH = 10_000
_BLOCK = 1 << 20
_CHARS_PER_BATCH = 4 << 20
MEMBERS = "path string, member string, offset bigint, method int, crc32 bigint, packed_size bigint, size bigint"
LINES = "path string, member string, line_no bigint, line string"

# Fixed values of the format: signatures, and what says "look in the 64-bit field".
_LOCAL, _ENTRY, _END = b"PK\x03\x04", b"PK\x01\x02", b"PK\x05\x06"
_END64, _LOCATOR64 = b"PK\x06\x06", b"PK\x06\x07"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF
_STORED, _DEFLATED = 0, 8
_ENCRYPTED, _UTF8_NAME = 1, 1 << 11


def archive_kind(name: Column) -> Column:
    return (
        F.when(F.endswith(name, F.lit(".xml.gz")), "gzip")
        .when(F.endswith(name, F.lit(".zip")), "zip")
        .otherwise("none")
    )


def manifest_files(manifests: DataFrame, column: str = "manifest") -> DataFrame:
    """Files named by corpus manifests (``{"corpora": [{"url": ...}, ...]}``)."""
    others = [c for c in manifests.columns if c != column]
    name = base_name(F.col("url"))
    return (
        manifests.select(*others, F.explode(F.from_json(column, _MANIFEST)["corpora"]).alias("c"))
        .select(*others, F.col("c.url").alias("url"))
        .select(*others, "url", name.alias("file_name"), archive_kind(name).alias("kind"))
    )


def _read_at(source, offset: int, size: int, path: str) -> bytes:
    source.seek(offset)
    data = source.read(size)
    if len(data) < size:
        raise ValueError(f"archive is cut short: {path}")
    return data


def _directory_place(source, length: int, path: str) -> tuple[int, int, int]:
    """``(entries, offset, shift)`` of the central directory.

    ``shift`` is the number of bytes before the archive proper, as in a file that
    unpacks itself.
    """
    start = max(0, length - 22 - _FULL16)
    tail = _read_at(source, start, length - start, path)
    at = tail.rfind(_END)
    # the signature may also stand in the comment behind it
    while at >= 0 and (len(tail) < at + 22 or at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail)):
        at = tail.rfind(_END, 0, at)
    if at < 0:
        raise ValueError(f"no zip archive: {path}")
    entries, size, offset = struct.unpack_from("<HII", tail, at + 10)
    end = start + at
    if entries == _FULL16 or _FULL32 in (size, offset):
        locator = _read_at(source, end - 20, 20, path) if end >= 20 else b""
        if locator[:4] == _LOCATOR64:
            place = struct.unpack_from("<Q", locator, 8)[0]
            record = _read_at(source, place, 56, path)
            if record[:4] != _END64:
                # bytes stand before the archive: the record is right before its locator
                place = end - 20 - 56
                record = _read_at(source, place, 56, path)
            if record[:4] != _END64:
                raise ValueError(f"no end of a 64-bit archive: {path}")
            entries, size, offset = struct.unpack_from("<QQQ", record, 32)
            end = place
    return entries, offset, end - size - offset


def _entries(source, length: int, path: str) -> Iterator[tuple]:
    """Rows of ``MEMBERS`` without the path, read from the directory in blocks."""
    count, offset, shift = _directory_place(source, length, path)
    source.seek(offset + shift)
    held = b""

    def take(n: int) -> bytes:
        nonlocal held
        while len(held) < n:
            more = source.read(max(_BLOCK, n - len(held)))
            if not more:
                raise ValueError(f"archive is cut short: {path}")
            held += more
        out, held = held[:n], held[n:]
        return out

    for _ in range(count):
        fixed = take(46)
        if fixed[:4] != _ENTRY:
            raise ValueError(f"no entry of a directory: {path}")
        flags, method = struct.unpack_from("<HH", fixed, 8)
        crc, packed, size, n_name, n_extra, n_comment = struct.unpack_from("<IIIHHH", fixed, 16)
        place = struct.unpack_from("<I", fixed, 42)[0]
        name, extra, _ = take(n_name), take(n_extra), take(n_comment)
        at = 0
        while at + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, at)
            if kind == 1:  # 64-bit values of the fields that are full, in this order
                values = iter(struct.unpack_from(f"<{n // 8}Q", extra, at + 4))
                size = next(values) if size == _FULL32 else size
                packed = next(values) if packed == _FULL32 else packed
                place = next(values) if place == _FULL32 else place
            at += 4 + n
        member = name.decode("utf-8" if flags & _UTF8_NAME else "cp437")
        if not member.endswith("/"):
            if flags & _ENCRYPTED or method not in (_STORED, _DEFLATED):
                raise ValueError(f"member {member} of {path} is encrypted or of method {method}")
            yield member, place + shift, method, crc, packed, size


def zip_members(archives: DataFrame) -> DataFrame:
    """``MEMBERS`` of zip archives (``path, length``, as the ``binaryFile`` source lists them).

    Only the ends and directories of the archives are read. Folders are no members.
    """

    def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
        names = [field.split()[0] for field in MEMBERS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for path, length in zip(*(c.to_pylist() for c in batch.columns)):
                with open_file(path) as source:
                    for entry in _entries(source, length, path):
                        rows.append((path, *entry))
                        if len(rows) == _ROWS_PER_BATCH:
                            yield rows_batch(rows)
                            rows = []
        if rows:
            yield rows_batch(rows)

    return archives.select("path", F.col("length").cast("bigint")).mapInArrow(read, MEMBERS)


class MemberStream(io.RawIOBase):
    """The bytes of one member, inflated block by block and checked at their end."""

    def __init__(self, source, row: dict):
        self.source, self.row = source, row
        header = _read_at(source, row["offset"], 30, row["path"])
        if header[:4] != _LOCAL:
            raise ValueError(f"no member {row['member']} in {row['path']}")
        n_name, n_extra = struct.unpack_from("<HH", header, 26)
        source.seek(row["offset"] + 30 + n_name + n_extra)
        self.left, self.size, self.crc, self.ready = row["packed_size"], 0, 0, b""
        self.inflate = zlib.decompressobj(-15) if row["method"] == _DEFLATED else None

    def readable(self) -> bool:
        return True

    def _next(self) -> bytes:
        """More bytes, or none at the end."""
        while True:
            if self.inflate is not None and self.inflate.unconsumed_tail:
                data = self.inflate.decompress(self.inflate.unconsumed_tail, _BLOCK)
            elif self.left:
                packed = self.source.read(min(_BLOCK, self.left))
                if not packed:
                    raise ValueError(f"archive is cut short: {self.row['path']}")
                self.left -= len(packed)
                data = packed if self.inflate is None else self.inflate.decompress(packed, _BLOCK)
            elif self.inflate is not None:
                data, self.inflate = self.inflate.flush(), None
            else:
                return b""
            if data:
                return data

    def readinto(self, buffer) -> int:
        if not self.ready:
            self.ready = self._next()
            self.crc, self.size = zlib.crc32(self.ready, self.crc), self.size + len(self.ready)
            if not self.ready and (self.crc, self.size) != (self.row["crc32"], self.row["size"]):
                raise ValueError(f"member {self.row['member']} of {self.row['path']} is damaged")
        n = min(len(buffer), len(self.ready))
        buffer[:n], self.ready = self.ready[:n], self.ready[n:]
        return n


def member_lines(members: DataFrame) -> DataFrame:
    """``LINES``: the numbered lines of the members, which are dealt out to the tasks one by one.

    A member is one stream, so a very large one is one task, which holds a block and a
    batch of lines of it. A damaged member ends the job.
    """

    def lines_batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.string(), pa.int64(), pa.string()]
        names = [field.split()[0] for field in LINES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        chars = 0
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["path"]) as source:
                    raw = io.BufferedReader(MemberStream(source, row), _BLOCK)
                    for line_no, line in enumerate(io.TextIOWrapper(raw, encoding="utf-8")):
                        rows.append((row["path"], row["member"], line_no, line.removesuffix("\n")))
                        chars += len(line)
                        if len(rows) == _ROWS_PER_BATCH or chars > _CHARS_PER_BATCH:
                            yield lines_batch(rows)
                            rows, chars = [], 0
        if rows:
            yield lines_batch(rows)

    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = members.repartition(parts, F.xxhash64("path", "offset"))
    return dealt.mapInArrow(read, LINES)


def zip_lines(archives: DataFrame) -> DataFrame:
    """Numbered lines of all members of zip archives (``path, length``).

    Gzip files need no operator: the text source reads them.
    """
    return member_lines(materialise(zip_members(archives), "members"))


def write_archives(members: DataFrame, folder: str) -> None:
    """Write ``archive, member, content`` (text) as zip files ``<archive>-<task>.zip``.

    Members are ranged by archive and name, so that a large archive is cut into several
    files. A file has its own name when it is whole.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, finish = None, None, None
        for batch in batches:
            for archive, member, content, task in zip(*(c.to_pylist() for c in batch.columns)):
                if archive != name:
                    if out is not None:
                        out.close()
                        finish()
                    stream, finish = create_file(f"{folder}/{archive}-{task:06d}.zip")
                    name, out = archive, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
                out.writestr(member, content or "")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])
        if out is not None:
            out.close()
            finish()

    ranged = (
        members.select("archive", "member", "content").repartitionByRange("archive", "member")
        .sortWithinPartitions("archive", "member").withColumn("task", F.spark_partition_id())
    )
    ranged.mapInArrow(write, "n bigint").agg(F.sum("n")).collect()
