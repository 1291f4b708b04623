"""Zip archives read by ranges, against the standard library's writer."""

import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from pairloom.sources import archives


def listed(spark, folder):
    return spark.read.format("binaryFile").load(str(folder)).select("path", "length")


def text_lines(content: bytes) -> list[str]:
    return [x.removesuffix("\n") for x in io.TextIOWrapper(io.BytesIO(content), encoding="utf-8")]


def read(spark, folder):
    rows = archives.zip_lines(listed(spark, folder)).collect()
    found = {}
    for r in sorted(rows, key=lambda r: (r["path"], r["member"], r["line_no"])):
        found.setdefault((r["path"].rsplit("/", 1)[1], r["member"]), []).append(r["line"])
    return found


CONTENT = {
    "plain.txt": b"one\ntwo\r\nthree\rfour\n\nfive",
    "empty.txt": b"",
    "folder/é한.txt": "ä\n한국\n".encode(),
    "long.txt": b"".join(b"line %d of a long member\n" % i for i in range(60_000)),
    "wide.txt": b"x" * 3_000_000 + b"\nend",
}


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_members_of_all_kinds(spark, tmp_path, method):
    for k, comment in enumerate((b"", b"PK\x05\x06 a comment that looks like an end" + bytes(40))):
        with zipfile.ZipFile(tmp_path / f"a{k}.zip", "w", method) as archive:
            archive.comment = comment
            archive.writestr("folder/", "")
            for name, content in CONTENT.items():
                with archive.open(name, "w", force_zip64=k == 1) as member:  # 64-bit sizes too
                    member.write(content)
    found = read(spark, tmp_path)
    assert found == {
        (f"a{k}.zip", name): text_lines(content) for k in (0, 1) for name, content in CONTENT.items() if content
    }


def test_data_descriptors_and_bytes_before_the_archive(spark, tmp_path):
    class NoSeek(io.RawIOBase):
        def __init__(self):
            self.data = b""

        def writable(self):
            return True

        def write(self, data):
            self.data += bytes(data)
            return len(data)

    out = NoSeek()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("m.txt", "a\nb\n")
    (tmp_path / "self.zip").write_bytes(b"#!/bin/sh\nexit 0\n" + out.data)
    assert read(spark, tmp_path) == {("self.zip", "m.txt"): ["a", "b"]}


def test_end_of_a_64_bit_archive(spark, tmp_path):
    """The entries of the 32-bit end are full, so that the 64-bit one counts."""
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as archive:
        archive.writestr("m.txt", "a\nb\n")
    data = buffer.getvalue()
    end = data.rfind(b"PK\x05\x06")
    count, size, offset = struct.unpack_from("<HII", data, end + 10)
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, size, offset)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, end, 1)
    last = struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    for k, before in enumerate((b"", b"some bytes before")):
        (tmp_path / f"b{k}.zip").write_bytes(before + data[:end] + end64 + locator + last)
    assert read(spark, tmp_path) == {(f"b{k}.zip", "m.txt"): ["a", "b"] for k in (0, 1)}


def test_one_archive_is_read_by_many_tasks(spark, shuffle_partitions, tmp_path):
    shuffle_partitions(4)
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        for i in range(40):
            archive.writestr(f"{i}.txt", f"{i}\n")
    lines = archives.zip_lines(listed(spark, tmp_path)).withColumn("task", F.spark_partition_id())
    assert lines.select("task").distinct().count() == 4
    assert sorted(int(r["line"]) for r in lines.collect()) == list(range(40))


@pytest.mark.parametrize("damage", ["content", "cut", "none"])
def test_damaged_archives_end_the_job(spark, tmp_path, damage):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as archive:
        archive.writestr("m.txt", "some content\n" * 50)
    data = bytearray((tmp_path / "a.zip").read_bytes())
    if damage == "content":
        data[60] ^= 1
    elif damage == "cut":
        data = data[:-30]
    else:
        data = b"no archive at all"
    (tmp_path / "a.zip").write_bytes(bytes(data))
    with pytest.raises(Exception, match="damaged|no zip archive|cut short"):
        archives.zip_lines(listed(spark, tmp_path)).collect()


def test_written_archives_are_read_back(spark, tmp_path):
    rows = [(f"s{i % 3}", f"{i}.en", f"text {i}\nmore" if i % 4 else None) for i in range(50)]
    archives.write_archives(spark.createDataFrame(rows, "archive string, member string, content string"), str(tmp_path / "out"))
    found = read(spark, tmp_path / "out")
    assert {(a.split("-")[0], m): x for (a, m), x in found.items()} == {
        (a, m): t.split("\n") for a, m, t in rows if t
    }
    for path in (tmp_path / "out").glob("*.zip"):
        assert zipfile.ZipFile(path).testzip() is None
