"""WARC archives: a deterministic sharded writer and a reader.

Records are range-sorted by page, each range is written by one task, and a file is
closed when its compressed size reaches ``ROLL_BYTES``. Every record is a gzip
member of its own with headers and digests made anew, so the same table always
gives the same bytes. A task writes under temporary names and reports them in the
manifest, a table that Spark commits as a whole; only then are the files it lists
given their names. Files of lost attempts are in no manifest and never read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.sharedfs import read_file, resolve, temporary
from pairloom.llm.tables import record_batch
from pairloom.session import materialise, new_path

MIN_REVISIT_BYTES = 1000
ROLL_BYTES = 32 << 20
LEVEL = 6
READ_BYTES = 1 << 14
DATE = "1970-01-01T00:00:00Z"  # the tables have no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value
MANIFEST = (
    "temporary string, path string, n_records bigint, n_bytes bigint, file_sha1 string"
)
READ = (
    "page_id bigint, payload_bytes bigint, payload_digest string,"
    "record_type string, refers_to bigint"
)


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def _member(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # gzip, without a time
    data = b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"
    return squeeze.compress(data) + squeeze.flush()


def page_record(page_id, url, payload: bytes, digest: str, revisit: bool, refers_to) -> bytes:
    """The gzip member of one page; a revisit holds the HTTP headers alone."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    clean = "".join(c for c in url or "" if c not in "\r\n")
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", clean),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        ("Content-Type", "application/http; msgtype=response"),
        ("X-Page-ID", "" if page_id is None else str(page_id)),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", PROFILE),
            ("WARC-Refers-To", record_id(refers_to, digest)),
            ("X-Refers-To-Page-ID", "" if refers_to is None else str(refers_to)),
        ]
    return _member(headers, block)


class RollingFile:
    """Files of one task; ``add`` gives the manifest row of a file that it closed."""

    def __init__(self, folder: str, task: int, roll_bytes: int):
        self.folder, self.task, self.roll_bytes, self.part, self.out = folder, task, roll_bytes, 0, None

    def _open(self) -> None:
        name = f"pages-{self.task:08d}-{self.part:06d}.warc.gz"
        self.path = f"{self.folder}/{name}"
        self.hidden = temporary(self.path)
        store, path = resolve(self.hidden)
        store.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.sha1, self.size, self.count = store.open_output_stream(path), hashlib.sha1(), 0, 0
        info = f"software: page archive writer\r\nformat: WARC File Format 1.1\r\nfilename: {name}\r\n"
        self._write(
            _member(
                [
                    ("WARC-Type", "warcinfo"),
                    ("WARC-Record-ID", record_id(None, name)),
                    ("WARC-Date", DATE),
                    ("WARC-Filename", name),
                    ("Content-Type", "application/warc-fields"),
                ],
                info.encode(),
            )
        )

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.sha1.update(data)
        self.size += len(data)

    def add(self, record: bytes) -> Iterator[pa.RecordBatch]:
        if self.out is None:
            self._open()
        self._write(record)
        self.count += 1
        if self.size >= self.roll_bytes:
            yield from self.close()

    def close(self) -> Iterator[pa.RecordBatch]:
        if self.out is None:
            return
        self.out.close()
        row = {
            "temporary": self.hidden,
            "path": self.path,
            "n_records": self.count,
            "n_bytes": self.size,
            "file_sha1": self.sha1.hexdigest(),
        }
        self.out, self.part = None, self.part + 1
        yield record_batch(MANIFEST, {k: [v] for k, v in row.items()})


def write_archives(
    pages: DataFrame,
    folder: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    roll_bytes: int = ROLL_BYTES,
    min_revisit_bytes: int = MIN_REVISIT_BYTES,
) -> DataFrame:
    """Write every page; return the manifest of the files, under their final names.

    Of pages with equal payloads of ``min_revisit_bytes`` or more the one with the
    largest key is the response, the others revisit it. A null payload is empty.
    Of repeated rows (equal key and payload) the first can be the response. Null keys come first
    and count as smallest; other columns are not read. An empty table has no files.
    """
    rows = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"),
        F.col(url).alias("url"),
        F.coalesce(F.col(html), F.lit("")).alias("html"),
    ).withColumn("digest", F.sha1("html"))
    long = rows.where(F.octet_length("html") >= min_revisit_bytes).select("page_id", "digest")
    last = long.groupBy("digest").agg(
        F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")
    )
    # only the keys of copies meet their response; the mark sorts before its page
    marks = (
        long.join(last.where("copies > 1"), "digest")
        .where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
        .distinct()
        .select("page_id", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"), "digest", "refers_to")
    )
    everything = marks.unionByName(
        rows.withColumn("refers_to", F.lit(None).cast("bigint"))
    ).withColumn("is_page", F.col("html").isNotNull().cast("int"))
    keys = ("digest", "is_page", "url")
    ranged = (
        everything.repartitionByRange(F.col("page_id").asc_nulls_first(), "digest")
        .sortWithinPartitions(F.col("page_id").asc_nulls_first(), *keys)
        .select("page_id", "url", "html", "digest", "refers_to", "is_page", F.spark_partition_id().cast("bigint").alias("task"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, marked, target, seen = None, None, None, None
        for batch in batches:
            page, urls, htmls, digests, refers, is_page, task = batch.columns
            if out is None and len(batch):
                out = RollingFile(folder, task[0].as_py(), roll_bytes)
            for i in range(len(batch)):
                key = (page[i].as_py(), digests[i].as_py())
                if not is_page[i].as_py():
                    marked, target = key, refers[i].as_py()
                    continue
                payload = htmls[i].as_py().encode()
                again = key == seen and len(payload) >= min_revisit_bytes
                revisit = key == marked or again
                refers_to = target if key == marked else key[0]
                seen = key
                yield from out.add(
                    page_record(key[0], urls[i].as_py(), payload, key[1], revisit, refers_to)
                )
        if out is not None:
            yield from out.close()

    manifest = materialise(ranged.mapInArrow(run, MANIFEST), "archive-manifest")

    def publish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rename the files of the manifest; a task that runs again finds them renamed."""
        for batch in batches:
            for hidden, path, size in zip(*(c.to_pylist() for c in (batch.column(0), batch.column(1), batch.column(3)))):
                store, source = resolve(hidden)
                target = resolve(path)[1]
                if store.get_file_info(source).is_file:
                    store.move(source, target)
                if store.get_file_info(target).size != size:
                    raise OSError(f"{path} is not as its manifest says")
            yield batch

    return materialise(manifest.mapInArrow(publish, MANIFEST), "archives")


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each gzip member of an archive."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            part = view[at : at + READ_BYTES]
            if not len(part):
                raise ValueError("an archive ends inside a record")
            parts.append(member.decompress(part))
            at += len(part) - len(member.unused_data)
        record = b"".join(parts)
        head, _, rest = record.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if lines[0] != "WARC/1.1":
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def read_archives(manifest: DataFrame) -> DataFrame:
    """One row per page record, with the size and digest of the full payload.

    Digests are checked; a revisit's are those that its headers state.
    """

    def number(x: str) -> int | None:
        return int(x) if x else None

    def rows_of(path: str) -> Iterator[tuple]:
        data = read_file(path)
        for headers, block in parse_records(data):
            if headers["WARC-Type"] == "warcinfo":
                continue
            if _sha1(block) != headers["WARC-Block-Digest"]:
                raise ValueError(f"damaged record {headers['WARC-Record-ID']} in {path}")
            http, _, payload = block.partition(b"\r\n\r\n")
            digest = base64.b32decode(headers["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            size = int(http.rpartition(b"Content-Length: ")[2])
            revisit = headers["WARC-Type"] == "revisit"
            if not revisit and (len(payload), hashlib.sha1(payload).hexdigest()) != (size, digest):
                raise ValueError(f"damaged payload {headers['WARC-Record-ID']} in {path}")
            yield (
                number(headers["X-Page-ID"]),
                size,
                digest,
                headers["WARC-Type"],
                number(headers["X-Refers-To-Page-ID"]) if revisit else None,
            )

    names = [x.split()[0] for x in READ.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = list(rows_of(path))
                yield record_batch(READ, dict(zip(names, zip(*rows))))

    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path").repartition(parts, "path").mapInArrow(run, READ)


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back."""
    folder = new_path(pages.sparkSession, "archives")
    return read_archives(write_archives(pages, folder))
