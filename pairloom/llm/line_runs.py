"""Line deduplication with levelled sorted runs of line hashes.

A line's key is the line without white space at its ends, A-Z in lower case. Keys of at
least ``MIN_CHARS`` characters are hashed to 128 bits.

1. All long lines are written once as ``(hash, document, row, line)``, by batch. A batch is
   a range of documents; the batches come in descending order of their keys, so that the
   batch that first has a line holds its largest document.
2. A batch sums its lines up by hash and merges with the runs: the anti-join gives the
   lines that no run has, the others are marked as seen. Both become the batch's own run,
   sorted by hash, in buckets, so that runs are merged without moving.
3. ``FAN_OUT`` runs of a level are compacted into one of the next level.
4. The last compaction gives the lines of ``MIN_DOCS`` documents or more and the document
   that keeps each. Their places go back to the documents as lists of line numbers.

The result does not depend on where batches are cut. A row is a key with the digest of its
text: rows of one key count as one document, and null keys as one that is smaller than
any other.
"""

from __future__ import annotations

import uuid
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.llm.spans import distinct_spans, lower_ascii, solid_places, text_bytes, worker_cache
from pairloom.llm.tables import join_weighted, map_texts
from pairloom.session import join_null_safe, materialise, new_path

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 6
FAN_OUT = 3
HASH = ["h1", "h2"]
RUN = "h1 bigint, h2 bigint, n bigint, last bigint, seen boolean"
PLACES = "h1 bigint, h2 bigint, key bigint, row bigint, line int"


def long_lines(texts: pa.Array, min_chars: int = MIN_CHARS) -> tuple[np.ndarray, ...]:
    """``(text, line number, hash)`` of the lines whose key has ``min_chars`` or more."""
    from xxhash import xxh3_128_digest

    buf, offsets = text_bytes(texts)
    breaks = np.flatnonzero(buf == 10)
    begins = np.union1d(offsets[:-1], breaks + 1)
    begins = begins[begins < len(buf)]
    solid = solid_places(buf)
    first = np.searchsorted(solid, begins)
    last = np.append(first[1:], len(solid))
    first, last = first[last > first], last[last > first] - 1  # lines with more than white space
    starts, ends = solid[first], solid[last] + 1
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    long = chars[ends] - chars[starts] >= min_chars
    starts, ends = starts[long], ends[long]
    doc = np.searchsorted(offsets, starts, "right") - 1
    line = np.searchsorted(breaks, starts) - np.searchsorted(breaks, offsets[doc])
    codes, keys = distinct_spans(lower_ascii(buf), starts, ends)
    digests = b"".join(map(xxh3_128_digest, keys.to_pylist()))
    return doc, line, np.frombuffer(digests, "<i8").reshape(-1, 2)[codes]


def line_places(docs: DataFrame, key: str, text: str, min_chars: int) -> DataFrame:
    """``PLACES`` of all long lines of all texts."""

    def run(texts, others):
        worker_cache(None)
        doc, line, hashes = long_lines(texts, min_chars)
        at = pa.array(doc)
        return {
            "h1": hashes[:, 0], "h2": hashes[:, 1],
            "key": others[0].take(at), "row": others[1].take(at), "line": line,
        }

    return map_texts(docs, [text, F.col(key).cast("bigint"), F.xxhash64(text)], PLACES, run)


def batched(places: DataFrame, docs: DataFrame, key: str, batches: int) -> DataFrame:
    """The places, written by batch; batch 0 has the largest keys, the last one the null keys."""
    spark = docs.sparkSession
    shares = [i / batches for i in range(1, batches)]
    cuts = docs.agg(F.percentile_approx(F.col(key).cast("bigint"), shares)).first()[0] if shares else None
    batch = F.lit(0)
    for cut in cuts or []:
        batch = batch + F.coalesce(F.col("key") <= F.lit(cut), F.lit(True)).cast("int")
    path = new_path(spark, "line-places")
    places.withColumn("batch", batch).write.partitionBy("batch").parquet(path)
    return spark.read.schema(PLACES + ", batch int").parquet(path)


class LineRuns:
    """Runs of line hashes in levels; a run is a table in buckets, sorted by hash.

    Columns: the hash, ``n`` (documents), ``last`` (largest key) and ``seen`` (an earlier
    run has the hash). Over all runs a hash has one row that is not seen.
    """

    def __init__(self, spark: SparkSession, fan_out: int = FAN_OUT):
        self.spark, self.fan_out = spark, fan_out
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[tuple[str, str]]] = [[]]  # table and folder of each run

    def _write(self, run: DataFrame) -> tuple[str, str]:
        name, path = f"line_run_{uuid.uuid4().hex}", new_path(self.spark, "line-run")
        (
            run.repartition(self.buckets, *HASH).write.bucketBy(self.buckets, *HASH).sortBy(*HASH)
            .option("path", path).saveAsTable(name)
        )
        return name, path

    def runs(self) -> list[tuple[str, str]]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch (``h1, h2, key``, a row for each place); returns its run."""
        own = (
            lines.select(*HASH, "key").distinct().groupBy(*HASH)
            .agg(F.count(F.lit(1)).alias("n"), F.max("key").alias("last"))
        )
        seen = F.lit(False)
        for i, (name, _) in enumerate(self.runs()):
            known = self.spark.table(name).where(~F.col("seen")).select(*HASH, F.lit(True).alias(f"in_{i}"))
            own = own.join(known.hint("merge"), HASH, "left")
            seen = seen | F.col(f"in_{i}").isNotNull()
        run = self._write(own.select(*HASH, "n", "last", seen.alias("seen")))
        self.levels[0].append(run)
        self._compact()
        return self.spark.table(run[0])

    def _compact(self) -> None:
        for depth, level in enumerate(self.levels):
            if len(level) >= self.fan_out:
                if depth + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[depth + 1].append(self._write(self.merged(level)))
                level.clear()

    def merged(self, runs: list[tuple[str, str]]) -> DataFrame:
        # read as files: Spark takes a union of tables in buckets for grouped by hash
        both = self.spark.read.schema(RUN).parquet(*[path for _, path in runs])
        return both.groupBy(*HASH).agg(
            F.sum("n").alias("n"), F.max("last").alias("last"), F.min("seen").alias("seen")
        )

    def frequent(self, min_docs: int) -> DataFrame:
        """``h1, h2, n, last`` of the lines of at least ``min_docs`` documents."""
        return self.merged(self.runs()).where(F.col("n") >= min_docs).select(*HASH, "n", "last")


def dropped_lines(
    docs: DataFrame, key: str, text: str, min_chars: int, min_docs: int, batches: int, fan_out: int
) -> DataFrame:
    """``key, row, lines``: numbers of the lines that a row loses."""
    places = batched(line_places(docs, key, text, min_chars), docs, key, batches)
    runs = LineRuns(docs.sparkSession, fan_out)
    for i in range(batches):
        runs.add(places.where(F.col("batch") == i))
    frequent = materialise(runs.frequent(min_docs), "frequent-lines")
    lost = join_weighted(places.drop("batch"), frequent, HASH, "n").where(
        F.col("key").isNull() | (F.col("key") < F.col("last"))
    )
    return lost.groupBy("key", "row").agg(F.collect_set("line").alias("lines"))


def remove_lines(
    docs: DataFrame,
    keep: list[str],
    key: str = "doc_id",
    text: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    batches: int = BATCHES,
    fan_out: int = FAN_OUT,
) -> DataFrame:
    """Columns ``keep``, ``n_lines``, ``n_dropped`` and ``kept_text`` of every row.

    Lines end at ``\\n``. A line whose key has ``min_chars`` characters and stands in
    ``min_docs`` documents stays in the one with the largest key only; there every
    occurrence stays. Null and empty texts are one empty line. Repeated rows lose the same
    lines; a line of rows with null keys alone is in one document, so it stays. An empty
    table gives no rows; columns not in ``keep`` are not read.
    """
    lost = dropped_lines(docs, key, text, min_chars, min_docs, batches, fan_out)
    # names of the caller's columns cannot clash with these
    kept = [(f"k{i}", dict(docs.dtypes)[c], c) for i, c in enumerate(keep)]
    rows = docs.select(
        F.col(text).alias("_text"),
        F.col(key).cast("bigint").alias("key"),
        F.xxhash64(text).alias("row"),
        *[F.col(c).alias(name) for name, _, c in kept],
    )
    rows = join_null_safe(rows, lost.hint("merge"), ["key", "row"], "left")  # alike at every size
    schema = ",".join(
        [f"{name} {kind}" for name, kind, _ in kept]
        + ["n_lines bigint", "n_dropped bigint", "kept_text string"]
    )

    def run(texts, others):
        texts = pa.compute.fill_null(texts, "")
        gone = pa.compute.fill_null(pa.compute.list_value_length(others[0]), 0)
        out = texts
        at = np.flatnonzero(gone.to_numpy(zero_copy_only=False))
        if len(at):
            whole = texts.to_pylist()
            for d in at.tolist():
                lines = whole[d].split("\n")
                stays = np.ones(len(lines), bool)
                stays[others[0][d].values.to_numpy()] = False
                whole[d] = "\n".join(compress(lines, stays.tolist()))
            out = pa.array(whole, pa.string())
        return {
            "n_lines": pa.compute.add(pa.compute.count_substring(texts, "\n"), 1),
            "n_dropped": gone,
            "kept_text": out,
        } | {name: column for (name, _, _), column in zip(kept, others[1:])}

    found = map_texts(rows, ["_text", "lines", *[name for name, _, _ in kept]], schema, run)
    return found.select(
        *[F.col(name).alias(c) for name, _, c in kept], "n_lines", "n_dropped", "kept_text"
    )


def digests(docs: DataFrame) -> DataFrame:
    """The counts of ``remove_lines`` and the digest of the text that is left."""
    return remove_lines(docs.select("doc_id", "text"), ["doc_id"]).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )
