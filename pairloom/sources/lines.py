"""Line-aligned text files: pairing of files and numbered lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.operators.prefix import number_rows, ordered_prefix
from pairloom.session import materialise
from pairloom.sources.pairs import align_lines, from_nested


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """Paths in a folder, and the URIs by which scans name them; no file is opened."""
    return (
        spark.read.format("binaryFile")
        .load(folder)
        .select("path", F.col("_metadata.file_path").alias("uri"))
    )


def rank_files(files: DataFrame, suffix: str) -> DataFrame:
    """Files with a name ending in ``suffix``, numbered from 0 in name order."""
    name = base_name(F.col("path"))
    matching = files.where(F.endswith(name, F.lit(suffix))).select("path", name.alias("name"))
    return number_rows(matching, ["name", "path"], "file_no")


def file_pairs(files: DataFrame, source_suffix: str, target_suffix: str) -> DataFrame:
    """File i of one side with file i of the other; surplus files are dropped."""
    source = rank_files(files, source_suffix).select(
        "file_no", F.col("path").alias("src_path"), F.col("name").alias("src_name")
    )
    target = rank_files(files, target_suffix).select(
        "file_no", F.col("path").alias("tgt_path"), F.col("name").alias("tgt_name")
    )
    return source.join(target, "file_no")


def read_lines(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """Lines of text files with their number: ``path, line_no, line``.

    Large files stay split. The text source has no line numbers, but a split
    is read in order by one task, so a row's place in its split is its row id
    minus the smallest of the split; the lines before a split come from the
    lines counted in the splits before it. The scan is written once, because
    splits may be planned differently when it is read again.
    """
    reader = spark.read
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    scan = reader.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("line"),
    )
    lines = materialise(scan, "lines")
    splits = lines.groupBy("path", "split").agg(
        F.min("row").alias("first_row"), F.count(F.lit(1)).alias("n")
    )
    offsets = ordered_prefix(
        splits, "split", {"start": ("sum", F.col("n"))}, by=["path"], inclusive=False
    )
    # one row per split: written, so that the planner broadcasts it when it is small
    offsets = materialise(offsets.drop("n"), "line-offsets")
    return lines.join(offsets, ["path", "split"]).select(
        "path", (F.col("start") + F.col("row") - F.col("first_row")).alias("line_no"), "line"
    )


def read_aligned(
    spark: SparkSession, folder: str, source_suffix: str, target_suffix: str
) -> DataFrame:
    """Pairs of all aligned files of a folder: ``file_no, line_no, src_text, tgt_text``."""
    files = list_files(spark, folder)
    pairs = materialise(file_pairs(files, source_suffix, target_suffix), "file-pairs")

    def side(suffix: str, path: str) -> DataFrame:
        numbers = pairs.select("file_no", F.col(path).alias("path")).join(files, "path")
        numbers = materialise(numbers.select("file_no", F.col("uri").alias("path")), "file-numbers")
        return read_lines(spark, folder, f"*{suffix}").join(numbers, "path").drop("path")

    return align_lines(side(source_suffix, "src_path"), side(target_suffix, "tgt_path"))


def read_nested(spark: SparkSession, path: str, lang_pair: str) -> DataFrame:
    """Nested pairs from JSON lines, in file and line order:
    ``lang_pair, path, line_no, src_text, tgt_text``.

    A line that is no such pair ends the job; ``checked_nested`` says which.
    """
    parsed = checked_nested(spark, path, lang_pair)
    whole = F.col("src_text").isNotNull() & F.col("tgt_text").isNotNull()
    message = F.concat(F.lit("not a pair: "), "path", F.lit(" line "), F.col("line_no").cast("string"))
    return parsed.where(F.when(whole, True).otherwise(F.raise_error(message))).drop("reason")


def checked_nested(spark: SparkSession, path: str, lang_pair: str) -> DataFrame:
    """As ``read_nested``, but every line stays, with the ``reason`` why it is no pair."""
    schema = "translation map<string,string>"
    parsed = read_lines(spark, path).select(
        F.lit(lang_pair).alias("lang_pair"),
        "path",
        "line_no",
        F.from_json("line", schema)["translation"].alias("translation"),
    )
    missing = F.concat(
        F.when(F.col("src_text").isNull(), "source ").otherwise(""),
        F.when(F.col("tgt_text").isNull(), "target ").otherwise(""),
        F.lit("missing"),
    )
    both = F.col("src_text").isNotNull() & F.col("tgt_text").isNotNull()
    return from_nested(parsed.withColumn("malformed", F.col("translation").isNull())).withColumn(
        "reason", F.when(F.col("malformed"), "no translation").when(~both, missing)
    ).drop("malformed")
