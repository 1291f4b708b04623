"""An ingest that can be stopped at any time and goes on where it stood.

Three things lie in the output folder: ``plan``, the counted pairs with their shards, written once;
``data``, the shards, written in waves; and ``log``, a row for each shard of a wave that was
written to its end: its pairs, tokens and a digest of its rows. Each wave of a call has twice the shards
of the one before, so that waves are few however many shards there are, and a stop never
loses more than about what the call has written before it. A restart looks at the shards of the
log again, keeps those that still are what the log says, and writes all others.

A folder of ``data`` is what a wave replaces. It holds one shard, or so many neighbours that there are
about ``FOLDERS`` of them, since the driver keeps a list of all folders and files. The plan says
which; a shard that is not what the log says is written again with the others of its folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.tokenizers import Tokenizer
from pairloom.operators import pack, tokens
from pairloom.operators.prefix import int_div, number_rows, ordered_prefix
from pairloom.session import materialise
from pairloom.sources.shards import IN_FOLDER, PARTITIONS, number_in_folders, read_shards, shards_exist

SHARDS_PER_WAVE = 1000
FOLDERS = 512  # and at most two more for each language pair
FOLDER_TOKENS = 10**8  # of many shards; a folder is written by one task
FOLDER = ["lang_pair", "split", "folder"]
LOG = "lang_pair string, split string, shard_idx bigint, pairs bigint, tokens bigint, digest bigint, options string"


def _stated(stored: DataFrame) -> DataFrame:
    """What the log says of each shard; the digest does not depend on the order of rows."""
    row = F.xxhash64("pair_id", F.to_json("src_ids"), F.to_json("tgt_ids"))
    return stored.groupBy(*PARTITIONS).agg(
        F.count(F.lit(1)).alias("pairs"),
        F.sum(F.size("src_ids") + F.size("tgt_ids")).cast("bigint").alias("tokens"),
        F.bit_xor(row).alias("digest"),
    )


def _data(spark: SparkSession, out: str) -> DataFrame:
    return read_shards(spark, f"{out}/data")


def _data_of(spark: SparkSession, out: str, folders: DataFrame) -> DataFrame:
    """The shards of some folders; the others are not read."""
    stored = spark.read.parquet(f"{out}/data").withColumn("shard_idx", F.col("shard_idx").cast("bigint"))
    return number_in_folders(stored.join(folders.withColumnRenamed("folder", "shard_idx"), PARTITIONS))


def _shards_per_folder(counted: DataFrame, shard_size: int) -> int:
    """For about ``FOLDERS`` folders; shards are as many as their pairs and tokens allow, at most."""
    most = F.least(F.count(F.lit(1)), int_div(F.sum(F.col("n_src") + F.col("n_tgt")), shard_size) + 1)
    shards = counted.groupBy("lang_pair").agg(most.alias("n")).agg(F.sum("n")).first()[0] or 0
    return max(1, min(-(-shards // FOLDERS), FOLDER_TOKENS // shard_size))


def _has_files(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return store.exists(folder) and len(store.globStatus(folder.suffix("/[^_.]*"))) > 0


def kept_shards(spark: SparkSession, out: str, options: str) -> DataFrame:
    """The shards of the log whose data are as it says."""
    log = spark.createDataFrame([], LOG)
    if _has_files(spark, f"{out}/log"):
        log = spark.read.schema(LOG).parquet(f"{out}/log")
    others = [r["options"] for r in log.select("options").distinct().collect() if r["options"] != options]
    if others:
        raise ValueError(f"{out} holds an ingest with other options: {others[0]}")
    if not _has_files(spark, f"{out}/data"):
        return log.where("false").select(*PARTITIONS)
    stated = ["pairs", "tokens", "digest"]
    return log.join(_stated(_data(spark, out)), [*PARTITIONS, *stated]).select(*PARTITIONS).distinct()


def ingest(
    pairs: DataFrame,
    out: str,
    tokenizer: Tokenizer,
    shard_size: int,
    shards_per_wave: int = SHARDS_PER_WAVE,
    max_waves: int | None = None,
) -> int:
    """Strip, tokenise, pack and write ``pair_id, lang_pair, src_text, tgt_text``; returns the shards written.

    ``shards_per_wave`` are the shards of the first wave, with those that complete its last folder.
    ``max_waves`` stops after so many waves. The pairs of a restart must be those of the start;
    once the plan is written they are not read again. ``data`` holds the shards (``read_shards``).
    """
    spark = pairs.sparkSession
    options = f"{type(tokenizer).__name__}, {shard_size} tokens"
    if not shards_exist(spark, f"{out}/plan"):
        counted = materialise(tokens.count_tokens(tokens.strip_pairs(pairs), tokenizer, "first"), "counted-pairs")
        width = _shards_per_folder(counted, shard_size)
        packed = pack.pack_greedy(counted, shard_size).withColumn("split", pack.split_name())
        packed.withColumn("folder", int_div(F.col("shard_idx"), width) * width).write.mode("overwrite").parquet(f"{out}/plan")
    plan = spark.read.parquet(f"{out}/plan")
    if "folder" not in plan.columns:  # a plan of before had a folder for each shard
        plan = plan.withColumn("folder", F.col("shard_idx"))
    kept = kept_shards(spark, out, options).withColumn("kept", F.lit(1))
    wanted = plan.select(*PARTITIONS, "folder").distinct().join(kept, PARTITIONS, "left")
    missing = wanted.groupBy(*FOLDER).agg(F.count(F.lit(1)).alias("shards"), F.count("kept").alias("kept"))
    numbered = number_rows(missing.where("kept < shards").drop("kept"), FOLDER, "number")
    before = {"before": ("sum", F.col("shards"))}
    folders = materialise(ordered_prefix(numbered, "number", before, inclusive=False), "missing-folders")
    many = plan.where(F.col("shard_idx") != F.col("folder")).limit(1).count() > 0
    n = folders.agg(F.sum("shards")).first()[0] or 0
    written, wave, size = 0, 0, shards_per_wave
    while written < n and (max_waves is None or wave < max_waves):
        in_wave = folders.where((F.col("before") >= written) & (F.col("before") < written + size))
        own = in_wave.select(*FOLDER)
        of_folders = plan.join(own, FOLDER).withColumn(IN_FOLDER, F.col("shard_idx") - F.col("folder"))
        placed = of_folders.withColumn("shard_idx", F.col("folder")).repartition(
            "lang_pair", "shard_idx"
        ).sortWithinPartitions(*PARTITIONS, IN_FOLDER, "pair_id")  # texts, before their ids are made
        encoded = tokens.encode_pairs(placed, tokenizer, "first").select(
            *PARTITIONS, *[IN_FOLDER] * many, "pair_id", "src_ids", "tgt_ids", "n_src", "n_tgt"
        )
        (  # shards that were half written before are replaced
            encoded.write.mode("overwrite")
            .option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(f"{out}/data")
        )
        stated = _stated(_data_of(spark, out, own)).withColumn("options", F.lit(options))
        names = [f.split()[0] for f in LOG.split(", ")]
        stated.select(*names).write.mode("append").parquet(f"{out}/log")
        own_shards = in_wave.agg(F.sum("shards")).first()[0]
        written, wave, size = written + own_shards, wave + 1, 2 * own_shards
    return written
