"""Pairs, streams and logs derived from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.functions.tokenizers import ByteTokenizer
from pairloom.operators import pack, segment, tokens
from pairloom.operators.marker_index import build_index
from pairloom.operators.prefix import int_div, number_rows
from pairloom.operators.subwords import count_chunks, learn_merges
from pairloom.operators.vocabulary import build_vocabulary
from pairloom.session import materialise, new_path, read_bucketed, write_bucketed
from pairloom.sources.archives import write_archives
from pairloom.sources.pairs import align_lines
from pairloom.sources.shards import read_shards, write_shards

LANG_PAIR = "en-xx"
MAX_LEN = 512  # tokens a side, where filtering or truncating is the feature
SHARD_SIZE = 20_000  # tokens
SEGMENT_ROWS = 64  # of the packing, so that its tree has levels on small data too
CHUNK = 1000
MERGES = 24
BYTES = ByteTokenizer()

_written: dict[tuple[str, str, str], str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user turn and the assistant turn after it, keyed by ``conv_id, turn``.

    A join on the unique ``(conv_id, turn)`` instead of a window over the
    conversation, so that one very long conversation is spread over tasks.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select(
        "conv_id", "turn", F.col("text").alias("src_text")
    )
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("tgt_text")
    )
    return asked.join(answered, ["conv_id", "turn"]).select(
        "conv_id", "turn", F.lit(LANG_PAIR).alias("lang_pair"), "src_text", "tgt_text"
    )


def numbered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``conversation_pairs`` with a dense ``pair_id`` in the order of the turns.

    Numbered once and written: this is the pairs table that every later stage
    scans with its own columns and filters.
    """

    def write(path: str) -> None:
        pairs = conversation_pairs(spark, sf_dir)
        number_rows(pairs, ["conv_id", "turn"], "pair_id").drop("conv_id", "turn").write.parquet(path)

    return spark.read.parquet(_once(spark, sf_dir, "pairs", write))


def nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn as a JSON line of a nested pair; a last turn has no answer, and
    of each seventh conversation the lines are cut short."""
    turns = table(spark, sf_dir, "conversations")
    asked = turns.where(F.col("role") == "user").select("conv_id", "turn", "text")
    answered = turns.where(F.col("role") == "assistant").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer")
    )
    pair = F.struct(F.struct(F.col("text").alias("en"), F.col("answer").alias("xx")).alias("translation"))
    line = F.to_json(pair)
    return asked.join(answered, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", F.when(F.col("conv_id") % 7 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")
    )


def document_lines(spark: SparkSession, sf_dir: str, side: int) -> DataFrame:
    """Lines of the even (0) or odd (1) documents as numbered lines of files:
    document 2k is the source file k and document 2k + 1 its target file."""
    documents = table(spark, sf_dir, "documents").where(F.col("doc_id") % 2 == side)
    return documents.select(
        int_div(F.col("doc_id"), 2).alias("file_no"),
        "lang",
        F.posexplode(F.split("text", "\n")).alias("line_no", "line"),
    )


def line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aligned lines of document pairs, in the language pairs of their left side."""
    source, target = (document_lines(spark, sf_dir, side) for side in (0, 1))
    return align_lines(source.withColumn("lang_pair", F.concat("lang", F.lit("-zz"))), target).drop(
        "lang"
    )


def numbered_line_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(path: str) -> None:
        pairs = line_pairs(spark, sf_dir).withColumn("line_no", F.col("line_no").cast("bigint"))
        number_rows(pairs, ["file_no", "line_no"], "pair_id").write.parquet(path)

    return spark.read.parquet(_once(spark, sf_dir, "line-pairs", write))


def all_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of conversations and of lines: a corpus of several language pairs.

    ``pair_id`` is unique in its language pair."""
    columns = ("lang_pair", "pair_id", "src_text", "tgt_text")
    conversations = numbered_pairs(spark, sf_dir).select(*columns)
    return conversations.unionByName(numbered_line_pairs(spark, sf_dir).select(*columns))


def counted_pairs(pairs: DataFrame) -> DataFrame:
    """All pairs, stripped, with the lengths of their byte tokens, marker first."""
    return tokens.count_tokens(tokens.strip_pairs(pairs), BYTES, "first")


def packed_pairs(counted: DataFrame) -> DataFrame:
    """Pairs with their shard and split."""
    packed = pack.pack_greedy(counted, SHARD_SIZE, segment_rows=SEGMENT_ROWS)
    return packed.withColumn("split", pack.split_name())


def write_packed(spark: SparkSession, sf_dir: str, path: str) -> None:
    """The whole ingest after numbering: pack, split, tokenise, write."""

    def encode(placed: DataFrame) -> DataFrame:
        return tokens.encode_pairs(placed, BYTES, "first").drop("src_text", "tgt_text")

    write_shards(packed_pairs(counted_pairs(all_pairs(spark, sf_dir))), path, encode=encode)


def _once(spark: SparkSession, sf_dir: str, name: str, write) -> str:
    """Path of a table that later stages read, written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = new_path(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def shards_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the packed pairs are written as shards."""
    return _once(spark, sf_dir, "shards", lambda p: write_packed(spark, sf_dir, p))


def shards(spark: SparkSession, sf_dir: str, **partitions) -> DataFrame:
    """The packed pairs as written shards, the input of all loading stages."""
    return read_shards(spark, shards_path(spark, sf_dir), **partitions)


def flat_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards as flat token streams in chunks, as a loader finds them."""

    def write(path: str) -> None:
        runs = segment.runs_of_pairs(shards(spark, sf_dir))
        chunks = segment.rechunk(runs, CHUNK)
        write_bucketed(chunks, path, segment.shard_keys(chunks))

    return read_bucketed(spark, _once(spark, sf_dir, "flat", write))


def loaded_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences found in the flat shards, numbered in their language pair and split."""

    def write(path: str) -> None:
        flat = flat_shards(spark, sf_dir)
        found = segment.sequences(flat, BYTES.eos_id, "first")
        # every marker begins a sequence, on both sides
        counts = segment.stream_profile(flat.where("side = 'src'"), BYTES.eos_id).select(
            *segment.shard_keys(flat), F.col("n_markers").alias("_count")
        )
        segment.number_sequences(found, materialise(counts, "shard-counts")).write.parquet(path)

    return spark.read.parquet(_once(spark, sf_dir, "sequences", write))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of the conversations."""
    texts = conversation_pairs(spark, sf_dir).select(
        F.concat_ws(" ", "src_text", "tgt_text").alias("text")
    )
    return build_vocabulary(texts, "text")


def merges_path(spark: SparkSession, sf_dir: str) -> str:
    """Where the byte-pair merges of the conversations are written: ``rank, left, right, n``."""

    def write(path: str) -> None:
        texts = conversation_pairs(spark, sf_dir).select(F.explode(F.array("src_text", "tgt_text")).alias("text"))
        learned = learn_merges(count_chunks(texts, "text"), MERGES)
        rows = [(i, *merge) for i, merge in enumerate(learned)]
        schema = "rank bigint, left string, right string, n bigint"
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)

    return _once(spark, sf_dir, "merges", write)


def run_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as lines of a run log: views are validations."""
    kind = F.when(F.col("event_type") == "view", "val").otherwise("train")
    return table(spark, sf_dir, "events").select(
        F.concat_ws(" ", "event_id", kind, F.col("value").cast("string")).alias("line")
    )


def noisy_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run log among other output: notes, losses that are no numbers, steps out of range."""
    lines = run_log_lines(spark, sf_dir)
    step = F.substring_index("line", " ", 1)
    number = step.cast("bigint")
    return lines.select(
        F.when(number % 11 == 3, F.concat(step, F.lit(" note resumed")))
        .when(number % 13 == 5, F.concat(step, F.lit(" val n/a")))
        .when(number % 17 == 7, F.concat(step, F.lit("0000000000000000000 "), F.substring_index("line", " ", -2)))
        .otherwise(F.col("line")).alias("line")
    )


def runs_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as the logs of many runs, one for each user: ``run, line``."""
    kind = F.when(F.col("event_type") == "view", "val").otherwise("train")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run"),
        F.concat_ws(" ", "event_id", kind, F.col("value").cast("string")).alias("line"),
    )


def archived_documents(spark: SparkSession, sf_dir: str) -> str:
    """Folder of zip archives with the documents of each source as members."""

    def write(path: str) -> None:
        documents = table(spark, sf_dir, "documents").select(
            F.col("source").alias("archive"),
            F.concat_ws(".", "doc_id", "lang").alias("member"),
            F.col("text").alias("content"),
        )
        write_archives(documents, path)

    return _once(spark, sf_dir, "archives", write)


def loaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All language pairs and splits with a number, in order, and how many there are."""

    def write(path: str) -> None:
        each = shards(spark, sf_dir).select("lang_pair", "split").distinct()
        number_rows(each, ["lang_pair", "split"], "number").write.parquet(path)

    return spark.read.parquet(_once(spark, sf_dir, "loaders", write))


def indexed_shards(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The flat shards in folders of their own, and the index of their markers."""

    def write_runs(path: str) -> None:
        keys = segment.shard_keys(flat_shards(spark, sf_dir))
        flat_shards(spark, sf_dir).repartition(*keys).sortWithinPartitions(*keys, "side", "pos").write.partitionBy(
            *segment.loader_keys(flat_shards(spark, sf_dir))
        ).parquet(path)

    runs = read_shards(spark, _once(spark, sf_dir, "shard-folders", write_runs))

    def write_index(path: str) -> None:
        build_index(runs, BYTES.eos_id).write.parquet(path)

    return runs, spark.read.parquet(_once(spark, sf_dir, "marker-index", write_index))


def inflected_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``predictions`` with endings put to plain words of the candidate."""
    words = F.split("tgt_text", " ")

    def inflected(w, i):
        ending = F.when(i % 3 == 1, "ing").when(i % 5 == 2, "s").otherwise("")
        return F.when(i % 7 == 6, F.lit(None)).when(F.regexp_like(w, F.lit("^[A-Za-z]+$")), F.concat(w, ending)).otherwise(w)

    return conversation_pairs(spark, sf_dir).select(
        "conv_id", "turn",
        F.filter(F.transform(words, inflected), lambda w: w.isNotNull()).alias("candidate"),
        words.alias("reference"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies as references, and as candidates without every 7th word."""
    words = F.split("tgt_text", " ")
    kept = F.filter(words, lambda _, i: i % 7 != 6)
    return conversation_pairs(spark, sf_dir).select(
        "conv_id", "turn", kept.alias("candidate"), words.alias("reference")
    )


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as the token vectors of sentence pairs of 2 x 16 tokens."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        int_div(vec, 32).alias("pair_id"),
        F.when(vec % 2 == 0, "candidate").otherwise("reference").alias("side"),
        int_div(F.pmod(vec, F.lit(32)), 2).alias("pos"),
        F.col("embedding").alias("vec"),
    )


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as scores of a vocabulary of 64, five positions a pair."""
    vec = F.col("vec_id")
    return table(spark, sf_dir, "embeddings").select(
        int_div(vec, 5).alias("pair_id"),
        F.pmod(vec, F.lit(5)).alias("pos"),
        F.col("embedding").alias("logits"),
    )
