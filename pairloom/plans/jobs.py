"""The whole jobs: corpus to shards, shards to batches, predictions to scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairloom.config import AlignedIngest, Ingest, Loader
from pairloom.functions import arrays
from pairloom.functions.tokenizers import Tokenizer
from pairloom.operators import batch, pack, ranks, score, segment, tokens
from pairloom.operators.permutation import place_of_row
from pairloom.operators.prefix import row_positions
from pairloom.session import join_null_safe, materialise
from pairloom.sources import lines
from pairloom.sources.shards import read_shards, shards_exist, write_shards


def _write(packed: DataFrame, out: str, tokenizer: Tokenizer, *marker) -> None:
    def encode(placed: DataFrame) -> DataFrame:
        ids = {c: arrays.require_in_range(F.col(c)) for c in ("src_ids", "tgt_ids")}
        encoded = tokens.encode_pairs(placed, tokenizer, *marker).withColumns(ids)
        return encoded.select(
            "lang_pair", "split", "shard_idx", "pair_id", "src_ids", "tgt_ids", "n_src", "n_tgt"
        )

    write_shards(packed.withColumn("split", pack.split_name()), out, encode=encode)


def _counted_once(counted: DataFrame) -> DataFrame:
    """Written, so that filter, limit, packing and the write do not count again."""
    return materialise(counted, "counted-pairs")


def ingest_nested(
    spark: SparkSession,
    folders: dict[str, str],
    out: str,
    tokenizer: Tokenizer,
    options: Ingest = Ingest(),
) -> None:
    """Nested pairs, one folder of JSON lines for each language pair, to shards.

    Ids without a marker; the limit counts examined pairs; a shard closes at the
    pair that fills it. An existing output is left alone.
    """
    if shards_exist(spark, out):
        return
    parts = [lines.read_nested(spark, path, lang_pair) for lang_pair, path in folders.items()]
    pairs = tokens.number_pairs(reduce(DataFrame.unionByName, parts), ["path", "line_no"])
    examined = tokens.limit_examined(pairs, options.max_pairs)
    counted = _counted_once(tokens.count_tokens(examined, tokenizer))
    kept = tokens.within_length(counted, options.max_seq_len)
    _write(pack.pack_greedy(kept, options.shard_size), out, tokenizer)


def ingest_aligned(
    spark: SparkSession,
    folder: str,
    languages: tuple[str, str],
    out: str,
    tokenizer: Tokenizer,
    options: AlignedIngest = AlignedIngest(),
) -> None:
    """Line-aligned files ``*.<language>`` of a folder to shards.

    Stripped lines; marker first, or last with truncation when fine-tuning; the
    limit counts kept pairs; a shard closes after the batch of input lines that
    fills it. An existing output is left alone.
    """
    if shards_exist(spark, out):
        return
    source, target = languages
    aligned = lines.read_aligned(spark, folder, f".{source}", f".{target}").withColumn(
        "lang_pair", F.lit(f"{source}-{target}")
    )
    pairs = tokens.number_pairs(tokens.strip_pairs(aligned), ["file_no", "line_no"])
    marker = ("last", options.max_seq_len) if options.fine_tune else ("first",)
    counted = _counted_once(tokens.count_tokens(pairs, tokenizer, *marker))
    kept = tokens.limit_kept(
        tokens.within_length(counted, options.max_seq_len), options.max_pairs
    )
    packed = pack.pack_batched(kept, options.shard_size, options.batch_size)
    _write(packed, out, tokenizer, *marker)


def shard_sequences(shards: DataFrame, marker_at: str, max_len: int | None = None) -> DataFrame:
    """Sequences of shards that hold a row for each pair, numbered by ``position``.

    The same sequences as ``segment.sequences`` finds in the flat streams:
    marker included when it is first, left out when it is last.
    """

    placed = row_positions(shards, "pair_id", "seq_id", by=segment.shard_keys(shards))
    return segment.number_sequences(placed).select(
        *segment.shard_keys(shards),
        "seq_id",
        F.col("n").alias("position"),
        _side_ids("src_ids", marker_at, max_len).alias("source"),
        _side_ids("tgt_ids", marker_at, max_len).alias("target"),
    )


def _side_ids(column: str, marker_at: str, max_len: int | None) -> Column:
    ids = F.col(column)
    if marker_at == "last":
        ids = F.slice(ids, F.lit(1), F.greatest(F.size(ids) - 1, F.lit(0)))
    return ids if max_len is None else arrays.truncate(ids, max_len)


def batches(
    spark: SparkSession,
    shards: str,
    lang_pair: str | None = None,
    split: str | None = None,
    marker_at: str = "first",
    epoch: int = 0,
    options: Loader = Loader(),
) -> DataFrame:
    """Padded batches for every rank: a row for each sequence with ``rank, batch_id,
    row_in_batch``, its optimiser step, and the training columns.

    Each language pair and split is ranked and batched by itself; without a name
    all of them are read. Numbers, places, ranks, batches and widths are found on keys and
    lengths alone; the tokens move once, to the rows that ask for them. The shuffle is
    computed from the numbers, without a sort.
    """
    wanted = {"lang_pair": lang_pair, "split": split}
    stored = read_shards(spark, shards, **{k: v for k, v in wanted.items() if v is not None})
    shard, loader = segment.shard_keys(stored), segment.loader_keys(stored)
    sides = {
        "source": _side_ids("src_ids", marker_at, options.max_seq_len),
        "target": _side_ids("tgt_ids", marker_at, options.max_seq_len),
    }
    lengths = stored.select(
        *shard, "pair_id", F.size(sides["source"]).alias("src_lengths"), F.size(sides["target"]).alias("tgt_lengths")
    )
    narrow = materialise(row_positions(lengths, "pair_id", "seq_id", by=shard), "lengths")
    numbered = segment.number_sequences(narrow)
    if options.shuffle:
        totals = materialise(
            narrow.groupBy(*loader).agg(F.count(F.lit(1)).alias("_total")), "totals"
        )
        place = place_of_row(F.col("n"), F.col("_total"), options.seed, epoch)
        numbered = join_null_safe(numbered, totals, loader).withColumn("position", place).drop("_total")
    else:
        numbered = numbered.withColumn("position", F.col("n"))
    ranked = ranks.rank_sequences(numbered, options.world_size)
    assigned = batch.assign_batches(ranked, options.batch_size, "rank_row")
    keys = (*loader, "rank", "batch_id")
    sized = batch.batch_widths(assigned, keys).drop("n", "position", "rank_row", "src_lengths", "tgt_lengths")
    tokens_ = stored.select(*shard, "pair_id", *[ids.alias(c) for c, ids in sides.items()])
    rows = join_null_safe(sized, tokens_, [*shard, "pair_id"]).withColumns(
        {"src_lengths": F.size("source"), "tgt_lengths": F.size("target")}
    )
    collated = batch.collate(rows.drop("pair_id"), options.pad_id, keys=keys)
    seq_len = options.step_seq_len if options.max_seq_len is None else options.max_seq_len
    accumulation = batch.accumulation_steps(
        options.batch_size, seq_len, options.world_size, options.tokens_per_step
    )
    return batch.step_plan(collated, accumulation)


def scores(predictions: DataFrame, vectors: DataFrame | None = None) -> DataFrame:
    """``metric, value``: mean sentence BLEU, corpus BLEU and mean METEOR of
    ``pair_id, candidate, reference`` (token arrays), and the BERTScore means
    where token vectors are given."""

    def long(wide: DataFrame) -> DataFrame:
        return wide.unpivot([], wide.columns, "metric", "value")

    parts = [
        long(score.bleu_sentence(predictions).agg(F.avg("bleu").alias("bleu"))),
        long(score.bleu_corpus(predictions).select(F.col("bleu").alias("corpus_bleu"))),
        long(score.meteor(predictions).agg(F.avg("meteor").alias("meteor"))),
    ]
    if vectors is not None:
        parts.append(long(score.bert_score_mean(score.bert_score(vectors))))
    return reduce(DataFrame.unionByName, parts)
