"""Flat token streams and the sequences in them.

A stream is held as *runs*: ``lang_pair, split, shard_idx, side, pos, tokens`` with
``pos`` the position of the first token; the runs of a shard side follow each other
without gaps. A table of one language pair or split may leave those columns out. A run may be a whole pair, a chunk of fixed size, or a single token.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pairloom.functions import arrays
from pairloom.operators.prefix import int_div, ordered_prefix
from pairloom.session import join_null_safe, materialise


def loader_keys(df: DataFrame) -> list[str]:
    """What tells one loader's data from another's; each numbers its own sequences."""
    return [c for c in ("lang_pair", "split") if c in df.columns]


def shard_keys(df: DataFrame) -> list[str]:
    return [*loader_keys(df), "shard_idx"]


def stream_keys(df: DataFrame) -> list[str]:
    return [*shard_keys(df), "side"]


def runs_of_pairs(packed: DataFrame) -> DataFrame:
    """The streams of packed pairs: one run for each side of a pair.

    A shard is of bounded size, so its pairs meet in one task and their tokens move once; what is
    grouped by shard and more afterwards stays there.
    """
    keys = shard_keys(packed)
    before = Window.partitionBy(*keys).orderBy("pair_id").rowsBetween(Window.unboundedPreceding, -1)
    sides = F.array(
        *[
            F.struct(
                F.lit(side).alias("side"),
                F.coalesce(F.sum(F.size(f"{side}_ids").cast("bigint")).over(before), F.lit(0)).alias("pos"),
                F.col(f"{side}_ids").alias("tokens"),
            )
            for side in ("src", "tgt")
        ]
    )
    placed = packed.select(*keys, "pair_id", "src_ids", "tgt_ids")
    return placed.select(*keys, sides.alias("runs")).select(*keys, F.explode("runs").alias("run")).select(*keys, "run.*")


def rechunk(runs: DataFrame, size: int) -> DataFrame:
    """The same streams in runs of ``size`` tokens (the last of a side may be shorter).

    This is the concatenation of a shard in order, in pieces of bounded size.
    """
    stream = stream_keys(runs)
    end = F.col("pos") + F.size("tokens")
    start = F.greatest(F.col("pos"), F.col("chunk") * size)
    piece = F.slice(
        "tokens",
        (start - F.col("pos") + 1).cast("int"),
        (F.least(end, (F.col("chunk") + 1) * size) - start).cast("int"),
    )
    pieces = (
        runs.where(F.size("tokens") > 0)
        .withColumn("chunk", F.explode(F.sequence(int_div(F.col("pos"), size), int_div(end - 1, size))))
        .select(*stream, "chunk", start.alias("pos"), piece.alias("tokens"))
    )
    return (
        pieces.groupBy(*stream, "chunk")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "tokens"))).alias("p"))
        .select(*stream, (F.col("chunk") * size).alias("pos"), F.flatten("p.tokens").alias("tokens"))
    )


def stream_profile(runs: DataFrame, marker: int) -> DataFrame:
    """Tokens and markers of each side of each shard."""
    return runs.groupBy(*stream_keys(runs)).agg(
        F.sum(F.size("tokens")).cast("bigint").alias("n_tokens"),
        F.sum(arrays.marker_count(F.col("tokens"), marker)).cast("bigint").alias("n_markers"),
    )


def marker_mismatch(runs: DataFrame, marker: int) -> DataFrame:
    """Shards whose sides do not hold the same number of sequences."""

    def markers(side: str):
        return F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n_markers"))), F.lit(0)).cast("bigint")

    return (
        stream_profile(runs, marker)
        .groupBy(*shard_keys(runs))
        .agg(markers("src").alias("src_markers"), markers("tgt").alias("tgt_markers"))
        .where(F.col("src_markers") != F.col("tgt_markers"))
    )


def marker_positions(runs: DataFrame, marker: int) -> DataFrame:
    """Position of each marker, and the stream length as the end of the last sequence."""
    stream = stream_keys(runs)
    offsets = arrays.marker_offsets(F.col("tokens"), marker)
    found = runs.select(*stream, "pos", F.explode(offsets).alias("i")).select(
        *stream, (F.col("pos") + F.col("i")).alias("pos")
    )
    ends = runs.groupBy(*stream).agg(F.sum(F.size("tokens")).cast("bigint").alias("pos"))
    return found.unionByName(ends)


def head(runs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` tokens of each stream, one per row."""
    stream = stream_keys(runs)
    return (
        runs.where(F.col("pos") < n)
        .select(*stream, "pos", F.posexplode("tokens").alias("i", "token"))
        .select(*stream, (F.col("pos") + F.col("i")).alias("pos"), "token")
        .where(F.col("pos") < n)
    )


def sequences(
    runs: DataFrame,
    marker: int,
    marker_at: str = "first",
    max_len: int | None = None,
    strict: bool = True,
) -> DataFrame:
    """Sequences of both sides: the keys of their shard, ``seq_id, source, target``.

    ``marker_at="first"``: a sequence begins with its marker and ends before the
    next one; tokens before the first marker belong to none. ``"last"``: a
    sequence ends before its marker, which is left out; tokens after the last
    marker belong to none, and empty sequences stay. A sequence found on one side
    only ends the job; without ``strict`` it is left out (``marker_mismatch``
    reports such shards).

    Pieces beyond ``max_len`` are dropped where they are found, so that a
    sequence meets in one row with no more than ``max_len`` tokens a side.
    """
    first = marker_at == "first"
    stream, shard = stream_keys(runs), shard_keys(runs)
    # A shard is of bounded size: its runs meet in one task, where its sequences are put together
    # without another shuffle. Both sides share the window; each counts its own rows.
    with_markers = runs.select(*stream, "pos", "tokens").withColumn("_m", arrays.marker_offsets(F.col("tokens"), marker))
    last_marker = F.when(F.size("_m") > 0, F.col("pos") + F.element_at("_m", -1))
    before = Window.partitionBy(*shard).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    sides = ("src", "tgt")

    def own(found: dict[str, Column]) -> Column:
        return F.coalesce(*[F.when(F.col("side") == side, value) for side, value in found.items()])

    counted = with_markers.withColumns({"_n": F.size("_m").cast("bigint"), "_last": last_marker})
    placed = counted.withColumns(
        {f"_{name}_{side}": agg(F.when(F.col("side") == side, F.col(c))).over(before)
         for side in sides for name, agg, c in (("before", F.sum, "_n"), ("open", F.max, "_last"))}
    ).withColumns(
        {
            "_before": F.coalesce(own({side: F.col(f"_before_{side}") for side in sides}), F.lit(0)),
            "_open": own({side: F.col(f"_open_{side}") for side in sides}),
        }
    )
    # Cut at the markers: piece 0 goes on with the sequence open before the run.
    cuts = F.concat(F.array(F.lit(0)), F.col("_m"), F.array(F.size("tokens")))
    skip = 0 if first else 1
    opened = F.coalesce(F.col("_open") + skip, F.lit(0))

    def piece(i):
        start = F.get(cuts, i) + F.when(i > 0, skip).otherwise(0)
        offset = F.when(i > 0, F.lit(0)).otherwise(F.col("pos") - opened)
        length = F.get(cuts, i + 1) - start
        if max_len is not None:
            length = F.greatest(F.least(length, max_len - offset), F.lit(0))
        return F.struct(
            (F.col("_before") + i - (1 if first else 0)).alias("seq_id"),
            (F.col("pos") + start).alias("pos"),
            F.slice(F.col("tokens"), (start + 1).cast("int"), length.cast("int")).alias("tokens"),
            # a marker ends this piece, so it stands for its sequence even when empty
            (i < F.size("_m")).alias("closed"),
        )

    pieces = (
        placed.select(
            *stream,
            F.explode(F.transform(F.sequence(F.lit(0), F.size("_m")), piece)).alias("p"),
        )
        .select(*stream, "p.*")
        .where(F.col("seq_id") >= 0)
    )
    pieces = pieces.where((F.size("tokens") > 0) | (F.col("closed") if not first else F.lit(False)))

    def side_tokens(side: str):
        mine = F.filter("pieces", lambda p: p["side"] == side)
        return F.flatten(F.transform(F.sort_array(mine), lambda p: p["tokens"]))

    def present(side: str):
        # a sequence with its marker last exists once a marker has closed it
        if first:
            return F.exists("pieces", lambda p: p["side"] == side)
        return F.exists("pieces", lambda p: (p["side"] == side) & p["closed"])

    both = present("src") & present("tgt")
    found = pieces.groupBy(*shard, "seq_id").agg(
        F.collect_list(F.struct("side", "pos", "tokens", "closed")).alias("pieces")
    )
    if strict:
        # an open piece behind the last marker belongs to no sequence
        some = present("src") | present("tgt")
        message = F.lit("a shard has a sequence on one side only")
        found = found.where(some & F.when(both, True).otherwise(F.raise_error(message)))
    else:
        found = found.where(both)
    return found.select(
        *shard, "seq_id", side_tokens("src").alias("source"), side_tokens("tgt").alias("target")
    )


def number_sequences(seqs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Add ``n``, the number of a sequence over all shards of its language pair and
    split, from 0.

    Sequence numbers are dense in a shard, so the shards' counts give the offset. ``counts`` (the
    keys of each shard and ``_count``) spares finding them in sequences that are not written yet.
    """
    keys = shard_keys(seqs)
    if counts is None:
        counts = seqs.groupBy(*keys).agg((F.max("seq_id") + 1).alias("_count"))
    starts = ordered_prefix(
        counts,
        "shard_idx",
        {"_start": ("sum", F.col("_count"))},
        by=loader_keys(seqs),
        inclusive=False,
    )
    # one row per shard: written, so that the planner broadcasts it when it is small
    offsets = materialise(starts.drop("_count"), "shard-starts")
    return join_null_safe(seqs, offsets, keys).select(
        *seqs.columns, (F.col("_start") + F.col("seq_id")).cast("bigint").alias("n")
    )


def lookup(seqs: DataFrame, requests: DataFrame) -> DataFrame:
    """The sequence for each requested ``idx``; numbers past the end start again at 0.

    ``seqs`` has ``n`` from ``number_sequences``. Requests have the language pair and
    split of the loader they ask, where ``seqs`` has such columns.
    """
    keys = [*loader_keys(seqs), "_one"]
    seqs, requests = seqs.withColumn("_one", F.lit(0)), requests.withColumn("_one", F.lit(0))
    # one row per loader
    totals = seqs.groupBy(*keys).agg(F.count(F.lit(1)).alias("_total"))
    asked = join_null_safe(requests, totals, keys).withColumn("n", F.pmod("idx", F.col("_total")))
    return join_null_safe(asked, seqs, [*keys, "n"]).drop("_total", "_one")
