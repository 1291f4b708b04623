"""BLEU, METEOR and BERTScore of prediction pairs.

One pair is one row, so BLEU and METEOR are counted inside the row, without a
shuffle of n-grams; the counts of a record batch are made together, and the
scores from the counts are built-in expressions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from pairloom.functions.stems import stemmed
from pairloom.operators.matching import clipped_matches, matches_and_chunks, rows_of
from pairloom.operators.prefix import int_div

# Fixed values of the published definitions.
BLEU_ORDERS = (1, 2, 3, 4)
METEOR_ALPHA, METEOR_BETA, METEOR_GAMMA = 0.9, 3, 0.5

VECTOR_BLOCK = 512


# --- BLEU ------------------------------------------------------------------------


def _clipped(candidate: pa.Array, reference: pa.Array) -> pa.Array:
    return rows_of(clipped_matches(candidate, reference, len(BLEU_ORDERS)))


def bleu_counts(pairs: DataFrame) -> DataFrame:
    """Add the clipped matches ``match_1..4``, the candidate's n-gram counts
    ``total_1..4`` and the lengths ``c_len``, ``r_len`` of token arrays
    ``candidate`` and ``reference``."""
    matched = pairs.withColumn(
        "_matches", arrow_udf(_clipped, "array<bigint>")("candidate", "reference")
    )
    return matched.select(
        *pairs.columns,
        *[F.get("_matches", F.lit(n - 1)).alias(f"match_{n}") for n in BLEU_ORDERS],
        *[
            F.greatest(F.size("candidate") - (n - 1), F.lit(0)).cast("bigint").alias(f"total_{n}")
            for n in BLEU_ORDERS
        ],
        F.size("candidate").cast("bigint").alias("c_len"),
        F.size("reference").cast("bigint").alias("r_len"),
    )


def bleu_score() -> Column:
    """BLEU from the columns of ``bleu_counts`` (or their sums).

    Without smoothing, an order without a match gives 0. (The scorer the
    reference calls puts the smallest positive number for such an order, which
    leaves a score next to 0.)
    """
    none = F.lit(False)
    logs = F.lit(0.0)
    for n in BLEU_ORDERS:
        match, total = F.col(f"match_{n}"), F.col(f"total_{n}")
        none = none | (match == 0)
        logs = logs + F.log(F.nullif(match, F.lit(0)) / F.greatest(total, F.lit(1)))
    ratio = F.col("r_len") / F.nullif(F.col("c_len"), F.lit(0))
    brevity = F.when(F.col("c_len") > F.col("r_len"), F.lit(1.0)).otherwise(F.exp(1 - ratio))
    return F.when(none, F.lit(0.0)).otherwise(brevity * F.exp(logs / len(BLEU_ORDERS)))


def bleu_sentence(pairs: DataFrame) -> DataFrame:
    counts = bleu_counts(pairs)
    return counts.withColumn("bleu", bleu_score()).select(*pairs.columns, "bleu")


def bleu_corpus(pairs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """BLEU of all pairs together: counts and lengths are added up first."""
    sums = [f"{kind}_{n}" for kind in ("match", "total") for n in BLEU_ORDERS] + ["c_len", "r_len"]
    return (
        bleu_counts(pairs)
        .groupBy(*(by or []))
        .agg(F.count(F.lit(1)).alias("pairs"), *[F.sum(name).alias(name) for name in sums])
        .withColumn("bleu", bleu_score())
    )


# --- METEOR ----------------------------------------------------------------------


def _stages(*forms: pa.Array) -> pa.Array:
    """One stage for each pair of forms."""
    return rows_of(matches_and_chunks(list(zip(forms[::2], forms[1::2]))))


def canonical_tokens(
    pairs: DataFrame, key: str, columns: dict[str, str], canonical: DataFrame
) -> DataFrame:
    """Add, for each of ``columns`` (output to input), the tokens as the table ``(token,
    canonical)`` maps them, themselves where it does not. ``key`` identifies a row.

    A token is one row for each text that has it: its places travel as an array, and the
    planner broadcasts the table or splits what is left of the skew.
    """
    outputs = list(columns)
    sides = F.array(
        *[F.struct(F.lit(i).alias("side"), F.col(columns[o]).alias("tokens")) for i, o in enumerate(outputs)]
    )
    places = (
        pairs.select(key, F.inline(sides))
        .select(key, "side", F.posexplode("tokens").alias("pos", "token"))
        .groupBy(key, "side", F.lower("token").alias("token"))
        .agg(F.collect_list("pos").alias("places"))
    )
    named = places.join(canonical, "token", "left").select(
        key, "side", F.explode("places").alias("pos"), F.coalesce("canonical", "token").alias("token")
    )
    mapped = named.groupBy(key).agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("side") == i, F.struct("pos", "token")))).alias(o)
            for i, o in enumerate(outputs)
        ]
    ).select(key, *[F.col(f"{o}.token").alias(o) for o in outputs])
    empty = F.array().cast("array<string>")
    joined = pairs.join(mapped, key, "left")
    return joined.withColumns({o: F.coalesce(o, empty) for o in outputs})


def meteor(
    pairs: DataFrame,
    canonical: DataFrame | None = None,
    key: str = "pair_id",
    stems: bool = False,
) -> DataFrame:
    """Add ``matches``, ``chunks`` and ``meteor`` for token arrays ``candidate``
    and ``reference``, compared in lower case.

    The exact stage always runs. With ``stems``, a second stage matches what is left by
    stems; with a table ``(token, canonical)`` of unique tokens, the last stage matches what
    is still left by its canonical form (one name for a set of synonyms). Stems are
    made in place, without a shuffle.
    """
    lower = pairs.withColumns(
        {
            "_c": F.transform("candidate", F.lower),
            "_r": F.transform("reference", F.lower),
        }
    )
    forms = ["_c", "_r"]
    if stems:
        lower = lower.withColumns({"_cs": stemmed("_c"), "_rs": stemmed("_r")})
        forms += ["_cs", "_rs"]
    if canonical is not None:
        lower = canonical_tokens(lower, key, {"_cc": "_c", "_rc": "_r"}, canonical)
        forms += ["_cc", "_rc"]
    counted = lower.withColumn("_counts", arrow_udf(_stages, "array<bigint>")(*forms)).select(
        *pairs.columns,
        F.get("_counts", F.lit(0)).alias("matches"),
        F.get("_counts", F.lit(1)).alias("chunks"),
    )
    m = F.nullif(F.col("matches"), F.lit(0))
    precision, recall = m / F.size("candidate"), m / F.size("reference")
    mean = precision * recall / (METEOR_ALPHA * precision + (1 - METEOR_ALPHA) * recall)
    penalty = METEOR_GAMMA * F.pow(F.col("chunks") / m, F.lit(METEOR_BETA))
    return counted.withColumn("meteor", F.coalesce(mean * (1 - penalty), F.lit(0.0)))


# --- BERTScore -------------------------------------------------------------------

_BEST_SCHEMA = (
    "pair_id bigint, c_block bigint, r_block bigint, c_best array<double>, r_best array<double>"
)


def _units(vectors: pa.Array) -> np.ndarray:
    """Vectors of a block as rows of length 1 (a zero vector stays zero)."""
    rows = len(vectors)
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    matrix = flat.reshape(rows, -1)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _best_cosines(batches):
    for batch in batches:
        best_c, best_r = [], []
        candidates, references = batch.column("c_vecs"), batch.column("r_vecs")
        for i in range(batch.num_rows):
            cosines = _units(candidates[i].values) @ _units(references[i].values).T
            best_c.append(cosines.max(axis=1))
            best_r.append(cosines.max(axis=0))
        yield pa.RecordBatch.from_arrays(
            [
                *[batch.column(name) for name in ("pair_id", "c_block", "r_block")],
                pa.array(best_c, pa.list_(pa.float64())),
                pa.array(best_r, pa.list_(pa.float64())),
            ],
            names=["pair_id", "c_block", "r_block", "c_best", "r_best"],
        )


def bert_score(vectors: DataFrame) -> DataFrame:
    """Precision, recall and F1 of each pair from the token vectors
    ``pair_id, side ("candidate" or "reference"), pos, vec``.

    Vectors travel in blocks of 512 positions, the most an encoder of this
    family takes, so a pair of sentences is one block a side and one product of
    two matrices. Longer sides are compared block by block and only the best
    cosine of each vector leaves a task. A pair with an empty side scores 0.
    """
    blocks = (
        vectors.withColumn("block", int_div(F.col("pos"), VECTOR_BLOCK))
        .groupBy("pair_id", "side", "block")
        .agg(F.sort_array(F.collect_list(F.struct("pos", "vec"))).alias("vecs"))
        .withColumn("vecs", F.col("vecs.vec"))
    )

    def side(name: str, short: str) -> DataFrame:
        return blocks.where(F.col("side") == name).select(
            "pair_id", F.col("block").alias(f"{short}_block"), F.col("vecs").alias(f"{short}_vecs")
        )

    best = (
        side("candidate", "c")
        .join(side("reference", "r"), "pair_id")
        .mapInArrow(_best_cosines, _BEST_SCHEMA)
    )
    # best of each vector over the blocks of the other side, then the mean
    sided = best.select(
        "pair_id",
        F.explode(
            F.array(
                F.struct(
                    F.lit("p").alias("kind"), F.col("c_block").alias("block"), F.col("c_best").alias("best")
                ),
                F.struct(
                    F.lit("r").alias("kind"), F.col("r_block").alias("block"), F.col("r_best").alias("best")
                ),
            )
        ).alias("s"),
    )
    per_block = (
        sided.select("pair_id", "s.kind", "s.block", F.posexplode("s.best").alias("i", "best"))
        .groupBy("pair_id", "kind", "block", "i")
        .agg(F.max("best").alias("best"))
    )
    scored = per_block.groupBy("pair_id").agg(
        F.avg(F.when(F.col("kind") == "p", F.col("best"))).alias("precision"),
        F.avg(F.when(F.col("kind") == "r", F.col("best"))).alias("recall"),
    )
    pairs = vectors.select("pair_id").distinct()
    total = F.col("precision") + F.col("recall")
    return (
        pairs.join(scored, "pair_id", "left")
        .na.fill(0.0, ["precision", "recall"])
        .withColumn(
            "f1",
            F.when(total == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / total),
        )
    )


def bert_score_mean(scores: DataFrame) -> DataFrame:
    """Means over the pairs; the F1 is the mean of F1, not the F1 of the means."""
    return scores.agg(
        F.avg("precision").alias("bert_precision"),
        F.avg("recall").alias("bert_recall"),
        F.avg("f1").alias("bert_f1"),
    )


# --- from scores to text ---------------------------------------------------------


def decode_predictions(ids: DataFrame, tokenizer, key: str = "pair_id") -> DataFrame:
    """Text of each ``key`` from one id per position (``pos``, ``id``)."""
    return (
        ids.groupBy(key)
        .agg(F.sort_array(F.collect_list(F.struct("pos", "id"))).alias("_ids"))
        .select(key, tokenizer.decode(F.col("_ids.id")).alias("text"))
    )
