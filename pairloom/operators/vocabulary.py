"""Word vocabularies of any size, as tables that texts are joined with."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.functions.tokenizers import FIRST_ID, UNK_ID, count_words, word_tokens
from pairloom.operators.prefix import number_rows


def build_vocabulary(texts: DataFrame, column: str) -> DataFrame:
    """``token, n, id`` of all words, ids from 3 by falling count, then word."""
    counted = count_words(texts, column).withColumn("_rarity", -F.col("n"))
    numbered = number_rows(counted, ["_rarity", "token"], "_number")
    return numbered.select("token", "n", (F.col("_number") + FIRST_ID).alias("id"))


def encode_words(
    texts: DataFrame, keys: Sequence[str], columns: dict[str, str], vocabulary: DataFrame
) -> DataFrame:
    """``keys`` (unique) and an array of ids for each text of ``columns`` (output to input).

    Words move to their ids and back to their text. A frequent word is one row for each
    text that has it: its places travel as an array, and the planner splits or
    broadcasts what is left of the skew.
    """
    outputs = list(columns)
    sides = F.array(*[F.struct(F.lit(i).alias("side"), F.col(columns[o]).alias("text")) for i, o in enumerate(outputs)])
    words = (
        texts.select(*keys, F.inline(sides))
        .select(*keys, "side", F.posexplode(word_tokens(F.col("text"))).alias("pos", "token"))
        .groupBy(*keys, "side", "token")
        .agg(F.collect_list("pos").alias("places"))
    )
    known = words.join(vocabulary.select("token", "id"), "token", "left").select(
        *keys,
        "side",
        F.explode("places").alias("pos"),
        F.coalesce("id", F.lit(UNK_ID).cast("bigint")).alias("id"),
    )
    ids = known.groupBy(*keys).agg(
        *[
            F.sort_array(F.collect_list(F.when(F.col("side") == i, F.struct("pos", "id")))).alias(o)
            for i, o in enumerate(outputs)
        ]
    )
    nothing = F.array().cast("array<bigint>")
    return texts.select(*keys).join(ids, list(keys), "left").select(
        *keys, *[F.coalesce(F.col(f"{o}.id"), nothing).alias(o) for o in outputs]
    )


def decode_words(
    ids: DataFrame, keys: Sequence[str], position: str, column: str, vocabulary: DataFrame
) -> DataFrame:
    """``keys`` and ``text``: the words of the ids in order, unknown ids left out."""
    named = ids.join(
        vocabulary.select(F.col("id").alias(column), "token"), column, "left"
    )
    found = named.groupBy(*keys).agg(
        F.sort_array(
            F.collect_list(F.when(F.col("token").isNotNull(), F.struct(position, "token")))
        ).alias("_words")
    )
    return found.select(*keys, F.array_join("_words.token", " ").alias("text"))
