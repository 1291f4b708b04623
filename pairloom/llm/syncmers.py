"""Document fingerprints of closed syncmers, in DataFrame functions alone.

A text is a sequence of words (a long one in pieces of ``PIECE`` characters), with ``K - 1``
marks before and behind it, so that the shortest text has anchors by the same rule. Of its
runs of ``K`` words those are anchors whose smallest inner run of ``S`` words, by
hash, lies at an edge: the choice needs no context. An element of a fingerprint is
an anchor with the distance from the anchor before it, so that elements match where
the same anchors follow each other at the same places. Likeness is the part of the
larger fingerprint that both have. A text without words has no elements.

The next document is found on keys and digests alone. It sends its elements and the
characters that are asked for to the document before it; texts move once, and both joins
with them read the same exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.operators.prefix import number_rows
from pairloom.session import materialise

K, S = 6, 2
PIECE = 16
IDENTITY = ["key", "none", "digest"]


def marks(side: str) -> Column:
    """Hashes that stand for the words before or behind a text; no word has white space."""
    return F.array(*[F.xxhash64(F.lit(f"\n{side}{i}")) for i in range(K - 1)])


def held(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that the optimiser cannot put into the expressions that read them.

    A lambda that reads an array would otherwise compute it for every element.
    """
    rows = F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))
    return df.select("*", F.inline(rows))


def with_elements(df: DataFrame, texts: list[str]) -> DataFrame:
    """Add the elements of each text column ``x`` as ``x_el`` (distinct, in text order)."""
    words = rf"[^\x20\x09-\x0D]{{1,{PIECE}}}"
    df = held(
        df,
        {
            f"{x}_h": F.transform(F.regexp_extract_all(x, F.lit(words), F.lit(0)), lambda w: F.xxhash64(w))
            for x in texts
        },
    )
    # a text without words stays without
    df = held(
        df.withColumnsRenamed({f"{x}_h": f"{x}_w" for x in texts}),
        {
            f"{x}_h": F.when(F.size(f"{x}_w") > 0, F.concat(marks("<"), F.col(f"{x}_w"), marks(">")))
            .otherwise(F.col(f"{x}_w"))
            for x in texts
        },
    )

    def runs(x: str) -> Column:
        h = F.col(f"{x}_h")
        return F.transform(
            F.sequence(F.lit(0), F.greatest(F.size(h) - S, F.lit(0))),
            lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(S)]),
        )

    df = held(df, {f"{x}_g": runs(x) for x in texts})

    def anchors(x: str) -> Column:
        g, n = F.col(f"{x}_g"), F.size(f"{x}_h")
        last = K - S

        def at_edge(i: Column) -> Column:
            inner = F.least(*[F.get(g, i + k) for k in range(1, last)])
            return F.least(F.get(g, i), F.get(g, i + last)) <= inner

        return F.filter(F.sequence(F.lit(0), F.greatest(n - K, F.lit(0))), at_edge)

    df = held(df, {f"{x}_at": anchors(x) for x in texts})

    def elements(x: str) -> Column:
        h, at = F.col(f"{x}_h"), F.col(f"{x}_at")
        chosen = F.transform(
            at,
            lambda p, j: F.hash(
                F.slice(h, p + 1, K), p - F.coalesce(F.when(j > 0, F.get(at, j - 1)), p)
            ),
        )
        return F.array_distinct(chosen)

    df = held(df, {f"{x}_el": elements(x) for x in texts})
    return df.drop(*[f"{x}_{part}" for x in texts for part in ("w", "h", "g", "at")])


def fingerprint(elements: str) -> Column:
    return F.array_join(F.col(elements).cast("array<string>"), " ")


def likeness(a: str, b: str) -> Column:
    """Shared elements by those of the larger fingerprint; 1 for two empty ones."""
    larger = F.greatest(F.size(a), F.size(b))
    return F.when(larger > 0, F.size(F.array_intersect(a, b)) / larger).otherwise(F.lit(1.0))


def followers(rows: DataFrame) -> DataFrame:
    """Identity of each document with that of the one before it (``p_…``) and its ``quarter``.

    In order of keys, null keys first, equal keys in the order of their digests; the first
    one follows the last one. Rows equal in key and text are one document.
    """
    each = rows.groupBy(*IDENTITY).agg(F.max(F.char_length("text")).alias("n_chars"))
    order = each.withColumn("has_key", ~F.col("none"))
    numbered = materialise(number_rows(order, ["has_key", "key", "digest"], "position"), "numbered")
    n = max(1, numbered.count())
    before = numbered.select(
        F.pmod(F.col("position") + 1, F.lit(n)).alias("position"),
        *[F.col(c).alias(f"p_{c}") for c in IDENTITY],
        (F.col("n_chars") / 4).cast("int").alias("quarter"),
    )
    found = numbered.select("position", *IDENTITY).join(before.hint("merge"), "position")
    return materialise(found.drop("position"), "followers")


def with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text``, ``head`` and ``next_el`` of every row.

    ``head`` are the first characters of the next document, as many as a quarter of the row's;
    ``next_el`` are the elements of the next document.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.coalesce(F.col(key), F.lit(0)).alias("key"),
        F.col(key).isNull().alias("none"),
        F.xxhash64(whole).alias("digest"),
        whole.alias("text"),
    )
    sent = rows.join(followers(rows).hint("merge"), IDENTITY)
    sent = with_elements(sent, ["text"]).select(
        *[F.col(f"p_{c}").alias(c) for c in IDENTITY],
        F.struct(F.expr("left(text, quarter)").alias("head"), F.col("text_el").alias("el")).alias("next"),
    )
    one = sent.groupBy(*IDENTITY).agg(F.any_value("next").alias("next"))
    return rows.join(one.hint("merge"), IDENTITY).select(
        F.when(~F.col("none"), F.col("key")).alias("doc_id"),
        "text",
        F.col("next.head").alias("head"),
        F.col("next.el").alias("next_el"),
    )


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses.

    Edited: the last quarter of the characters (rounded down) gives way to as many
    from the beginning of the next document. A null text is empty. Repeated rows give
    a row each, with the same result; other columns are not read. An empty table gives no rows.
    """
    n = F.char_length("text")
    quarter = (n / 4).cast("int")
    rows = with_next(docs, key, text).select(
        "doc_id",
        "text",
        "next_el",
        n.cast("bigint").alias("n_chars"),
        F.concat(F.left("text", n - quarter), F.col("head")).alias("edited"),
    )
    rows = with_elements(rows, ["text", "edited"])
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint("text_el").alias("fingerprint"),
        fingerprint("edited_el").alias("edited_fingerprint"),
        likeness("text_el", "edited_el").alias("near_edited"),
        likeness("text_el", "next_el").alias("near_next"),
    )
