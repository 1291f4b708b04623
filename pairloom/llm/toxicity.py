"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are single words, pairs of neighbours and pairs with one word between them,
lower-cased and hashed. Features are extracted on all executors; learning goes over
the training rows, a bounded sample, in a fixed order, with a rate for each
coordinate and L1 regularisation. L1 leaves few weights other than zero: these are
the model, and the table they fill has a fixed size.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.samples import MAX_SAMPLE, crc_of_key, one_of_each, sample_rows
from pairloom.llm.spans import Words, byte_hashes, lower_ascii, mix, text_bytes
from pairloom.llm.tables import map_texts

BITS = 20
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.1
EPOCHS = 6
MIN_ROWS = 3  # of the training rows that have a feature
THRESHOLD = 0.3
SEED = 6
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


@dataclass(frozen=True)
class Weights:
    """Weights other than zero, and the bias."""

    features: np.ndarray
    weights: np.ndarray
    bias: float

    def table(self) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.features] = self.weights
        return table


def alphanumeric_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Hash and text of each run of letters and digits, ASCII lower-cased."""
    buf, offsets = text_bytes(texts)
    solid = np.zeros(len(buf) + 2, bool)
    solid[1:-1] = _WORD[buf]
    inside = solid[1:-1]
    starts_text = np.zeros(len(buf) + 1, bool)
    starts_text[offsets[:-1]] = True
    begins = inside & (~solid[:-2] | starts_text[:-1])
    finishes = inside & (~solid[2:] | starts_text[1:])
    if len(buf):
        finishes[-1] = inside[-1]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(finishes) + 1
    doc = np.searchsorted(offsets, starts, "right") - 1
    return byte_hashes(lower_ascii(buf), starts, ends), doc, len(offsets) - 1


def features(hashes: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(text, feature)`` arrays: words, neighbours, pairs with one word between."""
    shift = np.uint64(64 - BITS)
    out = [(doc, (mix(hashes) >> shift).astype(np.int32))]
    for gap in (1, 2):
        if len(hashes) > gap:
            same = doc[:-gap] == doc[gap:]
            pair = mix(hashes[:-gap] + np.uint64(2 * gap + 1) * mix(hashes[gap:]))
            out.append((doc[:-gap][same], (pair >> shift).astype(np.int32)[same]))
    return out


def feature_lists(texts: pa.Array) -> list[np.ndarray]:
    """The distinct features of each text."""
    hashes, doc, n = alphanumeric_words(texts)
    keys = np.unique(
        np.concatenate([d.astype(np.int64) << BITS | f for d, f in features(hashes, doc)])
    )
    cuts = np.searchsorted(keys, np.arange(1, n) << BITS)
    return np.split((keys & ((1 << BITS) - 1)).astype(np.int32), cuts)


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> Weights:
    """FTRL-proximal over the rows, in their order, ``epochs`` times."""
    seen = np.bincount(np.concatenate([*rows, np.zeros(0, np.int64)]), minlength=1 << BITS)
    rows = [r[seen[r] >= MIN_ROWS] for r in rows]
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    rows = [np.append(r, 1 << BITS) for r in rows]  # the bias is the last coordinate

    def weights(at: np.ndarray) -> np.ndarray:
        zi = z[at]
        l1 = np.where(at == 1 << BITS, 0.0, L1)
        w = -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2)
        return np.where(np.abs(zi) <= l1, 0.0, w)

    for _ in range(epochs):
        for at, label in zip(rows, labels):
            w = weights(at)
            p = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30)))
            g = p - label
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    every = np.flatnonzero(np.abs(z[:-1]) > L1)
    return Weights(every, weights(every), float(weights(np.array([1 << BITS]))[0]))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_SAMPLE) -> Weights:
    """Learn from at most ``limit`` labelled rows outside the held-out fold.

    Without labels all weights are zero.
    """
    usable = labels.where("doc_id is not null and toxic is not null").where(
        crc_of_key("doc_id") % 4 != 2
    )
    chosen = sample_rows(usable.select("doc_id", "toxic"), "doc_id", SEED, limit).dropDuplicates(["doc_id"])
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).join(F.broadcast(chosen), "doc_id")
    schema = "doc_id bigint, label int, digest bigint, features array<int>"

    def extract(texts, others):
        found = feature_lists(texts)
        cuts = np.cumsum([0, *map(len, found)])
        flat = np.concatenate([*found, np.zeros(0, np.int32)])
        return {
            "doc_id": others[0],
            "label": others[1],
            "digest": others[2],
            "features": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(flat, pa.int32())),
        }

    extracted = map_texts(rows, ["text", "doc_id", "toxic", "digest"], schema, extract)

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by("doc_id")
        order = np.random.default_rng(SEED).permutation(len(table))
        values = table["features"].combine_chunks()
        lists = [np.asarray(values[int(i)].values) for i in order]
        model = train(lists, table["label"].to_numpy()[order].astype(float))
        return pa.table(
            {
                "feature": pa.array([*model.features.tolist(), -1], pa.int64()),
                "weight": pa.array([*model.weights.tolist(), model.bias], pa.float64()),
            }
        )

    learned = (
        one_of_each(extracted, "doc_id", "digest")
        .groupBy(F.lit(0).alias("all"))  # at most ``limit`` rows
        .applyInArrow(learn, "feature bigint, weight double")
    )
    rows = learned.toPandas()
    kept = rows[rows["feature"] >= 0]
    bias = rows["weight"][rows["feature"] < 0].sum()
    return Weights(kept["feature"].to_numpy(np.int64), kept["weight"].to_numpy(), float(bias))


def score_texts(texts: pa.Array, table: np.ndarray, bias: float) -> np.ndarray:
    hashes, doc, n = alphanumeric_words(texts)
    keys = []
    for d, f in features(hashes, doc):
        live = table[f] != 0
        keys.append(d[live].astype(np.int64) << BITS | f[live])
    keys = np.unique(np.concatenate(keys))
    sums = np.bincount(keys >> BITS, table[keys & ((1 << BITS) - 1)], n)
    return 1 / (1 + np.exp(-np.clip(sums + bias, -30, 30)))


def scores(docs: DataFrame, model: Weights) -> DataFrame:
    """``doc_id, score`` of every text; null and empty texts have the score of the bias."""
    # plain values: workers need not have this package
    broadcast = docs.sparkSession.sparkContext.broadcast(
        (model.features, model.weights, model.bias)
    )

    def run(texts, others):
        sent = Weights(*broadcast.value)
        return {"doc_id": others[0], "score": score_texts(texts, sent.table(), sent.bias)}

    return map_texts(docs, ["text", "doc_id"], "doc_id bigint, score double", run)


def predict(docs: DataFrame, labels: DataFrame, limit: int = MAX_SAMPLE) -> DataFrame:
    """Fit outside the held-out fold and score every row."""
    return scores(docs, fit(docs, labels, limit)).select(
        "doc_id",
        (crc_of_key("doc_id") % 4 == 2).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
