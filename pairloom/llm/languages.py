"""Language proportions of texts by expectation-maximisation over n-gram likelihoods.

A model has, for each language, smoothed log probabilities of hashed byte n-grams.
The likelihood of a word in a language is that of the n-grams that begin in it or
in the space before it. A text is a mixture of languages, one for each word: EM
estimates the proportions. Nested sets of languages, in order of their proportions,
are then fitted again, and the set with the highest likelihood less a penalty for
each language is chosen. The language predicted is the largest part of that set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.samples import MAX_SAMPLE, crc_of_key, one_of_each, sample_rows
from pairloom.llm.spans import Words, lower_ascii, ranges, slices, words_of, worker_cache
from pairloom.llm.tables import free_name, map_texts, record_batch

UNKNOWN = "und"  # fixed value
ORDERS = (2, 4)
BUCKETS = 1 << 16  # of hashed n-grams, all orders together
CELLS = 1 << 21  # words x languages at once; a longer text is looked at by itself
SMOOTHING = 0.5
WORD_SPREAD = 12.0  # the likelihoods of one word differ by this at most
STEPS = 8
PENALTY = 1.5  # for each language after the first, in units of log(words)
SEED = 1
COUNTS = "lang string, bucket int, n bigint"


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log_p: np.ndarray  # BUCKETS x languages


def _grams(words) -> list[tuple[np.ndarray, np.ndarray]]:
    """``(word, bucket)`` of the n-grams of each word, for each order.

    A word has one space before and two behind, so that it has some of each order;
    they stand in the order of words.
    """
    buf = lower_ascii(words.buf)
    inner = words.ends - words.starts
    n = inner + 3
    text = np.full(int(n.sum()), 32, np.uint64)
    text[ranges(np.cumsum(n) - n + 1, inner)] = buf[ranges(words.starts, inner)]
    word = np.repeat(np.arange(len(n)), n)
    out = []
    for order in ORDERS:
        size = max(0, len(text) - order + 1)
        ok = word[:size] == word[len(word) - size :]
        key = np.full(size, order, np.uint64)
        for k in range(order):
            key = key << np.uint64(8) | text[k : k + size]
        key = key[ok] * np.uint64(0x9E3779B97F4A7C15)
        out.append((word[:size][ok], (key >> np.uint64(64 - 16)).astype(np.int64)))
    return out


def count_grams(rows: DataFrame) -> DataFrame:
    """n-gram counts by language of rows ``text, lang``, summed in each slice first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in slices(batch.column(0)):
                words = words_of(texts)
                word, bucket = map(np.concatenate, zip(*_grams(words)))
                coded = batch.column(1).slice(at, len(texts)).dictionary_encode()
                of_doc = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
                keys, n = np.unique(
                    of_doc[words.doc[word]] * BUCKETS + bucket, return_counts=True
                )
                yield record_batch(
                    COUNTS,
                    {
                        "lang": coded.dictionary.take(pa.array(keys // BUCKETS)),
                        "bucket": keys % BUCKETS,
                        "n": n,
                    },
                )

    counted = rows.select("text", "lang").mapInArrow(run, COUNTS)
    return counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, limit: int = MAX_SAMPLE) -> Model:
    """Fit on at most ``limit`` of the keys with a language outside the held-out fold.

    A key that is repeated gives one row, that with the smallest digest of its text. There are
    no more languages than sampled rows, and the counts are collected: at most
    ``BUCKETS`` for each language, and no more than n-grams in the sample.
    """
    rows = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc_of_key("doc_id") % 5 != 0)
    )
    chosen = sample_rows(rows.select("doc_id"), "doc_id", SEED, limit).dropDuplicates()
    sample = rows.select("doc_id", "text", "lang").join(F.broadcast(chosen), "doc_id")
    sample = one_of_each(sample.withColumn("digest", F.xxhash64("text", "lang")), "doc_id", "digest")
    found = count_grams(sample).toPandas()
    languages = tuple(sorted(found["lang"].unique()))
    table = np.full((BUCKETS, len(languages)), SMOOTHING, np.float32)
    at = {name: i for i, name in enumerate(languages)}
    table[found["bucket"].to_numpy(int), found["lang"].map(at).to_numpy(int)] += found["n"].to_numpy(np.float32)
    table /= table.sum(0, dtype=np.float64).astype(np.float32)
    return Model(languages, np.log(table, out=table))


def _mixture(p: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each text over the languages of ``p``."""
    sizes = np.diff(bounds)
    some = sizes > 0  # texts without words keep equal shares
    firsts = bounds[:-1][some]
    n = p.shape[1]
    share = np.full((len(sizes), n), 1 / n, np.float32)
    likelihood = np.zeros(len(sizes))
    if not len(p):
        return share, likelihood
    for step in range(STEPS + 1):
        joint = np.repeat(share, sizes, axis=0)
        joint *= p
        total = np.maximum(joint.sum(1), np.float32(1e-30))
        if step == STEPS or n == 1:
            likelihood[some] = np.add.reduceat(np.log(total, dtype=np.float64), firsts)
            return share, likelihood
        joint /= total[:, None]
        share[some] = np.add.reduceat(joint, firsts, axis=0) / sizes[some, None]
        share /= np.maximum(share.sum(1, keepdims=True), np.float32(1e-30))


def _likelihoods(model: Model, words: Words) -> np.ndarray:
    """Likelihood of each word in each language, as a part of that in its likeliest one."""
    log_p = np.zeros((len(words.starts), len(model.languages)), np.float32)
    if len(log_p):
        for word, bucket in _grams(words):
            firsts = np.searchsorted(word, np.arange(len(log_p)))
            log_p += np.add.reduceat(model.log_p[bucket], firsts, axis=0)
    log_p -= log_p.max(1, keepdims=True)
    return np.exp(np.maximum(log_p, -WORD_SPREAD, out=log_p), out=log_p)


def _infer(model: Model, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Number of the language and score of each text."""
    n_docs, n_lang = len(words.bounds) - 1, len(model.languages)
    p = _likelihoods(model, words)
    counts = np.diff(words.bounds)
    full, most = _mixture(p, words.bounds)
    order = np.argsort(-full, axis=1, kind="stable")
    best = np.full(n_docs, -np.inf)
    at = np.zeros(n_docs, np.int64)
    left = np.arange(n_docs)
    for size in range(1, n_lang + 1):
        # no set is likelier than all languages: texts whose best cannot be passed are done
        cost = PENALTY * (size - 1) * np.log(np.maximum(counts, 2))
        left = left[most[left] - cost[left] > best[left]]
        if not len(left):
            break
        chosen = np.sort(order[left, :size], axis=1)
        sizes = counts[left]
        rows = ranges(words.bounds[left], sizes)
        own = p[rows[:, None], np.repeat(chosen, sizes, axis=0)]
        share, likelihood = _mixture(own, np.concatenate([[0], np.cumsum(sizes)]))
        better = likelihood - cost[left] > best[left]
        best[left[better]] = (likelihood - cost[left])[better]
        at[left[better]] = chosen[better, share[better].argmax(1)]
    score = np.clip(full[np.arange(n_docs), at], 0.0, 1.0)
    return at, np.where(counts > 0, score, 0.0)


def infer(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; texts without words give ``UNKNOWN``.

    The score is the proportion of the predicted language among all languages. Texts are
    taken in blocks of ``CELLS`` words x languages.
    """
    words = words_of(texts)
    n_docs, n_lang = len(words.bounds) - 1, len(model.languages)
    names, scores = [UNKNOWN] * n_docs, np.zeros(n_docs)
    low = 0
    while n_lang and low < n_docs:
        limit = words.bounds[low] + max(1, CELLS // n_lang)
        high = max(low + 1, int(np.searchsorted(words.bounds, limit, "right")) - 1)
        at, scores[low:high] = _infer(model, words.of_texts(low, high))
        for i, k in zip(range(low, high), at.tolist()):
            if words.bounds[i] < words.bounds[i + 1]:
                names[i] = model.languages[k]
        low = high
    return names, scores


def identify(docs: DataFrame, model: Model, keep: list[str], language: str = "lang_pred", score: str = "score") -> DataFrame:
    """Columns ``keep`` with the language and its score of every text.

    Texts that are null or have no letter are ``UNKNOWN`` with score 0.
    """
    # plain values: workers need not have this package
    broadcast = docs.sparkSession.sparkContext.broadcast((model.languages, model.log_p))
    types = dict(docs.dtypes)
    kept = [(f"k{i}", types[c]) for i, c in enumerate(keep)]
    schema = ",".join([f"{c} {t}" for c, t in kept] + ["lang string", "score double"])

    def run(texts, others):
        worker_cache(None)
        names, scores = infer(Model(*broadcast.value), texts)
        lettered = pa.compute.fill_null(others[0], False).to_numpy(zero_copy_only=False)
        for i in np.flatnonzero(~lettered).tolist():
            names[i], scores[i] = UNKNOWN, 0.0
        return {"lang": names, "score": scores} | {c: v for (c, _), v in zip(kept, others[1:])}

    found = map_texts(docs, ["text", F.col("text").rlike(r"\p{L}"), *keep], schema, run)
    return found.select(
        *[F.col(c).alias(name) for (c, _), name in zip(kept, keep)],
        F.col("lang").alias(language),
        F.col("score").alias(score),
    )


def predict(docs: DataFrame, limit: int = MAX_SAMPLE) -> DataFrame:
    """Fit outside the held-out fold and predict every row."""
    found = identify(docs, fit(docs, limit), ["doc_id"])
    return found.select(
        "doc_id", (crc_of_key("doc_id") % 5 == 0).alias("held_out"), "lang_pred", "score"
    )


MIN_SCORE = 0.4


def keep_known(docs: DataFrame, min_score: float = MIN_SCORE) -> DataFrame:
    """Documents with a language that makes up at least ``min_score``, all columns unchanged."""
    language, score = free_name(docs, "lang_pred"), free_name(docs, "lang_score")
    found = identify(docs, fit(docs), docs.columns, language, score)
    return found.where((F.col(language) != UNKNOWN) & (F.col(score) >= min_score)).select(
        *docs.columns
    )
