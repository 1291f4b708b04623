"""Learned merges against a plain learner, the tokeniser, and the table function."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairloom.operators import segment, subwords
from pairloom.operators.segment_function import SegmentTokens
from pairloom.operators.subwords import SubwordTokenizer, independent, learn_merges


def plain_merges(counts, merges):
    """One merge at a time: the most frequent pair, on ties the smallest."""
    words = {tuple(w.encode().decode("latin-1")): n for w, n in counts.items()}
    learned = []
    while len(learned) < merges:
        pairs = Counter()
        for word, n in words.items():
            for pair in zip(word, word[1:]):
                pairs[pair] += n
        pairs = {p: n for p, n in pairs.items() if n >= 2}
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        learned.append((*best, pairs[best]))
        merged = Counter()
        for word, n in words.items():
            out, at = [], 0
            while at < len(word):
                if word[at : at + 2] == best:
                    out.append(word[at] + word[at + 1])
                    at += 2
                else:
                    out.append(word[at])
                    at += 1
            merged[tuple(out)] += n
        words = merged
    return learned


@pytest.mark.parametrize("letters, n, seed", [("ab", 30, 1), ("abcdé한", 60, 2), ("abcdefghijklmnop", 40, 3)])
def test_merges_are_those_of_a_plain_learner(spark, letters, n, seed):
    """Few letters and small counts give many ties and pairs of equal symbols."""
    rng = random.Random(seed)
    counts = {}
    for _ in range(n):
        counts["".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))] = rng.randint(1, 4)
    df = spark.createDataFrame(list(counts.items()), "chunk string, n bigint").repartition(3)
    assert learn_merges(df, 12) == plain_merges(counts, 12)


def test_merges_of_an_empty_corpus(spark):
    empty = spark.createDataFrame([], "chunk string, n bigint")
    assert learn_merges(empty, 5) == [] == learn_merges(spark.createDataFrame([("a", 9)], "chunk string, n bigint"), 5)


def test_independent_merges():
    ranked = [("a", "b", 9), ("c", "d", 9), ("e", "f", 8), ("b", "g", 7), ("h", "i", 7)]
    assert independent(ranked, 10) == [("a", "b"), ("c", "d"), ("e", "f")]
    assert independent(ranked, 2) == [("a", "b"), ("c", "d")]
    assert independent(ranked[:2] + [("b", "d", 9)], 10) == [("a", "b")]  # a new pair may be as frequent
    assert independent([], 3) == []


def test_subword_tokenizer(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab é한.\n7") for _ in range(rng.randint(0, 60))) for _ in range(80)] + [None, "", " ", "new 🙂 signs"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string").repartition(3)
    merges = learn_merges(subwords.count_chunks(df, "text"), 30)
    tokenizer = SubwordTokenizer(merges)
    rows = df.select("id", tokenizer.encode(F.col("text")).alias("ids"), tokenizer.count(F.col("text")).alias("n")).withColumn(
        "back", tokenizer.decode(F.col("ids"))
    ).collect()
    assert {r["id"]: r["back"] for r in rows} == dict(enumerate(texts))
    some = [r for r in rows if r["ids"]]
    assert all(r["n"] == len(r["ids"]) for r in some)
    n_bytes = sum(len(texts[r["id"]].encode()) for r in some)
    assert sum(len(r["ids"]) for r in some) < 0.8 * n_bytes and max(max(r["ids"]) for r in some) >= 259


@pytest.mark.parametrize("marker_at, max_len", [("first", None), ("last", None), ("first", 3), ("last", 2)])
def test_table_function_is_segmentation(spark, marker_at, max_len):
    rng = random.Random(6)
    rows, at = [], {}
    for shard in range(3):
        for side in ("src", "tgt"):
            stream = [rng.choice([1, 5, 6, 7]) for _ in range(200)]
            cuts = sorted(rng.sample(range(1, 200), 9))
            for a, b in zip([0, *cuts], [*cuts, 200]):
                rows.append((shard, side, a, stream[a:b]))
            at[shard, side] = stream
    runs = spark.createDataFrame(rows, "shard_idx bigint, side string, pos bigint, tokens array<int>").repartition(4)
    runs.createOrReplaceTempView("token_runs")
    spark.udtf.register("segment_tokens", SegmentTokens)
    limit = "NULL" if max_len is None else max_len
    found = spark.sql(
        f"SELECT * FROM segment_tokens(TABLE(token_runs), marker => 1, marker_at => '{marker_at}', max_len => {limit})"
    )
    got = {(r["shard_idx"], r["seq_id"], r["side"]): r["tokens"] for r in found.collect()}
    want = {}
    for r in segment.sequences(runs, 1, marker_at, max_len, strict=False).collect():
        want[r["shard_idx"], r["seq_id"], "src"] = r["source"]
        want[r["shard_idx"], r["seq_id"], "tgt"] = r["target"]
    assert {k: v for k, v in got.items() if k in want} == want
    for (shard, side), stream in at.items():  # all sequences of a side, also those the other lacks
        assert sum(k[0] == shard and k[2] == side for k in got) == stream.count(1)
