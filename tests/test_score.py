import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions.stems import stem
from pairloom.functions.tokenizers import ByteTokenizer
from pairloom.operators import score

BLEU_CASES = [
    ("the cat sat on a mat", "the cat sat on the mat today", 0.4548),
    ("the dog and the cat", "the cat and the dog", 0.0),
]
METEOR_CASES = [
    ("the cat sat on a mat", "the cat sat on the mat today", 5, 3, 0.6464),
    ("the dog and the cat", "the cat and the dog", 5, 4, 0.7440),
]


def bleu(c, r):
    logs = []
    for n in range(1, 5):
        grams = [Counter(tuple(x[i : i + n]) for i in range(len(x) - n + 1)) for x in (c, r)]
        match = sum((grams[0] & grams[1]).values())
        if not match:
            return 0.0
        logs.append(math.log(match / max(1, len(c) - n + 1)))
    brevity = 1 if len(c) > len(r) else math.exp(1 - len(r) / len(c))
    return brevity * math.exp(sum(logs) / 4)


def meteor(c, r, canonical=None, stems=False):
    stages = [lambda t: t] + ([stem] if stems else []) + ([lambda t: canonical.get(t, t)] if canonical else [])
    left_c, left_r, matches = list(enumerate(c)), list(enumerate(r)), []
    for form in stages:
        for i in range(len(left_c) - 1, -1, -1):
            for j in range(len(left_r) - 1, -1, -1):
                if form(left_c[i][1].lower()) == form(left_r[j][1].lower()):
                    matches.append((left_c.pop(i)[0], left_r.pop(j)[0]))
                    break
    if not matches:
        return 0, 0, 0.0
    matches.sort()
    chunks = 1 + sum(
        not (b[0] == a[0] + 1 and b[1] == a[1] + 1) for a, b in zip(matches, matches[1:])
    )
    p, q = len(matches) / len(c), len(matches) / len(r)
    return len(matches), chunks, p * q / (0.9 * p + 0.1 * q) * (1 - 0.5 * (chunks / len(matches)) ** 3)


def table(spark, cases):
    rows = [(i, c, r) for i, (c, r) in enumerate(cases)]
    return spark.createDataFrame(rows, "pair_id bigint, candidate array<string>, reference array<string>")


@pytest.fixture(scope="module")
def random_cases():
    rng = random.Random(11)
    words = ["the", "The", "a", "cat", "dog", "sat", "run", "\x00"]
    cases = [
        ([rng.choice(words) for _ in range(rng.randint(0, 15))], [rng.choice(words) for _ in range(rng.randint(0, 15))])
        for _ in range(200)
    ]
    return cases + [([], []), (["a"], []), ([], ["a"])]


def test_known_bleu(spark):
    rows = score.bleu_sentence(table(spark, [(c.split(), r.split()) for c, r, _ in BLEU_CASES])).orderBy("pair_id")
    assert [round(r["bleu"], 4) for r in rows.collect()] == [b for *_, b in BLEU_CASES]


def test_known_meteor(spark):
    rows = score.meteor(table(spark, [(c.split(), r.split()) for c, r, *_ in METEOR_CASES])).orderBy("pair_id")
    got = [(r["matches"], r["chunks"], round(r["meteor"], 4)) for r in rows.collect()]
    assert got == [(m, k, s) for *_, m, k, s in METEOR_CASES]


def test_bleu_is_that_of_plain_python(spark, random_cases):
    rows = score.bleu_sentence(table(spark, random_cases).repartition(3)).collect()
    for r in rows:
        assert r["bleu"] == pytest.approx(bleu(*random_cases[r["pair_id"]]))


def test_corpus_bleu_adds_counts_first(spark, random_cases):
    (row,) = score.bleu_corpus(table(spark, random_cases)).collect()
    sums = score.bleu_counts(table(spark, random_cases)).groupBy().sum("match_2", "total_2").first()
    assert (row["match_2"], row["total_2"]) == tuple(sums)
    assert 0 < row["bleu"] < 1 and row["pairs"] == len(random_cases)


@pytest.mark.parametrize("canonical", [None, {"cat": "animal", "dog": "animal", "run": "sat"}])
def test_meteor_is_that_of_plain_python(spark, random_cases, canonical):
    lookup = canonical and spark.createDataFrame(list(canonical.items()), "token string, canonical string")
    rows = score.meteor(table(spark, random_cases).repartition(3), lookup).collect()
    assert len(rows) == len(random_cases)
    for r in rows:
        want = meteor(*random_cases[r["pair_id"]], canonical)
        assert (r["matches"], r["chunks"]) == want[:2]
        assert r["meteor"] == pytest.approx(want[2])


@pytest.mark.parametrize("canonical", [None, {"cat": "animal", "dogs": "animal", "hopping": "jump", "jumped": "jump"}])
def test_meteor_with_stems(spark, canonical):
    """Three stages at most; tokens that differ in their ending, in both sides and many times."""
    rng = random.Random(5)
    words = ["cats", "cat", "Hopping", "hop", "hoped", "dogs", "jumped", "relational", "relate", "the", "é", "hop."]
    cases = [([rng.choice(words) for _ in range(rng.randint(0, 12))], [rng.choice(words) for _ in range(rng.randint(0, 12))]) for _ in range(150)]
    lookup = canonical and spark.createDataFrame(list(canonical.items()), "token string, canonical string")
    rows = score.meteor(table(spark, cases).repartition(3), lookup, stems=True).collect()
    assert len(rows) == len(cases)
    for r in rows:
        want = meteor(*cases[r["pair_id"]], canonical, True)
        assert (r["matches"], r["chunks"]) == want[:2] and r["meteor"] == pytest.approx(want[2])


def test_bert_score_of_long_short_and_empty_sides(spark):
    rng = np.random.default_rng(4)
    sizes = {0: (3, 5), 1: (1300, 700), 2: (4, 0)}
    vectors, rows = {}, []
    for pair, (n, m) in sizes.items():
        for side, count in (("candidate", n), ("reference", m)):
            matrix = vectors[pair, side] = rng.normal(size=(count, 8)).astype(np.float32)
            rows += [(pair, side, i, v.tolist()) for i, v in enumerate(matrix)]
    df = spark.createDataFrame(rows, "pair_id bigint, side string, pos bigint, vec array<float>")
    got = {r["pair_id"]: r for r in score.bert_score(df.repartition(5)).collect()}
    for pair in (0, 1):
        c, r = (
            (v := vectors[pair, side].astype(float)) / np.linalg.norm(v, axis=1, keepdims=True)
            for side in ("candidate", "reference")
        )
        cosines = c @ r.T
        p, q = cosines.max(axis=1).mean(), cosines.max(axis=0).mean()
        assert got[pair]["precision"] == pytest.approx(p)
        assert got[pair]["recall"] == pytest.approx(q)
        assert got[pair]["f1"] == pytest.approx(2 * p * q / (p + q))
    assert (got[2]["precision"], got[2]["recall"], got[2]["f1"]) == (0, 0, 0)


def test_decoding_puts_ids_in_order(spark):
    ids = spark.createDataFrame([(0, 1, 101), (0, 0, 100), (1, 0, 1)], "pair_id bigint, pos bigint, id int")
    rows = score.decode_predictions(ids.repartition(3), ByteTokenizer()).orderBy("pair_id").collect()
    assert [r["text"] for r in rows] == ["ab", ""]
