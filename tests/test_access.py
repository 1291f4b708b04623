"""Marker lists, sequences by number, the permutation, and stems."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.functions.stems import stem, stemmed
from pairloom.operators import marker_index, permutation, segment
from pairloom.session import materialise


@pytest.mark.parametrize("n, universe", [(0, 0), (0, 9), (1, 1), (1, 1000), (7, 7), (300, 301), (500, 100_000), (4000, 4_000_000)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n + universe)
    positions = np.sort(rng.choice(universe, n, replace=False)) if n else np.zeros(0, np.int64)
    width, low, high = marker_index.encode(positions, universe)
    if n:
        at = rng.integers(0, n, 50)
        assert (marker_index.select(width, low, high, at) == positions[at]).all()
        assert len(low) + len(high) <= (n * (2 + np.log2(universe / n)) + 3 * n) / 8 + 3


@pytest.fixture(scope="module")
def streams():
    """Streams of random tokens; 1 is the marker."""
    rng = random.Random(3)
    found = {}
    for lang_pair, split, shard in [("a-b", "val", 0), ("a-b", "train", 1), ("a-b", "train", 2), ("a-b", "train", 4), ("c-d", "train", 1)]:
        n = 0 if shard == 2 else rng.randint(1, 9)  # one shard without sequences
        for side in ("src", "tgt"):
            tokens = []
            for _ in range(n):
                tokens += [1] + [rng.randint(2, 50) for _ in range(rng.choice([0, 1, 30]))]
            found[lang_pair, split, shard, side] = tokens
    return found


@pytest.mark.parametrize("marker_at", ["first", "last"])
def test_sequences_by_number(spark, tmp_path, streams, marker_at):
    chunk = 10
    if marker_at == "last":
        streams = {k: t[1:] + t[:1] for k, t in streams.items()}
    rows = [(*k, p, t[p : p + chunk]) for k, t in streams.items() for p in range(0, len(t), chunk)]
    runs = spark.createDataFrame(rows, "lang_pair string, split string, shard_idx bigint, side string, pos bigint, tokens array<int>")
    runs.write.partitionBy("lang_pair", "split", "shard_idx").parquet(str(tmp_path / "runs"))
    runs = spark.read.parquet(str(tmp_path / "runs")).withColumn("shard_idx", F.col("shard_idx").cast("bigint"))
    plain = {
        (r["lang_pair"], r["split"], r["shard_idx"], r["seq_id"]): (r["source"], r["target"])
        for r in segment.sequences(runs, 1, marker_at).collect()
    }
    index = materialise(marker_index.build_index(runs, 1), "index")
    loaders = {}
    for key in sorted(plain):
        loaders.setdefault(key[:2], []).append(key)
    asked = [(i, *loader) for loader, keys in loaders.items() for i in (0, 1, len(keys) - 1, len(keys), 3 * len(keys) + 2, 1, -1)]
    requests = spark.createDataFrame(asked, "idx bigint, lang_pair string, split string").repartition(3)
    found = materialise(marker_index.located(index, requests), "located")
    shard = ["lang_pair", "split", "shard_idx"]
    got = [(r["idx"], r["lang_pair"], r["split"], r["shard_idx"], r["seq_id"]) for r in found.collect()]
    assert sorted(got) == sorted((i, *loaders[a, b][i % len(loaders[a, b])]) for i, a, b in asked)
    ranges = materialise(marker_index.token_ranges(index, found.select(*shard, "seq_id").distinct(), marker_at), "ranges")
    read = marker_index.read_sequences(runs, ranges, chunk)
    got = {(r["lang_pair"], r["split"], r["shard_idx"], r["seq_id"]): (r["source"], r["target"]) for r in read.collect()}
    assert got == {k: plain[k] for k in got} and set(got) == {k[1:] for k in map(tuple, found.select("idx", *shard, "seq_id").collect())}
    # the scan opens the folders of the shards asked for alone
    one = ranges.where("lang_pair = 'c-d'")
    plan = marker_index.read_sequences(runs, one, chunk)._jdf.queryExecution().executedPlan().toString()
    filters = [line for line in plan.split("\n") if "PartitionFilters" in line and "runs" in line]
    assert filters and all("c-d" in line.split("PartitionFilters")[1] for line in filters)


@pytest.mark.parametrize("seed, epoch", [(0, 0), (7, 2)])
def test_permutation_is_one(spark, seed, epoch):
    """All n from 1 to 130 and some up to 5,000: every place once, and back again."""
    sizes = [*range(1, 131), 255, 256, 257, 1000, 4095, 4096, 4097, 5000]
    rows = spark.createDataFrame([(n,) for n in sizes], "n bigint").repartition(4).select(
        "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("row")
    )
    placed = rows.withColumn("place", permutation.place_of_row(F.col("row"), F.col("n"), seed, epoch))
    back = placed.withColumn("back", permutation.row_of_place(F.col("place"), F.col("n"), seed, epoch))
    found = {}
    for r in back.collect():
        assert r["back"] == r["row"]
        found.setdefault(r["n"], []).append(r["place"])
    assert all(sorted(found[n]) == list(range(n)) for n in sizes)
    # places are spread: neighbours do not stay together, halves are mixed
    by_row = [r["place"] for r in sorted(placed.where("n = 5000").collect(), key=lambda r: r["row"])]
    steps = np.abs(np.diff(by_row))
    assert 1400 < steps.mean() < 1950 and abs(np.mean(by_row[:2500]) - 2500) < 120


def test_epochs_differ_and_large_numbers_fit(spark):
    big = 10**15 + 3
    row = F.col("id") * 10**10 + 12345
    df = spark.range(2000).select(
        *[permutation.place_of_row(row, F.lit(big), 1, e).alias(f"e{e}") for e in (0, 1)],
        permutation.row_of_place(permutation.place_of_row(row, F.lit(big), 1, 0), F.lit(big), 1, 0).alias("back"),
        row.alias("row"),
    )
    rows = df.collect()
    assert all(r["back"] == r["row"] and 0 <= r["e0"] < big for r in rows)
    assert sum(r["e0"] == r["e1"] for r in rows) == 0 and len({r["e0"] for r in rows}) == 2000


# Examples of the published algorithm, through all of its steps.
STEMS = """caresses caress ponies poni ties ti caress caress cats cat feed feed agreed agre plastered plaster
bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall
hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit
rational ration valenci valenc hesitanci hesit digitizer digit conformabli conform radicalli radic differentli differ
vileli vile analogousli analog vietnamization vietnam predication predic operator oper feudalism feudal
decisiveness decis hopefulness hope callousness callous formaliti formal sensitiviti sensit sensibiliti sensibl
triplicate triplic formative form formalize formal electriciti electr electrical electr hopeful hope goodness good
revival reviv allowance allow inference infer airliner airlin gyroscopic gyroscop adjustable adjust
defensible defens irritant irrit replacement replac adjustment adjust dependent depend adoption adopt
homologou homolog communism commun activate activ angulariti angular homologous homolog effective effect
bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll
generalizations gener oscillators oscil is is by by""".split()


def test_published_stems(spark):
    words, stems = STEMS[::2], STEMS[1::2]
    assert list(map(stem, words)) == stems
    assert list(map(stem, ["été", "a1ing", "running!", "", "yyying"])) == ["été", "a1ing", "running!", "", stem("yyying")]
    df = spark.createDataFrame([(words,), ([],), (None,), (words[::-1] * 2,)], "t array<string>").coalesce(1)
    assert [r[0] for r in df.select(stemmed("t")).collect()] == [stems, [], [], stems[::-1] * 2]
