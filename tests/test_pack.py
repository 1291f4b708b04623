import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.operators import pack


def greedy(totals, size, open_tokens=0, shard=0):
    out = []
    for total in totals:
        out.append(shard)
        open_tokens += total
        if open_tokens >= size:
            open_tokens, shard = 0, shard + 1
    return out


def pairs(spark, totals, lang="de-en", step=1):
    rows = [(i * step, lang, t // 2, t - t // 2) for i, t in enumerate(totals)]
    return spark.createDataFrame(rows, "pair_id bigint, lang_pair string, n_src int, n_tgt int")


def shards(df):
    return [r["shard_idx"] for r in df.orderBy("lang_pair", "pair_id").collect()]


@pytest.mark.parametrize(
    "totals, expected",
    [([5, 5, 5, 5], [0, 0, 1, 1]), ([3, 4, 5, 2, 6, 1], [0, 0, 1, 1, 2, 2])],
)
def test_small_cases(spark, totals, expected):
    assert shards(pack.pack_greedy(pairs(spark, totals), 7)) == expected


@pytest.mark.parametrize("partitions", [1, 50])
@pytest.mark.parametrize("segment_rows, fan", [(1 << 22, 16), (64, 2), (16, 3), (4, 2)])
def test_any_segmentation_gives_the_same_shards(
    spark, shuffle_partitions, segment_rows, fan, partitions
):
    shuffle_partitions(partitions)
    rng = random.Random(segment_rows)
    one = [rng.choice([0, 1, 5, 30]) for _ in range(300)]
    two = [rng.randint(0, 9) for _ in range(90)]
    df = pairs(spark, one, step=3).unionByName(pairs(spark, two, "zh-en")).repartition(6)
    packed = pack.pack_greedy(df, 50, segment_rows=segment_rows, fan=fan)
    assert shards(packed) == greedy(one, 50) + greedy(two, 50)


def test_step_functions_agree_with_walking():
    rng = random.Random(5)
    for _ in range(300):
        size = rng.randint(1, 40)
        parts = [
            np.cumsum([rng.choice([0, 1, 2, 7, 50]) for _ in range(rng.randint(1, 12))])
            for _ in range(rng.randint(1, 5))
        ]
        steps = pack._compose([pack._steps_of_rows(part, size) for part in parts], size)
        totals = [int(t) for part in parts for t in np.diff(part, prepend=0)]
        for missing in range(1, size + 1):
            left, closed = pack._advance(steps, np.array([missing]), np.array([0]))
            open_tokens, shard = size - missing, 0
            for total in totals:
                open_tokens += total
                if open_tokens >= size:
                    open_tokens, shard = 0, shard + 1
            assert (left[0], closed[0]) == (size - open_tokens, shard)


def test_every_shard_but_the_last_is_full_and_was_not_full_before(spark):
    rng = random.Random(9)
    totals = [rng.randint(1, 20) for _ in range(500)]
    packed = pack.pack_greedy(pairs(spark, totals), 60, segment_rows=32, fan=2).collect()
    assert len(packed) == len(totals)
    by_shard = {}
    for row in sorted(packed, key=lambda r: r["pair_id"]):
        by_shard.setdefault(row["shard_idx"], []).append(row["n_src"] + row["n_tgt"])
    assert sorted(by_shard) == list(range(len(by_shard)))
    for shard, tokens in by_shard.items():
        if shard < len(by_shard) - 1:
            assert sum(tokens) >= 60 and sum(tokens[:-1]) < 60


def test_packing_goes_on_from_an_open_shard(spark):
    totals = [4, 9, 1, 1, 8, 3, 3]
    carry = spark.createDataFrame([("de-en", 6, 2)], "grp string, open_tokens bigint, shard bigint")
    packed = pack.pack_greedy(pairs(spark, totals), 10, carry=carry)
    assert shards(packed) == greedy(totals, 10, open_tokens=6, shard=2)


def test_batches_close_shards_only_at_their_end(spark):
    totals = [5, 5, 5, 1, 1, 1, 9]
    df = pairs(spark, totals).where(F.col("pair_id") != 3)  # a dropped pair keeps its place
    packed = pack.pack_batched(df, 7, batch_rows=2)
    # batches 0,1 | 2 | 4,5 | 6 hold 10, 5, 2 and 9 tokens
    assert shards(packed) == [0, 0, 1, 1, 1, 2]


def test_one_shard_is_validation_only(spark):
    packed = pack.pack_greedy(pairs(spark, [1, 2]), 100).withColumn("split", pack.split_name())
    assert {r["split"] for r in packed.collect()} == {"val"}
