import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import prefix


def running(rows, by, op):
    """Inclusive and exclusive running values by plain Python."""
    state, out = {}, {}
    for order, group, value in sorted(rows):
        key = group if by else None
        before = state.get(key)
        if op == "sum":
            after = (before or 0) + value
        else:
            after = value if before is None else min(before, value)
        out[order] = (after, before)
        state[key] = after
    return out


@pytest.mark.parametrize("partitions", [1, 4, 37])
@pytest.mark.parametrize("by", [[], ["g"]])
def test_running_values_over_many_blocks(
    spark, shuffle_partitions, monkeypatch, partitions, by
):
    monkeypatch.setattr(prefix, "BLOCK_WIDTH", 8)
    monkeypatch.setattr(prefix, "BLOCKS_PER_GROUP", 4)
    shuffle_partitions(partitions)
    rng = random.Random(partitions)
    rows = [(o, rng.choice("ab"), rng.randint(0, 9)) for o in rng.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "o bigint, g string, v bigint").repartition(5)
    values = {"total": ("sum", F.col("v")), "low": ("min", F.col("v"))}
    inclusive = prefix.ordered_prefix(df, "o", values, by=by).collect()
    exclusive = prefix.ordered_prefix(df, "o", values, by=by, inclusive=False).collect()
    sums, lows = running(rows, by, "sum"), running(rows, by, "min")
    assert {r["o"]: (r["total"], r["low"]) for r in inclusive} == {
        o: (sums[o][0], lows[o][0]) for o in sums
    }
    assert {r["o"]: (r["total"], r["low"]) for r in exclusive} == {
        o: (sums[o][1] or 0, lows[o][1]) for o in sums
    }


def test_numbering_by_strings_and_pairs_of_keys(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "a", "z"]), i) for i in range(400)]
    df = spark.createDataFrame(rows, "name string, i bigint").repartition(7)
    numbered = prefix.number_rows(df, ["name", "i"], "n").collect()
    assert {(r["name"], r["i"]): r["n"] for r in numbered} == {
        key: n for n, key in enumerate(sorted(rows))
    }


def test_null_groups_and_keys_stay(spark):
    rows = [(1, None), (2, "a"), (3, None), (4, "a")]
    df = spark.createDataFrame(rows, "o bigint, g string")
    got = {(r["g"], r["o"]): r["position"] for r in prefix.row_positions(df, "o", by=["g"]).collect()}
    assert got == {(None, 1): 0, (None, 3): 1, ("a", 2): 0, ("a", 4): 1}


def test_numbers_of_nothing(spark):
    assert prefix.number_rows(spark.createDataFrame([], "c bigint"), ["c"], "id").collect() == []
