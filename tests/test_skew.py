"""One key holds a third of all rows or more; plans and results must not mind."""

from pyspark.sql import functions as F

from pairloom.operators import pack, prefix, segment
from pairloom.plans import inputs

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_hot_group_is_spread_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(prefix, "BLOCK_WIDTH", 64)
    df = spark.range(3000).withColumn("g", F.when(F.col("id") % 3 < 2, "hot").otherwise("cold"))
    placed = prefix.row_positions(df, "id", by=["g"])
    assert {(r["g"], r["n"], r["hi"]) for r in placed.groupBy("g").agg(
        F.count("*").alias("n"), F.max("position").alias("hi")).collect()} == {
        ("hot", 2000, 1999), ("cold", 1000, 999)}
    # rows are shuffled by group and block, never by the group alone
    rows = [line for line in plan(placed).splitlines() if "Exchange hashpartitioning" in line]
    assert any("_block" in line for line in rows)


def test_a_hot_language_pair_packs_as_any_other(spark):
    df = spark.range(4000).select(
        F.col("id").alias("pair_id"),
        F.when(F.col("id") % 10 < 7, "hot").otherwise("cold").alias("lang_pair"),
        F.lit(3).alias("n_src"),
        F.lit(4).alias("n_tgt"),
    )
    packed = pack.pack_greedy(df, 70, segment_rows=256, fan=4)
    sizes = packed.groupBy("lang_pair", "shard_idx").agg(F.sum(F.col("n_src") + F.col("n_tgt")).alias("t"))
    got = {r["lang_pair"]: (r["n"], r["lo"], r["hi"]) for r in sizes.groupBy("lang_pair").agg(
        F.count("*").alias("n"), F.min("t").alias("lo"), F.max("t").alias("hi")).collect()}
    assert got == {"hot": (280, 70, 70), "cold": (120, 70, 70)}


def test_one_endless_sequence_is_cut_before_it_meets(spark):
    """A stream with a single marker: no row ever holds more than the maximum."""
    rows = [(0, side, at, [1 if at == 0 else 9] + [9] * 99) for side in ("src", "tgt") for at in range(0, 20000, 100)]
    runs = spark.createDataFrame(rows, "shard_idx bigint, side string, pos bigint, tokens array<int>")
    (row,) = segment.sequences(runs, 1, "first", max_len=250).collect()
    assert list(row["source"]) == [1] + [9] * 249 == list(row["target"])


def test_scans_read_only_what_a_query_needs(spark):
    pairs = inputs.numbered_pairs(spark, SF)
    examined = plan(pairs.where(F.col("pair_id") < 5).select("pair_id", "src_text"))
    assert "LessThan(pair_id,5)" in examined and "tgt_text" not in examined


def test_no_query_joins_everything_with_everything(spark):
    for name in ("packed_pairs", "loaded_sequences"):
        df = (
            inputs.packed_pairs(inputs.counted_pairs(inputs.all_pairs(spark, SF)))
            if name == "packed_pairs"
            else inputs.loaded_sequences(spark, SF)
        )
        assert "CartesianProduct" not in plan(df) and "BroadcastNestedLoopJoin" not in plan(df)
