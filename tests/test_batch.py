import pytest
from pyspark.sql import functions as F

from pairloom.functions import arrays
from pairloom.operators import batch


def seqs(spark, rows):
    return spark.createDataFrame(
        [(i, s, t) for i, (s, t) in enumerate(rows)],
        "position bigint, source array<bigint>, target array<bigint>",
    )


def test_the_last_batch_may_be_shorter(spark):
    batched = batch.assign_batches(seqs(spark, [([1], [1])] * 5), 2)
    assert [r["count"] for r in batched.groupBy("batch_id").count().orderBy("batch_id").collect()] == [2, 2, 1]


def test_padding_masks_shift_and_lengths(spark):
    batched = batch.assign_batches(seqs(spark, [([7, 8], [1, 2, 3]), ([9], [4])]), 2)
    one, two = batch.collate(batched, shifted_masks=True).orderBy("position").collect()
    assert [list(r["source"]) for r in (one, two)] == [[7, 8], [9, 0]]
    assert list(two["src_padding_mask"]) == [False, True]
    assert [list(r["tgt_attn_mask"]) for r in (one, two)] == [[1, 1, 1], [1, 0, 0]]
    assert [list(r["target_input"]) for r in (one, two)] == [[1, 2], [4, 0]]
    assert [list(r["target_output"]) for r in (one, two)] == [[2, 3], [0, 0]]
    assert [(r["src_lengths"], r["tgt_lengths"]) for r in (one, two)] == [(2, 3), (1, 1)]
    assert list(two["input_attn_mask"]) == [1, 0] and list(two["output_attn_mask"]) == [0, 0]


def test_masks_by_length_keep_a_real_pad_token(spark):
    batched = batch.assign_batches(seqs(spark, [([0, 5], [1]), ([6], [1])]), 2)
    by_value, by_length = (
        [list(r["src_attn_mask"]) for r in batch.collate(batched, mask_from=m).orderBy("position").collect()]
        for m in ("value", "length")
    )
    assert by_value == [[0, 1], [1, 0]] and by_length == [[1, 1], [1, 0]]


def test_empty_targets_stay_empty(spark):
    (row,) = batch.collate(batch.assign_batches(seqs(spark, [([1], [])]), 2)).collect()
    assert list(row["target_input"]) == [] and list(row["target_output"]) == []


def test_prompt_and_labels(spark):
    collated = batch.collate(batch.assign_batches(seqs(spark, [([7], [1, 2])]), 1))
    (row,) = batch.add_prompt(collated, [40, 41]).collect()
    assert list(row["source"]) == [40, 41, 7] and list(row["src_attn_mask"]) == [1, 1, 1]
    assert list(row["src_padding_mask"]) == [False] * 3 and row["src_lengths"] == 3
    for split, want in (("train", [1]), ("val", [2])):
        (row,) = batch.labels(collated, F.lit(split)).collect()
        assert list(row["labels"]) == want


def test_accumulation_must_divide():
    assert batch.accumulation_steps(64, 256, 1) == 32
    with pytest.raises(ValueError):
        batch.accumulation_steps(64, 250, 1)


def test_steps_of_micro_batches(spark):
    plan = batch.step_plan(spark.range(5).withColumnRenamed("id", "batch_id"), 2)
    assert [(r["step"], r["micro_step"]) for r in plan.orderBy("batch_id").collect()] == [
        (0, 0), (0, 1), (1, 0), (1, 1), (2, 0)
    ]


def test_shuffle_depends_on_seed_and_epoch_only(spark, shuffle_partitions):
    df = spark.range(200)

    def order(partitions, seed, epoch):
        shuffle_partitions(partitions)
        rows = batch.shuffled_positions(df.repartition(partitions), "id", seed, epoch).collect()
        assert sorted(r["position"] for r in rows) == list(range(200))
        return [r["id"] for r in sorted(rows, key=lambda r: r["position"])]

    assert order(1, 7, 0) == order(9, 7, 0)
    assert len({tuple(order(3, s, e)) for s, e in ((7, 0), (7, 1), (8, 0))}) == 3


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([([1.0, 5.0, 5.0],)], "logits array<float>")
    assert df.select(arrays.argmax(F.col("logits"))).first()[0] == 1


def test_token_range(spark):
    df = spark.createDataFrame([(1, [0, 2**32 - 1]), (2, [2**32]), (3, [-1])], "i int, ids array<bigint>")
    bad = df.where(~arrays.tokens_in_range(F.col("ids")))
    assert sorted(r["i"] for r in bad.collect()) == [2, 3]
    with pytest.raises(Exception, match="outside the range"):
        df.select(arrays.require_in_range(F.col("ids"))).collect()
