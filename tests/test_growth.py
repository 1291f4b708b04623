"""What grows with the input alone: files, waves, and moves of rows."""

import shutil

import pyarrow as pa
from pyspark.sql import functions as F

from pairloom.functions import tokenizers
from pairloom.functions.tokenizers import ByteTokenizer
from pairloom.operators import pack, prefix, segment, tokens
from pairloom.plans import resume
from pairloom.session import read_bucketed, write_bucketed
from pairloom.sources import shards

BYTES = ByteTokenizer()


def pairs(spark, n):
    return spark.range(n).select(
        F.col("id").alias("pair_id"), F.lit("a-b").alias("lang_pair"),
        F.lit("some text").alias("src_text"), F.lit("other text").alias("tgt_text"),
    )


def packed(spark, n):
    """Every pair is a shard of its own."""
    counted = tokens.count_tokens(pairs(spark, n), BYTES, "first")
    return counted.withColumn("shard_idx", F.col("pair_id")).withColumn("split", pack.split_name())


def moves(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning")


def test_files_are_as_many_as_tasks_and_not_as_shards(spark, tmp_path):
    path = str(tmp_path / "out")
    shards.write_shards(packed(spark, 200), path, encode=lambda df: tokens.encode_pairs(df, BYTES, "first"))
    back = shards.read_shards(spark, path)
    assert back.select("shard_idx").distinct().count() == 200
    assert len(list((tmp_path / "out").rglob("*.parquet"))) <= 8  # two splits, four tasks
    one = shards.read_shards(spark, path, shard_idx=7)
    assert [r["pair_id"] for r in one.collect()] == [7]


def test_a_resumed_ingest_has_few_waves(spark, tmp_path, monkeypatch):
    waves = []
    stated = resume._stated
    monkeypatch.setattr(resume, "_stated", lambda df: waves.append(1) or stated(df))
    assert resume.ingest(pairs(spark, 40), str(tmp_path / "out"), BYTES, 1, shards_per_wave=1) == 40
    assert len(waves) == 6  # 1, 2, 4, 8, 16, 9


def test_a_resumed_ingest_has_few_folders(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(resume, "FOLDERS", 4, raising=False)
    both = pairs(spark, 40).union(pairs(spark, 9).withColumn("lang_pair", F.lit("c-d")))
    out = tmp_path / "out"
    folders = lambda: sorted(out.glob("data/lang_pair=*/split=*/shard_idx=*"))
    rows = lambda: sorted(
        (r["lang_pair"], r["split"], r["shard_idx"], r["pair_id"], len(r["src_ids"]), len(r["tgt_ids"]))
        for r in shards.read_shards(spark, str(out / "data")).collect()
    )
    ingest = lambda waves=None: resume.ingest(both, str(out), BYTES, 1, shards_per_wave=1, max_waves=waves)
    first = ingest(1)
    assert len(rows()) == first < 49
    assert first + ingest() == 49 and ingest() == 0
    assert len(folders()) <= 8  # it is 49 with a folder for each shard
    want = [(lp, "train" if i else "val", i, i, 10, 11) for lp, n in (("a-b", 40), ("c-d", 9)) for i in range(n)]
    assert rows() == sorted(want)
    # a folder that is lost, and a shard that is lost from a folder of many
    held = {path: spark.read.parquet(str(path)).collect() for path in folders()}
    lost, cut = [path for path in folders() if len(held[path]) > 2][:2]
    shutil.rmtree(lost)
    spark.createDataFrame(held[cut][1:], spark.read.parquet(str(cut)).schema).write.mode("overwrite").parquet(str(cut))
    assert len(rows()) == 49 - len(held[lost]) - 1
    assert ingest() == len(held[lost]) + len(held[cut])
    assert rows() == sorted(want)


def test_a_plan_without_folders_has_one_for_each_shard(spark, tmp_path, monkeypatch):
    """An ingest that was begun when every shard had a folder."""
    out = str(tmp_path / "out")
    packed(spark, 12).write.parquet(f"{out}/plan")
    monkeypatch.setattr(resume, "FOLDERS", 4, raising=False)
    assert resume.ingest(pairs(spark, 12), out, BYTES, 1, shards_per_wave=2, max_waves=1) == 2
    assert resume.ingest(pairs(spark, 12), out, BYTES, 1) == 10
    assert len(list((tmp_path / "out").glob("data/*/*/shard_idx=*"))) == 12
    found = {r["pair_id"]: r["shard_idx"] for r in shards.read_shards(spark, f"{out}/data").collect()}
    assert found == {i: i for i in range(12)}


def test_rows_move_once_for_their_running_total(spark):
    df = spark.range(50).withColumn("g", F.when(F.col("id") > 9, "hot")).repartition(3)
    placed = prefix.row_positions(df, "id", by=["g"])
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["position"] for r in placed.collect()} == {i: i if i < 10 else i - 10 for i in range(50)}
    assert "Window" in plan and plan.split("Union")[0].count("Exchange hashpartitioning") == 1
    assert "Join" not in plan.split("Union")[0]


def test_tokens_move_once_into_chunks_and_once_into_sequences(spark, tmp_path):
    rows = tokens.encode_pairs(packed(spark, 20), BYTES, "first").withColumn("shard_idx", F.col("pair_id") % 3)
    runs = segment.rechunk(segment.runs_of_pairs(rows), 7)
    assert moves(runs) == 1
    runs.write.parquet(str(tmp_path / "runs"))
    assert moves(segment.sequences(spark.read.parquet(str(tmp_path / "runs")), 1)) == 1
    # in buckets of whole shards they need not move again
    write_bucketed(runs, str(tmp_path / "bucketed"), segment.shard_keys(runs))
    stored = segment.sequences(read_bucketed(spark, str(tmp_path / "bucketed")), 1)
    assert moves(stored) == 0
    want = sorted((r["shard_idx"], list(r["src_ids"]), list(r["tgt_ids"])) for r in rows.collect())
    assert sorted((r["shard_idx"], list(r["source"]), list(r["target"])) for r in stored.collect()) == want


def test_a_batch_is_decoded_some_rows_at_a_time(monkeypatch):
    texts = ["ab", None, "", "\u00e9" * 9, "x", "yz" * 5, None, "end"]
    ids = tokenizers._byte_encode(pa.array(texts))
    steps, decode = [], tokenizers._decode_rows
    monkeypatch.setattr(tokenizers, "DECODED_IDS", 6)
    monkeypatch.setattr(tokenizers, "_decode_rows", lambda part: steps.append(len(part)) or decode(part))
    assert tokenizers._byte_decode(ids).to_pylist() == texts
    assert len(steps) > 2 and sum(steps) == len(texts)
    assert tokenizers._byte_decode(ids.slice(3, 3)).to_pylist() == texts[3:6]
    assert tokenizers._byte_decode(ids.slice(0, 0)).to_pylist() == []
