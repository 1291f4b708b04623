"""Ingest jobs that are stopped and go on; streams that arrive in any order."""

import random
import shutil

import pytest
from pyspark.sql import functions as F

from pairloom.functions.tokenizers import ByteTokenizer
from pairloom.operators import pack, tokens
from pairloom.plans import resume
from pairloom.sources import runlog
from pairloom.streaming import runs, unordered

BYTES = ByteTokenizer()
SIZE = 300


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(9)
    rows = [(i, lp, "s" * rng.randint(0, 40), "t" * rng.randint(0, 40)) for lp in ("a-b", "c-d") for i in range(60)]
    return spark.createDataFrame(rows, "pair_id bigint, lang_pair string, src_text string, tgt_text string").cache()


def shards_of(df):
    found = {}
    for r in df.collect():
        found[r["lang_pair"], r["pair_id"]] = (r["split"], r["shard_idx"], tuple(r["src_ids"]), tuple(r["tgt_ids"]))
    return found


@pytest.fixture(scope="module")
def whole(spark, pairs, tmp_path_factory):
    """The single run, and what plain packing says."""
    out = str(tmp_path_factory.mktemp("whole"))
    n = resume.ingest(pairs, out, BYTES, SIZE)
    found = shards_of(resume._data(spark, out))
    packed = pack.pack_greedy(tokens.count_tokens(pairs, BYTES, "first"), SIZE).collect()
    assert {k: v[1] for k, v in found.items()} == {(r["lang_pair"], r["pair_id"]): r["shard_idx"] for r in packed}
    assert n == len({(k[0], v[1]) for k, v in found.items()}) > 10
    return found


@pytest.mark.parametrize("stop", ["after the plan", "after a wave", "in a wave", "twice"])
def test_a_stopped_ingest_goes_on(spark, pairs, whole, tmp_path, stop):
    out = str(tmp_path / "out")
    resume.ingest(pairs, out, BYTES, SIZE, shards_per_wave=3, max_waves=0 if stop == "after the plan" else 1)
    first = 0 if stop == "after the plan" else 3
    if stop == "in a wave":  # shards without a row in the log, one of them half written
        data = resume._data(spark, out).limit(4).withColumn("shard_idx", F.lit(20).cast("bigint"))
        data.write.mode("append").partitionBy("lang_pair", "split", "shard_idx").parquet(f"{out}/data")
        half = spark.read.parquet(f"{out}/plan").where("shard_idx = 4 and lang_pair = 'a-b'").limit(1)
        rows = tokens.encode_pairs(half, BYTES, "first").select(*resume.PARTITIONS, "pair_id", "src_ids", "tgt_ids", "n_src", "n_tgt")
        rows.write.mode("append").partitionBy("lang_pair", "split", "shard_idx").parquet(f"{out}/data")
    if stop == "twice":
        first += resume.ingest(pairs, out, BYTES, SIZE, shards_per_wave=2, max_waves=2)
    # the pairs are not read again once the plan stands
    rest = resume.ingest(pairs.where("false"), out, BYTES, SIZE, shards_per_wave=4)
    found = shards_of(resume._data(spark, out).where("shard_idx < 20"))
    assert found == whole
    assert first + rest == len({(k[0], v[1]) for k, v in whole.items()})
    assert resume.ingest(pairs, out, BYTES, SIZE) == 0


def test_damaged_shards_are_written_again(spark, pairs, whole, tmp_path):
    out = tmp_path / "out"
    resume.ingest(pairs, str(out), BYTES, SIZE)
    folders = sorted(out.glob("data/lang_pair=*/split=*/shard_idx=*"))
    shutil.rmtree(folders[1])
    row = spark.read.parquet(str(folders[3])).limit(1)
    row.write.mode("overwrite").parquet(str(folders[3]))
    assert resume.ingest(pairs, str(out), BYTES, SIZE) == 2
    assert shards_of(resume._data(spark, str(out))) == whole
    with pytest.raises(ValueError, match="other options"):
        resume.ingest(pairs, str(out), BYTES, SIZE + 1)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_in_any_order(spark, pairs, tmp_path, seed):
    """Files in a shuffled order, with a restart after each and a pair that comes twice."""
    rows = [tuple(r) for r in pairs.collect()]
    random.Random(seed).shuffle(rows)
    cuts = [rows[:50], rows[50:51], rows[51:] + rows[:2]]
    max_len = 35
    for part in cuts:
        spark.createDataFrame(part, pairs.schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        arriving = spark.readStream.schema(pairs.schema).parquet(str(tmp_path / "in"))
        for query in unordered.ingest(arriving, str(tmp_path / "out"), str(tmp_path / "state"), BYTES, max_len, SIZE):
            query.awaitTermination()
    unordered.finish(spark, str(tmp_path / "out"), BYTES)
    kept = tokens.within_length(tokens.count_tokens(pairs, BYTES, "first"), max_len)
    want = {(r["lang_pair"], r["pair_id"]): r["shard_idx"] for r in pack.pack_greedy(kept, SIZE).collect()}
    found = shards_of(spark.read.parquet(str(tmp_path / "out" / "shards")))
    assert {k: v[1] for k, v in found.items()} == want and len(want) < len(rows)


@pytest.mark.parametrize("seed", [1, 2])
def test_late_lines_correct_the_best(spark, tmp_path, seed):
    rng = random.Random(seed)
    lines = [(run, f"{step} {rng.choice(['val', 'val', 'train'])} {rng.randint(1, 9) / 2}") for run in ("a", "b", None) for step in range(0, 12)]
    lines += [lines[3], ("a", "no entry"), ("c", "5 val 1.0")]
    rng.shuffle(lines)
    schema = "run string, line string"
    for part in (lines[:15], lines[15:16], lines[16:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changed = runs.changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
        changed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")
        ).trigger(availableNow=True).start().awaitTermination()
    found = runs.current(spark.read.parquet(str(tmp_path / "out"))).collect()
    batch = runlog.best_so_far(runlog.parse(spark.createDataFrame(lines, schema)), by=["run"]).collect()
    key = lambda r: repr((r["run"], r["step"], r["loss"], r["is_best"]))
    assert sorted(map(key, found)) == sorted(map(key, batch))


def test_many_runs_share_a_state(spark, tmp_path):
    """Numbers beyond those of a double beside a null, in as many states as there are buckets."""
    rng = random.Random(4)
    names = [2**60 + i for i in range(40)] + [None]
    lines = [(run, f"{step} val {rng.randint(1, 9) / 2}") for run in names for step in range(6)]
    rng.shuffle(lines)
    schema = "run bigint, line string"
    for part in (lines[:100], lines[100:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        changed = runs.changes(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), buckets=3)
        assert dict(changed.dtypes)["run"] == "bigint"
        query = changed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option(
            "checkpointLocation", str(tmp_path / "state")
        ).trigger(availableNow=True).start()
        query.awaitTermination()
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    found = runs.current(spark.read.parquet(str(tmp_path / "out"))).collect()
    batch = runlog.best_so_far(runlog.parse(spark.createDataFrame(lines, schema)), by=["run"]).collect()
    key = lambda r: repr((r["run"], r["step"], r["loss"], r["is_best"]))
    assert sorted(map(key, found)) == sorted(map(key, batch)) and len(found) == len(lines)
