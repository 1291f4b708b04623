import gzip
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from pairloom.functions.tokenizers import ByteTokenizer
from pairloom.operators import pack, tokens
from pairloom.sources import archives, lines, runlog, shards
from pairloom.sources import pairs as pair_sources
from pairloom.streaming import ingest as stream_ingest
from pairloom.streaming import runlog as stream_runlog

BYTES = ByteTokenizer()


def test_files_are_paired_by_name_order_and_surplus_dropped(spark, tmp_path):
    for name in ("b.en", "a.en", "c.en", "x.ko", "w.ko", "notes.txt"):
        (tmp_path / name).write_text("x\n")
    found = lines.file_pairs(lines.list_files(spark, str(tmp_path)), ".en", ".ko").orderBy("file_no")
    assert [(r["src_name"], r["tgt_name"]) for r in found.collect()] == [("a.en", "w.ko"), ("b.en", "x.ko")]


def test_line_ends_are_those_of_text_files(spark, tmp_path):
    (tmp_path / "a.en").write_bytes(b"l1\nl2\r\nl3\rl4\n\nl6")
    rows = lines.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [(r["line_no"], r["line"]) for r in rows] == list(enumerate(["l1", "l2", "l3", "l4", "", "l6"]))


def test_lines_keep_their_number_in_split_files(spark, tmp_path):
    content = [f"{i} " + "x" * (i % 50) for i in range(5000)]
    (tmp_path / "big.en").write_text("\n".join(content))
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", 4096)
        spark.conf.set("spark.sql.files.openCostInBytes", 1)
        rows = lines.read_lines(spark, str(tmp_path)).collect()
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert [line for _, line in sorted((r["line_no"], r["line"]) for r in rows)] == content
    assert sorted(r["line_no"] for r in rows) == list(range(5000))


def test_aligned_files_with_unequal_and_empty_lines(spark, tmp_path):
    (tmp_path / "a+1 ü%20.en").write_text("e0\n\ne2\n")
    (tmp_path / "a+1 ü%20.ko").write_text("k0\nk1\nk2\nk3\nk4\n")
    with gzip.open(tmp_path / "b.en.gz", "wt") as f:
        f.write("not of this suffix\n")
    rows = lines.read_aligned(spark, str(tmp_path), ".en", ".ko").orderBy("line_no").collect()
    assert [(r["src_text"], r["tgt_text"]) for r in rows] == [("e0", "k0"), ("", "k1"), ("e2", "k2")]


def test_gzip_lines_are_read_by_the_text_source(spark, tmp_path):
    with gzip.open(tmp_path / "b.en.gz", "wt") as f:
        f.write("one\ntwo\n")
    rows = lines.read_lines(spark, str(tmp_path)).orderBy("line_no").collect()
    assert [r["line"] for r in rows] == ["one", "two"]


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "en-ko.txt.zip", "w") as archive:
        archive.writestr("d/x.en", "a\r\nb\n\nc")
        archive.writestr("d/x.ko", "")
    found = spark.read.format("binaryFile").load(str(tmp_path))
    rows = archives.zip_lines(found).orderBy("line_no").collect()
    assert [(r["member"], r["line_no"], r["line"]) for r in rows] == [
        ("d/x.en", i, line) for i, line in enumerate(["a", "b", "", "c"])
    ]


def test_manifest_kinds(spark):
    urls = ["http://h/a/en-ko.txt.zip", "http://h/b/en.xml.gz", "http://h/c/readme"]
    manifest = json.dumps({"corpora": [{"url": u, "size": 3} for u in urls]})
    df = spark.createDataFrame([(manifest,)], "manifest string")
    assert [(r["file_name"], r["kind"]) for r in archives.manifest_files(df).collect()] == [
        ("en-ko.txt.zip", "zip"), ("en.xml.gz", "gzip"), ("readme", "none")
    ]


def test_nested_pairs(spark):
    df = spark.createDataFrame(
        [({"de": "ja", "en": "yes"}, "de-en"), ({"en": "no"}, "de-en")],
        "translation map<string,string>, lang_pair string",
    )
    assert [(r["src_text"], r["tgt_text"]) for r in pair_sources.from_nested(df).collect()] == [
        ("ja", "yes"), (None, "no")
    ]


def packed(spark, n=40):
    rows = [(i, "en-ko" if i % 3 else "de-en", "s" * (i % 7), "t" * (i % 5)) for i in range(n)]
    pairs = spark.createDataFrame(rows, "pair_id bigint, lang_pair string, src_text string, tgt_text string")
    counted = tokens.count_tokens(pairs, BYTES, "first")
    out = tokens.encode_pairs(pack.pack_greedy(counted, 30), BYTES, "first")
    return out.withColumn("split", pack.split_name()).drop("src_text", "tgt_text")


def test_shards_round_trip_prune_and_keep_existing_output(spark, tmp_path):
    path = str(tmp_path / "out")
    df = packed(spark)
    shards.write_shards(df, path)
    back = shards.read_shards(spark, path)
    key = lambda r: (r["pair_id"], r["shard_idx"], r["split"], list(r["src_ids"]))
    assert sorted(map(key, back.collect())) == sorted(map(key, df.collect()))
    one = shards.read_shards(spark, path, lang_pair="de-en", shard_idx=1)
    assert "PartitionFilters: [isnotnull(lang_pair" in one._jdf.queryExecution().executedPlan().toString()
    assert {(r["lang_pair"], r["shard_idx"]) for r in one.collect()} == {("de-en", 1)}
    shards.write_shards(df.limit(1), path, mode="ignore")
    assert shards.read_shards(spark, path).count() == 40
    names = {r["src_name"] for r in shards.shard_names(back).collect()}
    assert "src_shard_000000" in names and all(r["complete"] for r in shards.shard_names(back).collect())


def test_stream_gives_the_shards_of_the_batch_job(spark, tmp_path):
    rows = [(i, "en-ko" if i % 3 else "de-en", " s" * (i % 7), "t" * (i % 5)) for i in range(90)]
    schema = "pair_id bigint, lang_pair string, src_text string, tgt_text string"
    pairs = spark.createDataFrame(rows, schema)
    out, state = str(tmp_path / "out"), str(tmp_path / "offsets")
    for low in (0, 20, 21, 60):
        high = {0: 20, 20: 21, 21: 60, 60: 90}[low]
        part = pairs.where((F.col("pair_id") >= low) & (F.col("pair_id") < high))
        part.write.mode("append").json(str(tmp_path / "in"))
        arriving = spark.readStream.schema(schema).json(str(tmp_path / "in"))
        stream_ingest.ingest(arriving, out, state, BYTES, 10, 30).awaitTermination()
    streamed = shards.read_shards(spark, f"{out}/pairs")
    kept = tokens.within_length(tokens.count_tokens(tokens.strip_pairs(pairs), BYTES, "first"), 10)
    batch = pack.pack_greedy(kept, 30)
    key = lambda r: (r["pair_id"], r["lang_pair"], r["shard_idx"])
    assert sorted(map(key, streamed.collect())) == sorted(map(key, batch.collect()))


LOG = ["0 val 5.0000", "0 train 9.100000", "junk", "225 val 4.0000", "450 val 4.0000", "675 val 3.0000"]


def test_run_log(spark):
    log = runlog.parse(spark.createDataFrame([(x,) for x in LOG], "line string"))
    assert log.count() == 5
    best = runlog.best_so_far(log).orderBy("step").collect()
    assert [r["is_best"] for r in best] == [True, True, False, True]
    assert tuple(runlog.best_step(log).first()) == (675, 3.0)
    events = {r["step"]: (r["evaluates"], r["saves"]) for r in runlog.events(log).collect()}
    assert events == {0: (True, False), 225: (True, False), 450: (True, False), 675: (True, True)}
    means = {(r["epoch"], r["split"]): r["mean_loss"] for r in runlog.mean_loss(log, 500).collect()}
    assert means[0, "val"] == pytest.approx(13 / 3) and means[1, "val"] == 3.0
    first = {(r["epoch"], r["split"]): r["mean_loss"] for r in runlog.mean_loss(log, 500, 2).collect()}
    assert first[0, "val"] == 4.5


def test_run_log_as_it_grows(spark, tmp_path):
    out, state = str(tmp_path / "out"), str(tmp_path / "offsets")
    for i, part in enumerate((LOG[:4], LOG[4:5], LOG[5:])):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"part{i}.txt").write_text("\n".join(part) + "\n")
        arriving = spark.readStream.text(str(tmp_path / "in"))
        stream_runlog.follow(arriving, out, state).awaitTermination()
    rows = spark.read.parquet(f"{out}/rows").orderBy("step").collect()
    assert [r["is_best"] for r in rows] == [True, True, False, True]


def test_throughput_without_time_is_null(spark):
    steps = spark.createDataFrame([(0, 2.0), (1, 0.0)], "step bigint, dt double")
    rows = runlog.throughput(steps, 64, 256, 32, 1).orderBy("step").collect()
    assert [r["tokens_per_sec"] for r in rows] == [524288 / 2, None]


def test_lines_that_are_no_entries_are_told(spark):
    lines_ = ["5 val 1.5", "5 val abc", "note", "", None, "99999999999999999999 train 1", "7 train NaN", " 8 val 1"]
    df = spark.createDataFrame([(x, i) for i, x in enumerate(lines_)], "line string, at int")
    assert [r["at"] for r in runlog.parse(df).orderBy("at").collect()] == [0, 6]
    reasons = {r["at"]: r["reason"] for r in runlog.rejects(df).collect()}
    assert reasons == {1: "loss is no number", 2: "no entry", 3: "no entry", 4: "no line", 5: "step out of range", 7: "no entry"}


def test_many_runs(spark):
    rows = [("a", 0, 5.0), ("a", 225, 4.0), ("a", 225, 3.5), ("b", 0, 9.0), ("b", 450, 9.5), (None, 0, 1.0)]
    log = spark.createDataFrame([(r, s, "val", x) for r, s, x in rows], "run string, step bigint, split string, loss double")
    best = {(r["run"], r["step"], r["loss"]): r["is_best"] for r in runlog.best_so_far(log, by=["run"]).collect()}
    assert best == {("a", 0, 5.0): True, ("a", 225, 3.5): True, ("a", 225, 4.0): False, ("b", 0, 9.0): True, ("b", 450, 9.5): False, (None, 0, 1.0): True}
    assert {r["run"]: (r["step"], r["loss"]) for r in runlog.best_step(log, ["run"]).collect()} == {"a": (225, 3.5), "b": (0, 9.0), None: (0, 1.0)}
    saved = {(r["run"], r["step"]) for r in runlog.events(log, ["run"]).where("saves").collect()}
    assert saved == {("a", 225), ("b", 450), (None, 0)}
    means = {(r["run"], r["epoch"]): r["mean_loss"] for r in runlog.mean_loss(log, 300, by=["run"]).collect()}
    assert means[("a", 0)] == pytest.approx(12.5 / 3) and means[(None, 0)] == 1.0
