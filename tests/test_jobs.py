import json

import pytest
from pyspark.sql import functions as F

from pairloom.config import AlignedIngest, Ingest, Loader
from pairloom.functions.tokenizers import ByteTokenizer
from pairloom.operators import segment
from pairloom.plans import jobs
from pairloom.sources import lines as lines_source
from pairloom.sources.shards import read_shards

BYTES = ByteTokenizer()


def greedy(pairs, size, grain=1):
    """Shards of (number, tokens) rows, looking at the size every ``grain`` numbers."""
    out, shard, open_tokens, last = {}, 0, 0, None
    for number, total in pairs:
        if last is not None and number // grain != last // grain and open_tokens >= size:
            shard, open_tokens = shard + 1, 0
        out[number] = shard
        open_tokens, last = open_tokens + total, number
    return out


def test_nested_corpus_to_shards(spark, tmp_path):
    texts = {"de-en": [("d" * (i % 9), "e" * (i % 4)) for i in range(60)],
             "zh-en": [("z" * 5, "e" * (i % 3)) for i in range(20)]}
    for lang_pair, rows in texts.items():
        (tmp_path / lang_pair).mkdir()
        source, target = lang_pair.split("-")
        for half, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
            lines = [json.dumps({"translation": {source: s, target: t}}) for s, t in part]
            (tmp_path / lang_pair / f"{half}.jsonl").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    options = Ingest(shard_size=25, max_pairs=50, max_seq_len=7)
    folders = {k: str(tmp_path / k) for k in texts}
    jobs.ingest_nested(spark, folders, out, BYTES, options)
    jobs.ingest_nested(spark, {"none": "/nowhere"}, out, BYTES, options)  # left alone
    got = {(r["lang_pair"], r["pair_id"]): r for r in read_shards(spark, out).collect()}
    want = {}
    for lang_pair, rows in texts.items():
        kept = [(i, len(s) + len(t)) for i, (s, t) in enumerate(rows[:50]) if len(s) <= 7]
        want |= {(lang_pair, i): shard for i, shard in greedy(kept, 25).items()}
    assert {key: r["shard_idx"] for key, r in got.items()} == want
    assert {r["split"] for r in got.values() if r["shard_idx"] == 0} == {"val"}
    assert all(bytes(t - 3 for t in r["src_ids"]).decode() == texts[k[0]][k[1]][0] for k, r in got.items())


@pytest.mark.parametrize("fine_tune", [False, True])
def test_aligned_corpus_to_shards_to_batches(spark, tmp_path, fine_tune):
    rows = [("  " + "e" * (i % 8), "k" * (i % 5) + " ") for i in range(70)]
    for name, part in (("a", rows[:30]), ("b", rows[30:])):
        for side, language in enumerate(("en", "ko")):
            text = "\n".join(row[side] for row in part)
            (tmp_path / f"{name}.{language}").write_text(text + "\nsurplus" * (language == "ko"))
    out = str(tmp_path / "out")
    options = AlignedIngest(shard_size=40, max_pairs=50, max_seq_len=6, batch_size=4, fine_tune=fine_tune)
    jobs.ingest_aligned(spark, str(tmp_path), ("en", "ko"), out, BYTES, options)

    sizes = [tuple(len(x.strip()) + 1 for x in row) for row in rows]
    if fine_tune:
        sizes = [tuple(min(n, 6) for n in pair) for pair in sizes]
    kept = [(i, sum(pair)) for i, pair in enumerate(sizes) if max(pair) <= 6][:50]
    got = {r["pair_id"]: r for r in read_shards(spark, out).collect()}
    assert {i: r["shard_idx"] for i, r in got.items()} == greedy(kept, 40, grain=4)
    assert {len(r["src_ids"]) for r in got.values()} == {n for (n, _), i in zip(sizes, range(70)) if i in got}

    marker_at = "last" if fine_tune else "first"
    loader = Loader(batch_size=4, max_seq_len=5, world_size=2, tokens_per_step=80)
    train = read_shards(spark, out, split="train")
    flat = segment.sequences(segment.rechunk(segment.runs_of_pairs(train), 7), BYTES.eos_id, marker_at, 5)
    want = sorted((r["shard_idx"], r["seq_id"], r["source"], r["target"]) for r in flat.collect())
    direct = jobs.shard_sequences(train, marker_at, 5).collect()
    assert sorted((r["shard_idx"], r["seq_id"], r["source"], r["target"]) for r in direct) == want
    loaded = jobs.batches(spark, out, "en-ko", "train", marker_at, options=loader).collect()
    assert len(loaded) == len(want) + len(want) % 2
    assert {(r["shard_idx"], r["seq_id"]) for r in loaded} == {row[:2] for row in want}
    for r in loaded:
        assert r["step"] == r["batch_id"] // 2
        # a batch of empty targets has nothing to shift
        assert len(r["target_input"]) == len(r["target_output"]) == max(0, len(r["tgt_attn_mask"]) - 1)
        peers = [x for x in loaded if (x["rank"], x["batch_id"]) == (r["rank"], r["batch_id"])]
        assert len(peers) <= 4 and len(r["source"]) == max(x["src_lengths"] for x in peers)


def test_batches_hold_whole_sequences_of_all_pairs_and_splits(spark, tmp_path):
    texts = {"de-en": [("d" * (300 + i), "e" * i) for i in range(12)], "zh-en": [("z" * i, "e" * 280) for i in range(7)]}
    for lang_pair, rows in texts.items():
        (tmp_path / lang_pair).mkdir()
        source, target = lang_pair.split("-")
        lines = [json.dumps({"translation": {source: s, target: t}}) for s, t in rows]
        (tmp_path / lang_pair / "0.jsonl").write_text("\n".join(lines) + "\n")
    out = str(tmp_path / "out")
    jobs.ingest_nested(spark, {k: str(tmp_path / k) for k in texts}, out, BYTES, Ingest(shard_size=900))
    packed = read_shards(spark, out).collect()
    loaded = jobs.batches(spark, out, options=Loader(batch_size=2, world_size=1)).collect()
    keys = ("lang_pair", "split", "shard_idx")
    assert len({tuple(r[k] for k in keys[:2]) for r in loaded}) == 4
    want = sorted((*[r[k] for k in keys], r["src_ids"], len(r["tgt_ids"])) for r in packed)
    got = sorted((*[r[k] for k in keys], r["source"][: r["src_lengths"]], r["tgt_lengths"]) for r in loaded)
    assert got == want and len(got) == 19
    for r in loaded:
        peers = [x for x in loaded if all(x[k] == r[k] for k in ("lang_pair", "split", "batch_id"))]
        assert len(peers) <= 2 and len(r["source"]) == max(x["src_lengths"] for x in peers)


class CountingTokenizer(ByteTokenizer):
    """Counts how often a text is tokenised; its ``count`` is no native expression."""

    def __init__(self, seen):
        self.seen = seen

    def _ids(self, text):
        seen = self.seen

        @F.udf("array<int>")
        def ids(value):
            seen.add(1)
            return [b + 3 for b in value.encode()]

        return ids(text)

    def encode(self, text):
        return self._ids(text)

    def count(self, text):
        return F.size(self._ids(text))


@pytest.mark.parametrize("job", ["nested", "aligned"])
def test_a_text_is_tokenised_twice_at_most(spark, tmp_path, job):
    seen = spark.sparkContext.accumulator(0)
    (tmp_path / "in").mkdir()
    if job == "nested":
        lines = [json.dumps({"translation": {"a": f"x{i}", "b": f"y{i}"}}) for i in range(30)]
        (tmp_path / "in" / "0.jsonl").write_text("\n".join(lines) + "\n")
        jobs.ingest_nested(spark, {"a-b": str(tmp_path / "in")}, str(tmp_path / "out"), CountingTokenizer(seen), Ingest(shard_size=20))
    else:
        for language in ("a", "b"):
            (tmp_path / "in" / f"0.{language}").write_text("".join(f"{language}{i}\n" for i in range(30)))
        options = AlignedIngest(shard_size=20, max_pairs=25, batch_size=4)
        jobs.ingest_aligned(spark, str(tmp_path / "in"), ("a", "b"), str(tmp_path / "out"), CountingTokenizer(seen), options)
    assert 30 * 2 < seen.value <= 30 * 2 * 2


def test_lines_that_are_no_pairs_end_the_job(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = json.dumps({"translation": {"a": "x", "b": "y"}})
    (tmp_path / "in" / "0.jsonl").write_text(f'{good}\n{{"translation": \n{{"translation": {{"a": "x"}}}}\n')
    path = str(tmp_path / "in")
    with pytest.raises(Exception, match="not a pair"):
        lines_source.read_nested(spark, path, "a-b").collect()
    reasons = [r["reason"] for r in lines_source.checked_nested(spark, path, "a-b").orderBy("line_no").collect()]
    assert reasons == [None, "no translation", "target missing"]


def test_scores_of_all_metrics(spark):
    rows = [(0, "a b c d e".split(), "a b c d e".split())]
    predictions = spark.createDataFrame(rows, "pair_id bigint, candidate array<string>, reference array<string>")
    vectors = spark.createDataFrame(
        [(0, side, 0, [1.0, 0.0]) for side in ("candidate", "reference")],
        "pair_id bigint, side string, pos bigint, vec array<float>",
    )
    got = {r["metric"]: r["value"] for r in jobs.scores(predictions, vectors).collect()}
    assert got.pop("meteor") == pytest.approx(1 - 0.5 / 125)
    assert got == pytest.approx({"bleu": 1, "corpus_bleu": 1, "bert_precision": 1, "bert_recall": 1, "bert_f1": 1})
