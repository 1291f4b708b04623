import random

import pytest

from pairloom.operators import ranks, segment

E = 1


def runs(spark, src, tgt, cuts=3):
    """Streams of one shard in runs of ``cuts`` tokens."""
    rows = [
        (0, side, at, tokens[at : at + cuts])
        for side, tokens in (("src", src), ("tgt", tgt))
        for at in range(0, len(tokens), cuts)
    ]
    return spark.createDataFrame(rows, "shard_idx bigint, side string, pos bigint, tokens array<int>")


def found(df):
    return [(list(r["source"]), list(r["target"])) for r in df.orderBy("shard_idx", "seq_id").collect()]


def cut(stream, marker_at):
    """Sequences of a stream by plain Python."""
    at = [i for i, t in enumerate(stream) if t == E]
    if marker_at == "first":
        return [stream[a:b] for a, b in zip(at, at[1:] + [len(stream)])]
    return [stream[a + 1 : b] for a, b in zip([-1] + at, at)]


@pytest.mark.parametrize("cuts", [1, 2, 3, 100])
def test_small_cases(spark, cuts):
    first = [4, E, 5, 6, E, E, 7]
    last = [5, 6, E, E, 7, E, 8]
    got = segment.sequences(runs(spark, first, first, cuts), E, "first")
    assert found(got) == [(s, s) for s in ([E, 5, 6], [E], [E, 7])]
    got = segment.sequences(runs(spark, last, last, cuts), E, "last")
    assert found(got) == [(s, s) for s in ([5, 6], [], [7])]


@pytest.mark.parametrize("marker_at", ["first", "last"])
@pytest.mark.parametrize("max_len", [None, 4])
def test_random_streams_with_long_and_unequal_sides(spark, marker_at, max_len):
    rng = random.Random(f"{marker_at}{max_len}")
    for cuts in (1, 7, 40):
        src = [rng.choice([E, 2, 3, 4, 5, 6]) for _ in range(60)]
        tgt = [rng.choice([E] + list(range(2, 20))) for _ in range(90)]
        want = [
            (s[:max_len], t[:max_len]) for s, t in zip(cut(src, marker_at), cut(tgt, marker_at))
        ]
        streams = runs(spark, src, tgt, cuts)
        assert found(segment.sequences(streams, E, marker_at, max_len, strict=False)) == want
        if len(cut(src, marker_at)) != len(cut(tgt, marker_at)):
            with pytest.raises(Exception, match="on one side only"):
                segment.sequences(streams, E, marker_at, max_len).collect()


def test_language_pairs_and_splits_stay_apart(spark):
    rows = [
        (lang, split, 0, side, 0, [E, n, n])
        for n, (lang, split) in enumerate([("a-b", "val"), ("a-b", "train"), ("c-d", "val"), (None, "val")], 5)
        for side in ("src", "tgt")
    ]
    streams = spark.createDataFrame(
        rows, "lang_pair string, split string, shard_idx bigint, side string, pos bigint, tokens array<int>"
    )
    assert {r["n_tokens"] for r in segment.stream_profile(streams, E).collect()} == {3}
    seqs = segment.number_sequences(segment.sequences(streams, E)).withColumnRenamed("n", "position")
    got = {(r["lang_pair"], r["split"]): (r["position"], list(r["source"])) for r in seqs.collect()}
    assert got == {(lang, split): (0, tokens) for lang, split, _, side, _, tokens in rows if side == "src"}
    assert {r["rank"] for r in ranks.rank_sequences(seqs, 2).collect()} == {0, 1}
    assert ranks.rank_sequences(seqs, 2).count() == 8


def test_mismatch_and_positions(spark):
    streams = runs(spark, [E, 2, E, 3], [E, 2, 2, 2, 2])
    (row,) = segment.marker_mismatch(streams, E).collect()
    assert (row["shard_idx"], row["src_markers"], row["tgt_markers"]) == (0, 2, 1)
    positions = {(r["side"], r["pos"]) for r in segment.marker_positions(streams, E).collect()}
    assert positions == {("src", 0), ("src", 2), ("src", 4), ("tgt", 0), ("tgt", 5)}


def test_concatenated_pairs_give_their_sequences_back(spark):
    rng = random.Random(2)
    rows = [
        (p // 4, p, [E] + [9] * rng.randint(0, 5), [E] + [8] * rng.randint(0, 5)) for p in range(20)
    ]
    packed = spark.createDataFrame(
        rows, "shard_idx bigint, pair_id bigint, src_ids array<int>, tgt_ids array<int>"
    )
    streams = segment.runs_of_pairs(packed)
    for stream in (streams, segment.rechunk(streams, 4)):
        assert found(segment.sequences(stream, E, "first")) == [(r[2], r[3]) for r in rows]
    chunks = segment.rechunk(streams, 4).collect()
    assert all(c["pos"] % 4 == 0 and len(c["tokens"]) <= 4 for c in chunks)
    heads = segment.head(streams, 3).collect()
    assert {h["pos"] for h in heads} == {0, 1, 2} and len(heads) == 5 * 2 * 3


def test_lookup_starts_again_past_the_end(spark):
    seqs = spark.createDataFrame(
        [(s, i, [s, i], [0]) for s in (0, 2) for i in range(3)],
        "shard_idx bigint, seq_id bigint, source array<int>, target array<int>",
    )
    requests = spark.createDataFrame([(0,), (4,), (6,), (11,)], "idx bigint")
    got = segment.lookup(segment.number_sequences(seqs), requests)
    assert {r["idx"]: list(r["source"]) for r in got.collect()} == {
        0: [0, 0], 4: [2, 1], 6: [0, 0], 11: [2, 2]
    }


def test_shards_go_to_ranks_by_their_place_in_the_list(spark):
    shards = spark.createDataFrame([(i,) for i in (1, 2, 5, 9, 12)], "shard_idx bigint")
    ranked = ranks.rank_shards(shards, 3).collect()
    assert sorted(r["shard_idx"] for r in ranked if r["rank"] == 1) == [2, 12]


@pytest.mark.parametrize("n, world", [(4, 3), (6, 3), (2, 5), (1, 4)])
def test_ranks_get_equally_many_sequences(spark, n, world):
    seqs = spark.range(n).withColumnRenamed("id", "position")
    got = {}
    for r in ranks.rank_sequences(seqs, world).collect():
        got.setdefault(r["rank"], {})[r["rank_row"]] = r["position"]
    order = list(range(n))
    while len(order) % world:
        order += list(range(n))[: -len(order) % world]
    assert {k: [v[i] for i in sorted(v)] for k, v in got.items()} == {
        r: order[r::world] for r in range(world)
    }
