"""Words that a polynomial hash cannot tell apart, long texts, repeated rows, null keys, learners against plain loops."""

import collections
import hashlib
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")

from pairloom.llm import (  # noqa: E402
    bestfit,
    chosen_path,
    languages,
    phrases,
    quality,
    sentencepiece_bpe,
    spans,
    toxicity,
    wavelet,
)
from test_operators import WORD, brute_components, brute_repeats, by_id, sentence, spoken  # noqa: E402

BYTE, PIECE, WORDS = (
    public_tokenizers.path(n)
    for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json")
)
SCHEMA = "doc_id bigint, text string"
RNG = np.random.default_rng(8)


def twins(n):
    """A Thue-Morse word of ``a`` and ``b``, and its complement."""
    bits = np.bitwise_count(np.arange(n, dtype=np.uint64)) & 1
    return ["".join("ab"[b ^ k] for b in bits) for k in (0, 1)]


def ids_of(texts, path, end_id=2):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [[*tokenizer.encode(t or "", add_special_tokens=False).ids, end_id] for t in texts]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("n", [1024, 4096])
def test_twins_are_different_words(spark, n):
    a, b = twins(n)
    assert len(set(spans.byte_hashes(np.frombuffer((a + b).encode(), np.uint8), np.array([0, n]), np.array([n, 2 * n])).tolist())) == 2
    texts = [a, b, f"x {a}", f"x {b}", f"{a}\n{b}"]
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).coalesce(1)
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    pieces = by_id(sentencepiece_bpe.round_trips(df, PIECE))
    files = by_id(wavelet.token_files(df, WORDS, 2))
    packed = collections.defaultdict(list)
    for r in bestfit.pack(df, BYTE, 2).collect():
        packed[r["doc_id"]].append(r)
    for i, (text, word_ids, byte_ids) in enumerate(zip(texts, ids_of(texts, WORDS), ids_of(texts, BYTE))):
        assert pieces[i]["ids_sha256"] == hashlib.sha256(",".join(map(str, library.encode(text))).encode()).hexdigest()
        assert files[i]["ids_crc32"] == crc(word_ids)
        for r in packed[i]:
            assert r["ids_crc32"] == crc(byte_ids[r["start"] : r["start"] + r["length"]])
    assert by_id(quality.judge(df, spark.createDataFrame([], "doc_id bigint, quality int")))[4]["n_dup_lines"] == 0
    few = " ".join(f"w{i}" for i in range(20))
    rows = [(0, few.replace("w7 ", a + " ")), (1, few.replace("w7 ", b + " "))]
    assert [r["n_removed"] for r in phrases.digests(spark.createDataFrame(rows, SCHEMA).coalesce(1)).collect()] == [0, 0]
    found = by_id(chosen_path.near_duplicates(spark.createDataFrame(rows, SCHEMA).coalesce(1)))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in found.items()} == brute_components(rows)


def test_hashes_of_words_in_twin_order():
    """Windows of two words in the order of a Thue-Morse word and of its complement."""
    hashes = spans.byte_hashes(np.frombuffer(b"ab", np.uint8), np.array([0, 1]), np.array([1, 2]))
    bits = (np.bitwise_count(np.arange(64, dtype=np.uint64)) & 1).astype(int)
    both = hashes[np.concatenate([bits, 1 - bits])]
    for n in (2, 5, 8, 20, 64):
        a, b = spans.gram_hashes(both, np.array([0, 64]), n)
        assert a != b


def test_pool_tells_equal_hashes_apart(monkeypatch):
    """All hashes are one: every chunk must still get its own ids."""
    from pairloom.llm import chunk_ids

    monkeypatch.setattr(chunk_ids, "byte_hashes", lambda buf, starts, ends: np.zeros(len(starts), np.uint64))
    pool = chunk_ids.ChunkPool(lambda chunks: chunk_ids.flat_ids([list(c) for c in chunks.to_pylist()]))
    for texts in (["a bb", "bb a", "", "ccc"], ["ccc bb", "d a"]):
        ids, bounds = pool.encode_texts(pa.array(texts))
        assert [bytes(ids[x:y].tolist()).decode() for x, y in zip(bounds, bounds[1:])] == texts


@pytest.fixture(scope="module")
def awkward(spark):
    """A text longer than a slice, repeated rows and rows with null keys."""
    long = " ".join(f"word{i % 9000}" for i in range(160_000))
    assert len(long) > spans.SLICE_BYTES
    rows = [(1, long), (2, None), (None, "no key here"), (None, None), (None, "no key here"), (3, sentence(90)), (1, long), (4, sentence(30))]
    return rows, spark.createDataFrame(rows, SCHEMA).repartition(3)


def counted(rows):
    return collections.Counter(map(repr, rows))


def test_pieces_of_awkward_rows(awkward):
    import sentencepiece

    rows, df = awkward
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    want = [(k, len(ids), hashlib.sha256(library.decode(ids).encode()).hexdigest()) for k, t in rows for ids in [library.encode(t or "")]]
    found = sentencepiece_bpe.round_trips(df, PIECE).select("doc_id", "n_tokens", "decoded_sha256").collect()
    assert counted(map(tuple, found)) == counted(want)


def test_files_and_packs_of_awkward_rows(awkward):
    rows, df = awkward
    order = [(r["doc_id"], r["text"]) for r in df.orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    ids = ids_of([t for _, t in order], WORDS)
    starts = np.cumsum([0, *map(len, ids)])
    found = wavelet.token_files(df, WORDS, 2).collect()
    assert counted(map(tuple, found)) == counted((k, int(s), len(x), crc(x)) for (k, _), s, x in zip(order, starts, ids))
    pieces = bestfit.pack(df, BYTE, 2).collect()
    assert sum(r["length"] for r in pieces) == sum(map(len, ids_of([t for _, t in rows], BYTE)))
    used = collections.Counter()
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 1024


def test_repeats_of_awkward_rows(awkward):
    rows, df = awkward
    found = phrases.digests(df).collect()
    plain = brute_repeats([(k, t) for k, t in {1: rows[0][1], 3: rows[5][1]}.items()])
    assert [tuple(r)[1:] for r in found if r["doc_id"] == 1] == [plain[1]] * 2
    assert [r["n_removed"] for r in found if r["doc_id"] is None] == [0, 0, 0]


@pytest.mark.parametrize("hot_rows, records", [(4096, 10_000), (2, 7)])
def test_hot_passages(spark, monkeypatch, hot_rows, records):
    """A passage that all documents have, so that its anchors are divided; smallest keys at the end."""
    monkeypatch.setattr(phrases, "HOT_ROWS", hot_rows)
    monkeypatch.setattr(phrases, "CARRY_ROWS", 4 * hot_rows)
    monkeypatch.setattr(phrases, "HOT_PLACES", 3)
    passage = sentence(60)
    rows = [(k, f"{sentence(12)} {passage} {sentence(15)}" + (f" {passage}" if k % 5 == 0 else "")) for k in range(40, 0, -1)]
    rows += [(k, f"{passage.rsplit(' ', 25)[0]} {sentence(10)}") for k in range(50, 60)]
    rows += [(99, " ".join(["a b c"] * 200)), (-(1 << 63), passage + " end")]
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, records)
    try:
        found = by_id(phrases.digests(spark.createDataFrame(rows, SCHEMA).repartition(4)))
    finally:
        spark.conf.set(name, before)
    assert {k: (r["n_words"], r["n_removed"], r["kept_sha256"]) for k, r in found.items()} == brute_repeats(rows)


def test_near_duplicates_of_extreme_keys_and_large_units(spark, monkeypatch):
    """The smallest key is a key; null keys are smaller; clusters are cut by shingles."""
    monkeypatch.setattr(chosen_path, "UNIT_SHINGLES", 150)
    base = sentence(120).split()
    low = -(1 << 63)
    rows = [(k, " ".join(base[:j] + ["new"] + base[j + 1 :])) for j, k in enumerate([low, low + 1, 5, 7])]
    rows += [(9, sentence(120)), (None, " ".join(base)), (11, sentence(30)), (None, None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = chosen_path.near_duplicates(df).collect()
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in found if r["n_shingles"]}
    assert got == {low: (None, False), low + 1: (None, False), 5: (None, False), 7: (None, False), 9: (9, True), 11: (11, True), None: (None, True)}
    keyed = chosen_path.near_duplicates(df.where("doc_id is not null")).collect()
    assert {r["doc_id"]: r["component_id"] for r in keyed} == {low: low, low + 1: low, 5: low, 7: low, 9: 9, 11: 11}


def test_only_the_automaton_removes(spark, monkeypatch):
    """With an automaton of other patterns nothing is later."""
    passage = sentence(40)
    texts = pa.array([passage, f"x {passage}"])
    keys, none, place = np.array([1, 2]), np.zeros(2, bool), np.zeros(2, np.int64)
    assert len(phrases.later_windows(texts, keys, none, place)[1]) == 21
    from ahocorasick import STORE_INTS, Automaton

    for patterns in ([], ["zzzz"]):
        other = Automaton(STORE_INTS)
        for p in patterns:
            other.add_word(p, 0)
        other.make_automaton()
        with monkeypatch.context() as patch:
            patch.setattr(phrases, "compiled", lambda _: other)
            assert len(phrases.later_windows(texts, keys, none, place)[1]) == 0
    # half of the patterns: only their windows go
    real = phrases.compiled
    monkeypatch.setattr(phrases, "compiled", lambda patterns: real(patterns[:10]))
    assert len(phrases.later_windows(texts, keys, none, place)[1]) == 10


# learners against plain loops


def plain_languages(model, text):
    """EM over words and the choice of nested sets, one word and one language at a time."""
    words = WORD.findall(text)
    likelihood = []
    for w in words:
        raw = bytes(b + 32 if 65 <= b <= 90 else b for b in w.encode())
        padded = b" " + raw + b"  "
        log_p = np.zeros(len(model.languages))
        for order in languages.ORDERS:
            for i in range(len(padded) - order + 1):
                key = int.from_bytes(order.to_bytes(8, "big") + padded[i : i + order], "big") & (2**64 - 1)
                log_p += model.log_p[(key * 0x9E3779B97F4A7C15 & (2**64 - 1)) >> 48].astype(float)
        likelihood.append(np.exp(np.maximum(log_p - log_p.max(), -languages.WORD_SPREAD)))

    def mixture(chosen):
        share = np.full(len(chosen), 1 / len(chosen))
        for _ in range(languages.STEPS if len(chosen) > 1 else 0):
            parts = [share * p[chosen] / (share * p[chosen]).sum() for p in likelihood]
            share = np.mean(parts, axis=0)
            share /= share.sum()
        return share, sum(np.log((share * p[chosen]).sum()) for p in likelihood)

    full, _ = mixture(list(range(len(model.languages))))
    order = np.argsort(-full, kind="stable").tolist()
    best, found = -np.inf, None
    for size in range(1, len(order) + 1):
        chosen = sorted(order[:size])
        share, value = mixture(chosen)
        value -= languages.PENALTY * (size - 1) * np.log(max(len(words), 2))
        if value > best:
            best, found = value, chosen[int(share.argmax())]
    return model.languages[found], full[found]


@pytest.mark.parametrize("n_languages, cells", [(3, 1 << 21), (64, 5000), (300, 1 << 16)])
def test_inference_is_plain_em(monkeypatch, n_languages, cells):
    monkeypatch.setattr(languages, "CELLS", cells)
    log_p = np.log(RNG.gamma(0.5, 1, (languages.BUCKETS, n_languages)) + 1e-3).astype(np.float32)
    model = languages.Model(tuple(f"l{i:03d}" for i in range(n_languages)), log_p)
    texts = [sentence(25) + " " + spoken("aa", 30), spoken("bb", 12), "One", "", sentence(6), spoken("cc", 40)]
    names, scores = languages.infer(model, pa.array(texts))
    for text, name, score in zip(texts, names, scores):
        if not text:
            assert (name, score) == ("und", 0)
        else:
            plain, share = plain_languages(model, text)
            assert name == plain and abs(score - share) < 1e-3


def test_no_language_is_dropped(spark):
    """300 languages, each with a word of its own; a repeated key counts once."""
    rows = [(i, " ".join([f"q{i // 4}x{i // 4 * 7}zz"] * 12), f"l{i // 4:03d}") for i in range(1200)]
    rows += [(2, "other words", "l000")] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = languages.fit(df)
    assert len(model.languages) == 300
    found = [r for r in languages.predict(df).collect() if not r["held_out"] and r["doc_id"] != 2]
    assert np.mean([r["lang_pred"] == f"l{r['doc_id'] // 4:03d}" for r in found]) > 0.97


def test_languages_of_many_slices(spark, monkeypatch):
    """Slices in the middle of a batch, with texts that are null or have no letter."""
    monkeypatch.setattr(spans, "SLICE_BYTES", 60)
    monkeypatch.setattr(spans.slices, "__defaults__", (60,))
    rows = [(i, spoken(l, 6) if i % 7 else (None, "12 3", "")[i % 3], l) for i, l in enumerate(np.tile(["aa", "bb"], 60).tolist())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").coalesce(1)
    found = by_id(languages.predict(df))
    for key, text, lang in rows:
        assert found[key]["lang_pred"] == (lang if text and not text.startswith("12") else "und")
    kept = languages.keep_known(df.withColumn("lang_score", F.lit("x")))
    assert sorted(r["doc_id"] for r in kept.collect()) == [k for k, t, _ in rows if t and not t.startswith("12")]


def plain_ftrl(rows, labels):
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    bias = 1 << toxicity.BITS
    seen = collections.Counter(int(f) for r in rows for f in r)

    def weight(f):
        l1 = 0.0 if f == bias else toxicity.L1
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - np.sign(z[f]) * l1) / ((toxicity.BETA + n[f] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for r, label in zip(rows, labels):
            own = [int(f) for f in r if seen[int(f)] >= toxicity.MIN_ROWS] + [bias]
            w = {f: weight(f) for f in own}
            g = 1 / (1 + np.exp(-sum(w.values()))) - label
            for f in own:
                sigma = ((n[f] + g * g) ** 0.5 - n[f] ** 0.5) / toxicity.ALPHA
                z[f] += g - sigma * w[f]
                n[f] += g * g
    return {f: weight(f) for f in z if f != bias and weight(f)}, weight(bias)


def test_training_is_plain_ftrl():
    rows = [np.unique(RNG.integers(0, 60, RNG.integers(1, 12))).astype(np.int32) for _ in range(300)]
    labels = np.array([float(3 in r or 7 in r) for r in rows])
    model = toxicity.train(rows, labels)
    weights, bias = plain_ftrl(rows, labels)
    assert set(model.features.tolist()) == set(weights) and len(weights) > 3
    assert np.allclose(model.weights, [weights[f] for f in model.features.tolist()]) and abs(model.bias - bias) < 1e-9


@pytest.mark.parametrize("path", [BYTE, WORDS])
def test_chunks_end_before_marks(monkeypatch, path):
    """Letters, marks and marks that join them in any order: the ids are the library's."""
    from tokenizers import Tokenizer

    from pairloom.llm import chunk_ids

    alphabet = list("abSTJKzZ019'\"=<>|.,-_`^# \n\t") + ["'s", "'LL", "\u0301", "\u030c", "\u0338", "é", "Σ", "ς", "×", "…", "\u212a", "\u037e", "\u1fef", "\x00", "\x7f", "中", "😀"]
    texts = ["".join(RNG.choice(alphabet, RNG.integers(0, 40))) for _ in range(4000)]
    texts += ["", "a", ",", "a,", "J\u030c,", "=\u0338", "a=\u0338", "don't", "DON'T", "x's's", "Z", "éZ", "\u0301A"]
    library = Tokenizer.from_file(path)
    spans.worker_cache(None)
    ids, bounds = chunk_ids.tokenizers_encoder(path)(pa.array(texts))
    got = [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])]
    assert got == [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    # words with different marks behind them are given to the library once
    given = []
    joined = chunk_ids.encode_joined
    monkeypatch.setattr(chunk_ids, "encode_joined", lambda t, chunks: given.extend(chunks.to_pylist()) or joined(t, chunks))
    spans.worker_cache(None)
    chunk_ids.tokenizers_encoder(path)(pa.array([" one one, one. one! ONE one; (one) two-one"]))
    assert sum(b"one" in chunk.lower() for chunk in given) <= (4 if path == BYTE else 3)
    spans.worker_cache(None)


def segment_batch(anchor, part, words):
    n = np.arange(len(words))
    columns = {"anchor": anchor, "part": part, "key": n, "none": n < 0, "row": n, "place": n * 0, "words": words}
    return phrases.record_batch(phrases.SEGMENTS, columns)


def test_segments_settle_by_their_bytes(monkeypatch):
    """Long words: a batch of segments is many shards, and no group is cut."""
    texts = [" ".join(f"{i}x{j}".ljust(600, "w") for j in range(32)) for i in range(200)]
    batch = segment_batch(np.repeat(np.arange(200), 2), np.full(400, -1), [t for t in texts for _ in range(2)])
    settled, sizes = phrases._settled, []
    monkeypatch.setattr(phrases, "_settled", lambda rows: (sizes.append(rows["words"].nbytes), settled(rows))[1])
    found = pa.Table.from_batches(phrases.shards(iter([batch]), ["anchor", "part"])).to_pydict()
    assert found["key"] == list(range(1, 400, 2)) and set(found["later"]) == {(1 << phrases.SEGMENT) - 1}
    assert max(sizes) < 1.1 * phrases.SHARD_BYTES < batch.nbytes / 6


def test_first_windows_of_a_large_group():
    """Windows that go on by themselves come in bounded batches, each of them about twice at most."""
    n = 3 * phrases.CARRY_ROWS // 2
    texts = [" ".join(f"{i}x{j}" for j in range(32)) for i in range(n)]
    texts[-1] = texts[0]
    batches = [segment_batch(np.zeros(n), np.zeros(n), texts).slice(at, 10_000) for at in range(0, n, 10_000)]
    found = list(phrases.shards(iter(batches), ["anchor", "part"]))
    assert max(b.num_rows for b in found) <= phrases.FIRST_ROWS
    rows = [r for b in found for r in b.to_pylist()]
    later = [(r["key"], r["later"]) for r in rows if r["words"] is None]
    assert later == [(n - 1, (1 << phrases.SEGMENT) - 1)]
    first = collections.Counter((r["key"], r["place"], r["words"]) for r in rows if r["words"] is not None)
    assert len(first) == (n - 1) * phrases.SEGMENT and max(first.values()) <= 3
    assert all(" ".join(texts[k].split(" ")[p : p + phrases.WINDOW]) == w for k, p, w in first)


def test_pieces_take_little_more_than_their_bytes():
    buf = np.frombuffer(("abcdefghi " * 100_000).encode(), np.uint8)
    starts = np.append(np.arange(0, 900_000, 10), 0)
    ends = np.append(starts[:-1] + 100, len(buf))  # overlapping ones, and one that is larger than a block
    tracemalloc.start()
    pieces = phrases._pieces(buf, starts, ends)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    raw = buf.tobytes()
    assert pieces.to_pylist() == [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
    assert peak < 3 * int((ends - starts).sum())
    assert len(phrases._pieces(buf, starts[:0], ends[:0])) == 0
