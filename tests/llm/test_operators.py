"""The ten operators against brute force, on small tables with awkward rows."""

import collections
import hashlib
import re
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
    syncmers,
    toxicity,
    warc,
    wavelet,
)

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
BYTE, PIECE, WORDS = (
    public_tokenizers.path(n)
    for n in ("byte_bpe_50k.json", "piece_bpe_32k.model", "word_bpe_49k.json")
)
RNG = np.random.default_rng(4)
PASSAGE = " ".join(f"passage{i % 23}x{i}" for i in range(60))


def sentence(n: int) -> str:
    return " ".join(f"w{RNG.integers(0, 4000)}" for _ in range(n))


def awkward_texts() -> list[str | None]:
    base = sentence(300)
    near = base.split()
    near[100] = "CHANGED"
    return [
        None, "", " ", "\n\t ", "One", "one", "a b c", "  lead  and\ttail \n", base, base, " ".join(near),
        base.upper(), sentence(40) + " " + PASSAGE + " " + sentence(30),
        PASSAGE + "\n" + sentence(25) + "\n" + PASSAGE, PASSAGE + " " + PASSAGE, "x" * 5000,
        "the same line\nthe same line\n\n the same line\nother " * 5, "日本語 テスト ▁ a▁ b ﬁ é é", "a b　c \x85d <|endoftext|> </s> x;\r y",
        "#*$ %&|<> !! 12 34", sentence(3000), *[sentence(int(n)) for n in RNG.integers(5, 200, 30)],
    ]


@pytest.fixture(scope="module")
def texts():
    return awkward_texts()


@pytest.fixture(scope="module")
def docs(spark, texts):
    """Extra columns have names that the operators use themselves."""
    rows = [(i * 3, t, ("en", "de")[i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    clash = ("key", "n_words", "k0", "task", "block", "component", "page_id", "places")
    return df.withColumns({c: F.lit(i) for i, c in enumerate(clash)}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_sentencepiece_is_the_library(spark, docs, texts, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    found = by_id(sentencepiece_bpe.round_trips(docs, PIECE))
    assert len(found) == len(texts)
    for i, text in enumerate(texts):
        ids = library.encode(text or "")
        row = found[i * 3]
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids).encode()).hexdigest()
    assert sentencepiece_bpe.round_trips(empty, PIECE).count() == 0


def library_ids(path, texts, end):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return [tokenizer.encode(t or "", add_special_tokens=False).ids + [end] for t in texts]


def crc(ids) -> int:
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_token_files_round_trip(spark, docs, texts, empty):
    found = by_id(wavelet.token_files(docs, WORDS, 2))
    start = 0
    for i, ids in enumerate(library_ids(WORDS, texts, 2)):
        row = found[i * 3]
        assert (row["start"], row["n_tokens"], row["ids_crc32"]) == (start, len(ids), crc(ids))
        start += len(ids)
    assert wavelet.token_files(empty, WORDS, 2).count() == 0


def test_small_shards_and_null_keys(spark, docs, texts, tmp_path):
    keyed = docs.withColumn("doc_id", F.when(F.col("doc_id") > 6, F.col("doc_id")))
    manifest = wavelet.write_shards(keyed, WORDS, 2, f"file://{tmp_path}/shards", shard_tokens=500)
    rows = manifest.orderBy("seq").collect()
    assert len(rows) > 5
    total = 0
    for row in rows:
        assert row["start"] == total
        total += row["n_tokens"]
    assert total == sum(map(len, library_ids(WORDS, texts, 2)))
    assert wavelet.read_shards(manifest).where("doc_id is null").count() == 3


@pytest.mark.parametrize("n", [0, 1, 7, 8, 1000])
def test_wavelet_queries(n, monkeypatch):
    monkeypatch.setattr(wavelet, "BLOCK_BITS", 64)
    ids = RNG.integers(0, 50, n).astype(np.int32)
    matrix = wavelet.WaveletMatrix(wavelet.build(ids, [1], np.array([n])))
    assert matrix.tokens().tolist() == ids.tolist()
    assert [matrix.access(i) for i in range(n)] == ids.tolist()
    for token in (0, 3, 49, 63, 64, 1000):
        places = np.flatnonzero(ids == token).tolist()
        assert matrix.occurrences(token) == places
        for i in (0, n // 2, n):
            assert matrix.rank(token, i) == sum(p < i for p in places)


def test_packing_is_gapless(spark, docs, texts, empty):
    for open_bins, capacity in ((1024, 1024), (2, 64)):
        rows = bestfit.pack(docs, BYTE, 2, capacity, open_bins).collect()
        pieces, bins = collections.defaultdict(list), collections.defaultdict(list)
        for r in rows:
            pieces[r["doc_id"]].append(r)
            bins[r["sequence_id"]].append((r["offset"], r["length"]))
        for i, ids in enumerate(library_ids(BYTE, texts, 2)):
            at = 0
            for k, r in enumerate(sorted(pieces[i * 3], key=lambda r: r["piece"])):
                assert (r["piece"], r["start"]) == (k, at)
                assert r["length"] == capacity or k == 0
                assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
                at += r["length"]
            assert at == len(ids)
        for placed in bins.values():
            at = 0
            for offset, length in sorted(placed):
                assert offset == at
                at += length
            assert at <= capacity
    assert bestfit.pack(empty, BYTE, 2).count() == 0


def test_best_fit_rule():
    packer = bestfit.BestFit(10, open_bins=2)
    assert packer.put(6) == (0, 0) and packer.put(3) == (0, 6)  # free: 1
    assert packer.put(8) == (1, 0)  # free: 2
    assert packer.put(2) == (1, 8)  # the best fit; full
    assert packer.put(5) == (2, 0)
    assert packer.put(7) == (3, 0)  # the fullest, bin 0, closes
    assert packer.put(1) == (3, 7)


def brute_statistics(text):
    text = text or ""
    words = WORD.findall(text)
    grams = collections.Counter(zip(words, words[1:], words[2:]))
    covered = {
        i + k for i in range(len(words) - 2) for k in range(3) if grams[tuple(words[i : i + 3])] > 1
    }
    seen, repeated = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_quality_statistics(spark, docs, texts, empty):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    found = by_id(quality.judge(docs, labels))
    for i, text in enumerate(texts):
        expected = brute_statistics(text)
        row = found[i * 3]
        assert tuple(row[c] for c in quality.STATISTICS) == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert (row["base_failed"], row["kept"]) == (failed, not failed)
    assert quality.judge(empty, labels).count() == 0
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["kept"] for r in found.values())


def test_models_learn_from_one_row_of_each_key(spark, monkeypatch):
    rows = [(i, sentence(60) + " tail" * (i % 7)) for i in range(60)]
    more = [*rows, *[(i, text) for i, text in rows for _ in range(3)]]
    one, many = (spark.createDataFrame(x, "doc_id bigint, text string") for x in (rows, more))
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(60)], "doc_id bigint, quality int, toxic int")
    seen = []
    monkeypatch.setattr(quality, "learn_rules", lambda counts, bad: seen.append((len(bad), counts["n_words"].tolist())) or [])
    for docs in (one, many):
        quality.fit(docs, labels)
    assert seen[0] == seen[1] and seen[0][0] == 60
    a, b = (toxicity.fit(docs, labels) for docs in (one, many))
    assert a.bias == b.bias and sorted(zip(a.features, a.weights)) == sorted(zip(b.features, b.weights))


def test_decision_list_finds_the_rule():
    n = 3000
    counts = {c: RNG.integers(1, 100, n) for c in (*quality.STATISTICS, *quality.OTHER_STATISTICS)}
    counts["n_words"] = RNG.integers(100, 400, n)
    bad = (counts["n_symbols"] / counts["n_words"] > 0.25) & (counts["n_words"] < 300)
    rules = quality.learn_rules(counts, bad)
    x = quality.ratios(counts)
    said = np.zeros(n, bool)
    for rule in rules:
        said |= quality._covers(rule, x, n)
    assert (said == bad).mean() > 0.97
    assert quality.learn_rules(counts, np.zeros(n, bool)) == []


def test_rules_in_spark_are_those_of_the_sample(spark):
    rules = [(quality.Condition("symbols_per_word", True, 0.5),), (quality.Condition("words", False, 3.0), quality.Condition("upper_per_char", True, 0.1))]
    rows = [(0, 0, 0, 0), (2, 2, 9, 0), (2, 0, 9, 3), (9, 0, 20, 20), (4, 1, 10, 9)]
    df = spark.createDataFrame(rows, "n_words int, n_symbols int, word_chars int, n_upper int")
    assert [r[0] for r in df.select(quality.verdict(rules)).collect()] == [True, False, False, True, True]


def brute_repeats(rows):
    seen, out = {}, {}
    for key, text in sorted(rows):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - 19):
            if seen.setdefault(tuple(words[i : i + 20]), (key, i)) != (key, i):
                gone.update(range(i, i + 20))
        kept = [w for i, w in enumerate(words) if i not in gone]
        out[key] = len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()
    return out


def test_repeats_go(spark, docs, texts, empty):
    expected = brute_repeats([(i * 3, t) for i, t in enumerate(texts)])
    rows = phrases.digests(docs).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows} == expected
    assert sum(n for _, n, _ in expected.values()) > 500
    cleaned = phrases.without_repeats(docs)
    assert cleaned.columns == docs.columns and cleaned.count() == len(texts)
    assert phrases.digests(empty).count() == 0


def test_overlapping_repeats_in_one_text(spark):
    text = " ".join(["a b c"] * 30)
    df = spark.createDataFrame([(1, text), (2, text), (None, "x " * 19)], "doc_id bigint, text string")
    found = {r["doc_id"]: r["n_removed"] for r in phrases.digests(df).collect()}
    assert found == {1: brute_repeats([(1, text)])[1][1], 2: 90, None: 0}


def brute_rows(rows):
    """Words lost by each row: a window stays at the smallest key and place of its phrase."""
    windows = [[(tuple(w[i : i + 20]), (key is not None, key or 0, i)) for i in range(len(w) - 19)]
               for key, text in rows for w in [WORD.findall(text)]]
    first = {}
    for phrase, place in sorted((x for w in windows for x in w), key=lambda x: x[1]):
        first.setdefault(phrase, place)
    return [len({i + k for i, (phrase, place) in enumerate(w) if first[phrase] != place for k in range(20)}) for w in windows]


@pytest.fixture
def short_batches(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    yield lambda n: spark.conf.set(name, n)
    spark.conf.set(name, before)


@pytest.mark.parametrize("parts,records", [(1, 10_000), (5, 3)])
def test_repeats_in_rows_that_share_a_key(spark, short_batches, parts, records):
    short_batches(records)
    p, q = (" ".join(f"{name}{i}" for i in range(n)) for name, n in (("p", 20), ("q", 45)))
    clean, other = sentence(150), sentence(60)
    rows = [
        (1, f"{p} {p}"), (1, f"{p} {p}"), (2, f"{p} {q} {q}"), (2, f"{q} {q} {p}"), (2, f"{p} {q} {q}"),
        (None, f"{q} {other} {q}"), (None, clean), (None, f"{q} {other} {q}"), (None, f"{q} {clean}"),
        (2**62 + 1, q), (2**62, q),
    ]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)
    found = phrases.without_repeats(df.withColumn("was", F.col("text"))).collect()
    got = sorted((str(r["doc_id"]), r["was"], len(r["was"].split()) - len(r["text"].split())) for r in found)
    want = sorted((str(key), text, n) for (key, text), n in zip(rows, brute_rows(rows)))
    assert got == want and (str(None), clean, 0) in got
    twice = df.where("doc_id = 1")
    assert [r["n_removed"] for r in phrases.digests(twice).collect()] == [20, 20]


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_components(rows):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").translate(LOWER))
        grams = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        sets.append(grams or ({tuple(words)} if words else set()))
    root = list(range(len(rows)))
    for _ in rows:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 85 * len(a | b):
                    root[i] = root[j] = min(root[i], root[j])
    return {key: (len(s), rows[root[i]][0]) for i, ((key, _), s) in enumerate(zip(rows, sets))}


@pytest.mark.parametrize("node_sets,trees", [(2048, 10), (3, 16)])
def test_near_duplicates(spark, docs, texts, empty, node_sets, trees):
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    base = sentence(200).split()
    for k in range(40):  # a group of copies with a few changes each
        copy = list(base)
        for at in RNG.integers(0, 200, k % 6):
            copy[at] = f"new{RNG.integers(0, 10**6)}"
        rows.append((1000 + k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = by_id(chosen_path.near_duplicates(df, trees=trees, node_sets=node_sets))
    expected = brute_components(rows)
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in found.items()} == expected
    assert all(r["kept"] == (r["component_id"] == k) for k, r in found.items())
    kept = chosen_path.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    assert chosen_path.near_duplicates(empty).count() == 0


def test_near_duplicates_with_null_and_repeated_keys(spark):
    text = sentence(50)
    rows = [(None, text), (5, text), (5, sentence(60)), (7, text), (8, ""), (9, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = [(r["doc_id"], r["component_id"], r["kept"]) for r in chosen_path.near_duplicates(df).collect()]
    assert sorted(found, key=str) == sorted(
        [(None, None, True), (5, None, False), (5, None, False), (7, None, False), (8, 8, True), (9, 9, True)], key=str
    )
    assert chosen_path.keep_one_of_each(df).count() == 3


def alike(a: str, b: str) -> float:
    """Likeness from the elements in two fingerprint strings."""
    x, y = set(a.split()), set(b.split())
    return len(x & y) / max(len(x), len(y)) if x or y else 1.0


def test_syncmers(spark, docs, texts, empty):
    found = by_id(syncmers.fingerprints(docs))
    strings = [t or "" for t in texts]
    seen = {}
    for i, text in enumerate(strings):
        row, after = found[i * 3], strings[(i + 1) % len(strings)]
        quarter = len(text) // 4
        edited = text[: len(text) - quarter] + after[:quarter]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert seen.setdefault(text, row["fingerprint"]) == row["fingerprint"]
        assert bool(row["fingerprint"]) == bool(WORD.findall(text))
        assert abs(row["near_edited"] - alike(row["fingerprint"], row["edited_fingerprint"])) < 1e-12
        following = found[(i + 1) % len(strings) * 3]["fingerprint"]
        assert abs(row["near_next"] - alike(row["fingerprint"], following)) < 1e-12
    fingerprint_of = dict(zip(strings, (found[i * 3]["fingerprint"] for i in range(len(strings)))))
    assert len(set(fingerprint_of.values())) == len({tuple(WORD.findall(t)) for t in strings})
    long = [found[i * 3] for i, t in enumerate(strings) if len(WORD.findall(t)) > 100 and i not in (14, 16)]
    assert np.mean([r["near_edited"] for r in long]) > 0.6
    assert syncmers.fingerprints(empty).count() == 0


@pytest.mark.parametrize("n", [1, 3, 60])
def test_syncmers_in_plain_python(spark, n):
    """The choice of anchors, with Spark's own hash of each run of words, between the marks."""
    text = sentence(n)
    marks = [[f"\n{side}{i}" for i in range(5)] for side in "<>"]
    words = [*marks[0], *text.split(), *marks[1]]
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    hashed = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i int, w string")
    h = [r[0] for r in hashed.orderBy("i").select(F.xxhash64("w")).collect()]
    pairs = spark.createDataFrame(list(zip(range(len(h)), h, h[1:])), "i int, a bigint, b bigint")
    g = [r[0] for r in pairs.orderBy("i").select(F.xxhash64("a", "b")).collect()]
    at = [i for i in range(len(h) - 5) if min(g[i : i + 5]) in (g[i], g[i + 4])]
    runs = [(j, h[p : p + 6], p - at[j - 1] if j else 0) for j, p in enumerate(at)]
    expected = [
        r[0]
        for r in spark.createDataFrame(runs, "j int, h array<bigint>, gap int").orderBy("j").select(F.hash("h", "gap")).collect()
    ]
    row = syncmers.fingerprints(df).first()
    assert expected and row["fingerprint"] == " ".join(map(str, dict.fromkeys(expected)))
    assert row["near_next"] == 1.0  # the only document follows itself


def test_next_document(spark):
    """Keys far apart, null keys, keys that are repeated with other texts and with the same one."""
    keys = [None, None, -(2**63), -5, 0, 1, 1, 2, 900, 2**62, 2**63 - 1]
    rows = [(k, f"text number {i} of them") for i, k in enumerate(keys)]
    df = spark.createDataFrame([*rows, rows[4], rows[0]], "doc_id bigint, text string").repartition(3)
    order = [r["text"] for r in df.distinct().orderBy(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).collect()]
    found = syncmers.with_next(df).collect()
    assert len(found) == len(rows) + 2
    for r in found:
        after = order[(order.index(r["text"]) + 1) % len(order)]
        assert r["head"] == after[: len(r["text"]) // 4]
    got = {(r["doc_id"], r["text"]) for r in found}
    assert got == set(rows)


def pages_table(spark, rows):
    return spark.createDataFrame(rows, "page_id bigint, url string, html string")


def test_archives(spark, tmp_path):
    long, other = "é" * 700, "b" * 1500
    rows = [
        (1, "http://a/\r\nx", long), (2, None, long), (9, "http://c", long), (3, "u", other), (4, "u", "short"),
        (5, "u", "short"), (6, "u", None), (7, "u", ""), (8, "u", other), (8, "u", other), (None, "u", other),
    ]
    df = pages_table(spark, rows).withColumn("digest", F.lit(1)).withColumn("task", F.lit("x"))
    manifest = warc.write_archives(df, f"file://{tmp_path}/a", roll_bytes=600)
    assert manifest.count() >= 3
    found = collections.Counter(tuple(r) for r in warc.read_archives(manifest).collect())
    last = {long: 9, other: 8}
    expected = collections.Counter()
    for page, _, html in rows:
        data = (html or "").encode()
        first = expected_response = len(data) < 1000 or last[html] == page
        row = (page, len(data), hashlib.sha1(data).hexdigest())
        if expected_response and (*row, "response", None) in expected and len(data) >= 1000:
            first = False
        expected[(*row, "response", None) if first else (*row, "revisit", last[html])] += 1
    assert found == expected
    again = warc.write_archives(df, f"file://{tmp_path}/b", roll_bytes=600)
    digests = lambda m: sorted(r["file_sha1"] for r in m.collect())
    assert digests(manifest) == digests(again)
    assert not list(tmp_path.rglob("*.tmp"))
    assert warc.archived(pages_table(spark, [])).count() == 0


def spoken(language: str, n: int) -> str:
    syllables = {"aa": "ba be bi bo bu", "bb": "kra kre kri kro kru", "cc": "zon zan zin zul zet"}[language].split()
    return " ".join("".join(RNG.choice(syllables, 3)) for _ in range(n))


def test_languages(spark, empty):
    rows = [(i, spoken(l, 40), l) for i, l in enumerate(np.tile(["aa", "bb", "cc"], 60).tolist())]
    rows += [(900, None, "aa"), (901, "123 !!", "aa"), (902, "", None), (903, "É", None), (None, spoken("bb", 30), None)]
    rows.append((904, spoken("aa", 30) + " " + spoken("cc", 10), None))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit(7))
    found = by_id(languages.predict(df))
    for key, _, lang in rows[:180]:
        assert found[key]["lang_pred"] == lang
        assert found[key]["held_out"] == (zlib.crc32(str(key).encode()) % 5 == 0)
    assert [found[k]["lang_pred"] for k in (900, 901, 902)] == ["und"] * 3
    assert found[903]["lang_pred"] != "und" and found[None]["lang_pred"] == "bb"
    assert found[904]["lang_pred"] == "aa" and 0.6 < found[904]["score"] < 0.9
    kept = languages.keep_known(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 3
    assert languages.predict(empty).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in languages.predict(unlabelled).collect()} == {"und"}


def test_mixture_uses_no_more_languages_than_pay():
    model = languages.Model(("x", "y"), np.zeros((languages.BUCKETS, 2), np.float32))
    names, scores = languages.infer(model, pa.array(["same words here", ""]))
    assert names == ["x", "und"] and abs(scores[0] - 0.5) < 1e-6


def test_toxicity(spark, empty):
    rows, labels = [], []
    for i in range(800):
        words = sentence(40).split()
        if i % 5 == 0:
            words[int(RNG.integers(0, 40))] = ("Grobble!", "grobble", "snarf,")[i % 3]
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(i % 5 == 0)))
    rows += [(1000, None, None, None, None), (1001, "", None, None, None), (1002, "!!", None, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    marks = spark.createDataFrame([*labels, (None, 1), (3, None), (1, 0)], "doc_id bigint, toxic int")
    found = by_id(toxicity.predict(df, marks))
    held = [(found[i]["predicted"], y) for i, y in labels if found[i]["held_out"]]
    assert 100 < len(held) < 300
    assert np.mean([p == y for p, y in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert found[1000]["score"] == found[1001]["score"] == found[1002]["score"]
    assert toxicity.predict(empty, marks).count() == 0
    none = toxicity.predict(df, marks.where("false"))
    assert {r["score"] for r in none.collect()} == {0.5}
