import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairloom.functions import text
from pairloom.functions.tokenizers import ByteTokenizer, WordTokenizer
from pairloom.operators import tokens
from pairloom.operators.vocabulary import build_vocabulary, decode_words, encode_words

BYTES = ByteTokenizer()


def one_column(spark, values, name="t"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")


def test_strip_class_is_that_of_python():
    assert set(text.SPACES) == {chr(c) for c in range(0x110000) if chr(c).isspace()}


def test_strip_and_words_are_those_of_python(spark):
    samples = ["　 a ", " x y\x1c", "", " \t\n", "a b\x85c", "plain", "é ü ß"]
    df = one_column(spark, samples).orderBy("i")
    rows = df.select(
        text.strip(F.col("t")), text.word_count(F.col("t")), text.words(F.col("t"))
    ).collect()
    assert [r[0] for r in rows] == [s.strip() for s in samples]
    assert [r[1] for r in rows] == [len(s.split()) for s in samples]
    assert [list(r[2]) for r in rows] == [s.split() for s in samples]


def test_byte_ids(spark):
    want = [100, 198, 172, 240, 152, 159]
    row = one_column(spark, ["aé한"]).select(BYTES.encode(F.col("t")), BYTES.encode_native(F.col("t"))).first()
    assert list(row[0]) == want and list(row[1]) == want


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"])) | st.none(), min_size=1, max_size=30))
def test_bytes_round_trip(spark, values):
    df = one_column(spark, values)
    ids = df.withColumn("ids", BYTES.encode(F.col("t")))
    rows = ids.select("t", "ids", BYTES.count(F.col("t")).alias("n"), BYTES.decode(F.col("ids")).alias("back"))
    for r in rows.collect():
        assert r["back"] == r["t"]
        assert r["ids"] is None if r["t"] is None else (len(r["ids"]) == r["n"])


def test_decoding_skips_special_ids_and_replaces_broken_bytes(spark):
    df = spark.createDataFrame([([1, 100, 0, 2, 101],), ([198],), ([],)], "ids array<int>")
    assert [r[0] for r in df.select(BYTES.decode(F.col("ids"))).collect()] == ["ab", "�", ""]


def test_vocabulary_and_word_ids(spark):
    df = one_column(spark, ["The cat, the dog", "the end.", None])
    words = build_vocabulary(df, "t").orderBy("id")
    rows = [(r["token"], r["n"], r["id"]) for r in words.collect()]
    assert rows == [("the", 3, 3), (",", 1, 4), (".", 1, 5), ("cat", 1, 6), ("dog", 1, 7), ("end", 1, 8)]
    few = words.where("id < 5")
    encoded = encode_words(df, ["i"], {"ids": "t"}, few)
    assert [list(r["ids"]) for r in encoded.orderBy("i").collect()] == [[3, 2, 4, 3, 2], [3, 2, 2], []]
    places = encoded.select("i", F.posexplode("ids").alias("pos", "id"))
    back = decode_words(places, ["i"], "pos", "id", few).orderBy("i").collect()
    assert [r["text"] for r in back] == ["the , the", "the"]
    tokenizer = WordTokenizer([r[0] for r in rows[:2]])
    ids = df.select(tokenizer.encode(F.col("t")).alias("ids"), tokenizer.count(F.col("t")).alias("n"))
    rows = ids.select("ids", "n", tokenizer.decode(F.col("ids")).alias("text")).collect()
    assert [r["ids"] and list(r["ids"]) for r in rows] == [[3, 2, 4, 3, 2], [3, 2, 2], None]
    assert [r["n"] for r in rows] == [5, 3, None]
    assert [r["text"] for r in rows] == ["the , the", "the", None]


def test_markers_lengths_and_limits(spark):
    rows = [(0, "xx", "abc", "abc"), (1, "xx", "abc", "abcd"), (2, "xx", "abcd", "a"), (3, "xx", "", "b")]
    pairs = spark.createDataFrame(rows, "pair_id bigint, lang_pair string, src_text string, tgt_text string")
    counted = tokens.count_tokens(pairs, BYTES)
    assert [r["pair_id"] for r in tokens.within_length(counted, 3).orderBy("pair_id").collect()] == [0, 3]
    for marker, max_len in (("first", None), ("last", 3)):
        both = tokens.encode_pairs(tokens.count_tokens(pairs, BYTES, marker, max_len), BYTES, marker, max_len)
        for r in both.collect():
            assert (len(r["src_ids"]), len(r["tgt_ids"])) == (r["n_src"], r["n_tgt"])
            if marker == "last":
                assert r["src_ids"][-1] == 1 and len(r["src_ids"]) <= 3
            else:
                assert r["src_ids"][0] == 1


def test_limits_count_examined_or_kept_pairs(spark):
    rows = [(0, "xx", "a", "a"), (1, "xx", "aaaa", "a"), (2, "xx", "a", "a"), (3, "xx", "a", "a")]
    pairs = spark.createDataFrame(rows, "pair_id bigint, lang_pair string, src_text string, tgt_text string")
    counted = tokens.count_tokens(pairs, BYTES)
    examined = tokens.within_length(tokens.limit_examined(counted, 2), 3)
    kept = tokens.limit_kept(tokens.within_length(counted, 3), 2)
    assert sorted(r["pair_id"] for r in examined.collect()) == [0]
    assert sorted(r["pair_id"] for r in kept.collect()) == [0, 2]


def test_length_filter_makes_no_ids(spark):
    pairs = spark.createDataFrame([(0, "a", "b")], "pair_id bigint, src_text string, tgt_text string")
    counted = tokens.within_length(tokens.count_tokens(tokens.encode_pairs(pairs, BYTES), BYTES), 3)
    plan = counted.select("pair_id", "n_src")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_ids_that_are_no_bytes_end_the_job(spark):
    df = spark.createDataFrame([([356],)], "ids array<int>")
    with pytest.raises(Exception, match="no byte"):
        df.select(ByteTokenizer().decode(F.col("ids"))).collect()
