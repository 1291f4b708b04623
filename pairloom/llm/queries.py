"""One query per operator of this subpackage, on the whole of its table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pairloom.llm import (
    bestfit,
    chosen_path,
    languages,
    line_runs,
    phrases,
    quality,
    sentencepiece_bpe,
    spelling,
    syncmers,
    toxicity,
    vector_codes,
    warc,
    wavelet,
)
from pairloom.llm.tables import table

END_ID = 2  # fixed value: the id that ends a document in token output


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages.predict(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return sentencepiece_bpe.round_trips(docs, vocabulary("piece_bpe_32k.model"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return wavelet.token_files(docs, vocabulary("word_bpe_49k.json"), END_ID)


def op4_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return syncmers.fingerprints(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return toxicity.predict(docs, labels)


def op7_best_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bestfit.pack(docs, vocabulary("byte_bpe_50k.json"), END_ID)


def op8_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.digests(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.judge(docs, labels)


def op10_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.near_duplicates(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.vocabulary(table(spark, sf_dir, "documents")))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.digests(table(spark, sf_dir, "embeddings"))


def op13_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_runs.digests(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_languages,
        op2_sentencepiece,
        op3_token_files,
        op4_syncmers,
        op5_warc,
        op6_toxicity,
        op7_best_fit,
        op8_phrases,
        op9_quality,
        op10_chosen_path,
        op11_spelling,
        op12_vector_codes,
        op13_line_runs,
    )
}
_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# the nearest entry of each part: squared distance, then index
_ASSIGNED = """a{0} AS MATERIALIZED (
    SELECT vec_id, p, any_value(x) AS x,
           min(64 * ((x[1] - c[1]) ** 2 + (x[2] - c[2]) ** 2 + (x[3] - c[3]) ** 2 + (x[4] - c[4]) ** 2)::BIGINT + e) AS best
    FROM parts JOIN c{0} USING (p) GROUP BY vec_id, p)"""
_MOVED = """c{new} AS MATERIALIZED (
    SELECT p, e, coalesce(m, c) AS c
    FROM c{old} LEFT JOIN (
        SELECT p, best % 64 AS e, [CAST(floor(avg(x[1])) AS BIGINT), CAST(floor(avg(x[2])) AS BIGINT),
                                   CAST(floor(avg(x[3])) AS BIGINT), CAST(floor(avg(x[4])) AS BIGINT)] AS m
        FROM a{old} GROUP BY p, best % 64) USING (p, e))"""

ORACLES: dict[str, str] = {
    "op8_phrases": f"""
WITH docs AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS words FROM documents),
windows AS (SELECT doc_id, p, array_to_string(words[p:p + 19], ' ') AS phrase
            FROM docs, unnest(range(1, len(words) - 18)) AS t(p)),
later AS (SELECT doc_id, p FROM windows
          QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY doc_id, p) > 1),
gone AS (SELECT doc_id, list(DISTINCT p + k) AS places
         FROM later, unnest(range(20)) AS t(k) GROUP BY doc_id)
SELECT doc_id, len(words) AS n_words, coalesce(len(places), 0) AS n_removed,
       sha256(coalesce(array_to_string(list_filter(words, lambda w, i:
           places IS NULL OR NOT list_contains(places, i)), ' '), '')) AS kept_sha256
FROM docs LEFT JOIN gone USING (doc_id)
""",
    "op10_chosen_path": f"""
WITH RECURSIVE docs AS (
    SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS words FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(words[p:p + 4], ' ') AS shingle
             FROM docs, unnest(range(1, greatest(len(words) - 4, least(len(words), 1)) + 1)) AS t(p)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n
           FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
           GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * c.n >= 85 * (x.n + y.n - c.n)),
reach AS (SELECT doc_id, doc_id AS other FROM documents
          UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.other)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, component_id = doc_id AS kept
FROM (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
LEFT JOIN sizes USING (doc_id)
""",
    "op12_vector_codes": f"""
WITH kept AS MATERIALIZED (
    SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(256 * CAST(e AS DOUBLE)) AS BIGINT)) AS x
    FROM embeddings
    WHERE embedding IS NOT NULL
      AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0),
parts AS MATERIALIZED (SELECT vec_id, p, x[4 * p + 1:4 * p + 4] AS x FROM kept, unnest(range(16)) AS t(p)),
c0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x AS c
       FROM parts WHERE vec_id IN (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 64)),
{_ASSIGNED.format(0)}, {_MOVED.format(old=0, new=1)},
{_ASSIGNED.format(1)}, {_MOVED.format(old=1, new=2)},
{_ASSIGNED.format(2)},
books AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS digest FROM c2),
found AS (SELECT vec_id, string_agg(format('{{:02x}}', best % 64), '' ORDER BY p) AS code,
                 CAST(sum(best // 64) AS BIGINT) AS error
          FROM a2 GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       digest AS codebooks_sha256
FROM found JOIN kept USING (vec_id), books
""",
    "op13_line_runs": f"""
WITH lines AS (
    SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1) AS p
    FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, {_LOWER.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
          FROM lines),
found AS (SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40
          GROUP BY key HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (doc_id < last) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p)
                       FILTER (last IS NULL OR doc_id >= last), '')) AS kept_sha256
FROM keyed LEFT JOIN found USING (key) GROUP BY doc_id
""",
    "op5_warc": """
SELECT page_id, strlen(h) AS payload_bytes, d AS payload_digest,
       CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM (SELECT page_id, h, d,
             CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS last
      FROM (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS d FROM pages))
""",
}
