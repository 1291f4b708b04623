"""The queries as SQL over the given tables, written independently of Spark.

Common steps are named tables; each query names those it needs.
"""

from __future__ import annotations

from pairloom.functions.text import SPACE_CLASS
from pairloom.operators.permutation import PRIME, round_keys
from pairloom.plans.inputs import CHUNK, MAX_LEN, SHARD_SIZE
from pairloom.plans.stem_sql import stems

BATCH_SIZE = 8
FULL_STOP = ord(".") + 3
PROMPT = "Translate English to Korean: "


def _strip(text: str) -> str:
    return f"regexp_replace({text}, '^[{SPACE_CLASS}]+|[{SPACE_CLASS}]+$', '', 'g')"


def _n_bytes(text: str) -> str:
    return f"octet_length(encode({text}))"


def _bytes(text: str) -> str:
    """Byte ids of a text."""
    digits = f"('0x' || substr(hex({text}), CAST(2 * i - 1 AS BIGINT), 2))::INT + 3"
    return f"list_transform(range(1, {_n_bytes(text)} + 1), lambda i: {digits})"


def _words(text: str) -> str:
    return f"regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}\\s]')"


def _text(values: str) -> str:
    """A list as one string; empty lists give an empty string."""
    return f"coalesce(array_to_string({values}, ' '), '')"


STEPS = {
    "conversation_pairs": """
        SELECT conv_id, turn, 'en-xx' AS lang_pair, text AS src_text, next_text AS tgt_text
        FROM (SELECT *, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text
              FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
        WHERE role = 'user' AND next_role = 'assistant'""",
    "numbered_pairs": """
        SELECT row_number() OVER (ORDER BY conv_id, turn) - 1 AS pair_id,
               lang_pair, src_text, tgt_text
        FROM conversation_pairs""",
    "document_lines": """
        SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line,
               generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no
        FROM documents""",
    "line_pairs": """
        SELECT CAST(a.doc_id // 2 AS BIGINT) AS file_no, CAST(a.line_no AS BIGINT) AS line_no,
               a.lang || '-zz' AS lang_pair, a.line AS src_text, b.line AS tgt_text
        FROM document_lines a JOIN document_lines b
          ON b.doc_id = a.doc_id + 1 AND b.line_no = a.line_no
        WHERE a.doc_id % 2 = 0""",
    "numbered_line_pairs": """
        SELECT row_number() OVER (ORDER BY file_no, line_no) - 1 AS pair_id, *
        FROM line_pairs""",
}


def _counted(source: str, keys: str) -> str:
    return f"""
        SELECT {keys}, {_strip('src_text')} AS src_text, {_strip('tgt_text')} AS tgt_text,
               {_n_bytes(_strip('src_text'))} + 1 AS n_src,
               {_n_bytes(_strip('tgt_text'))} + 1 AS n_tgt
        FROM {source}"""


def _greedy(source: str, order: str) -> str:
    """Rows of ``source`` (lang_pair, ``order``, tok) with their shard, row by row."""
    return f"""
        SELECT lang_pair, {order}, 0 AS shard_idx, tok AS open_tokens, rn
        FROM {source} WHERE rn = 1
        UNION ALL
        SELECT k.lang_pair, k.{order},
               CASE WHEN g.open_tokens >= {SHARD_SIZE} THEN g.shard_idx + 1 ELSE g.shard_idx END,
               CASE WHEN g.open_tokens >= {SHARD_SIZE} THEN k.tok ELSE g.open_tokens + k.tok END,
               k.rn
        FROM greedy g JOIN {source} k ON k.lang_pair = g.lang_pair AND k.rn = g.rn + 1"""


def _in_order(source: str, order: str, tok: str) -> str:
    return f"""
        SELECT lang_pair, {order}, {tok} AS tok,
               row_number() OVER (PARTITION BY lang_pair ORDER BY {order}) AS rn
        FROM {source}"""


STEPS |= {
    "counted": _counted("numbered_pairs", "pair_id, lang_pair"),
    "counted_conversations": _counted("conversation_pairs", "conv_id, turn, lang_pair"),
    "counted_lines": _counted("numbered_line_pairs", "pair_id, lang_pair"),
    "counted_all": "SELECT * FROM counted UNION ALL SELECT * FROM counted_lines",
    "ordered": _in_order("counted_all", "pair_id", "n_src + n_tgt"),
    "ordered_lines": _in_order("counted_lines", "pair_id", "n_src + n_tgt"),
    "ordered_conversations": _in_order("counted", "pair_id", "n_src + n_tgt"),
    # packed pairs and what the loader finds in them
    "packed": f"""
        SELECT k.pair_id, k.lang_pair, CAST(g.shard_idx AS BIGINT) AS shard_idx,
               CASE WHEN g.shard_idx = 0 THEN 'val' ELSE 'train' END AS split,
               CAST(k.n_src AS BIGINT) AS n_src, CAST(k.n_tgt AS BIGINT) AS n_tgt,
               list_prepend(1, {_bytes('k.src_text')}) AS src_ids,
               list_prepend(1, {_bytes('k.tgt_text')}) AS tgt_ids
        FROM counted_all k JOIN greedy g USING (lang_pair, pair_id)""",
    "stream": """
        SELECT lang_pair, split, shard_idx, side, flatten(list(ids ORDER BY pair_id)) AS tokens
        FROM (SELECT lang_pair, split, shard_idx, pair_id, 'src' AS side, src_ids AS ids FROM packed
              UNION ALL SELECT lang_pair, split, shard_idx, pair_id, 'tgt', tgt_ids FROM packed)
        GROUP BY lang_pair, split, shard_idx, side""",
    "tokens": """
        SELECT lang_pair, split, shard_idx, side, unnest(tokens) AS token,
               generate_subscripts(tokens, 1) - 1 AS pos
        FROM stream""",
    "sequences": """
        SELECT lang_pair, split, shard_idx, seq_id, source, target,
               row_number() OVER (PARTITION BY lang_pair, split ORDER BY shard_idx, seq_id) - 1 AS n
        FROM (SELECT lang_pair, split, shard_idx, src_ids AS source, tgt_ids AS target,
                     row_number() OVER (PARTITION BY lang_pair, shard_idx ORDER BY pair_id) - 1
                     AS seq_id
              FROM packed)""",
    "batches": f"""
        SELECT lang_pair, split, shard_idx, seq_id, n, CAST(n // {BATCH_SIZE} AS BIGINT) AS batch_id,
               CAST(n % {BATCH_SIZE} AS BIGINT) AS row_in_batch, source, target
        FROM sequences""",
    "padded": """
        SELECT lang_pair, split, shard_idx, seq_id, batch_id, row_in_batch,
               len(source) AS src_lengths, len(target) AS tgt_lengths,
               list_resize(source, max(len(source)) OVER b, 0) AS source,
               list_resize(target, max(len(target)) OVER b, 0) AS target
        FROM batches WINDOW b AS (PARTITION BY lang_pair, split, batch_id)""",
    "runlog": """
        SELECT CAST(event_id AS BIGINT) AS step,
               CASE WHEN event_type = 'view' THEN 'val' ELSE 'train' END AS split, value AS loss
        FROM events""",
    "word_counts": f"""
        SELECT token, count(*) AS n
        FROM (SELECT unnest({_words("src_text || ' ' || tgt_text")}) AS token
              FROM conversation_pairs)
        GROUP BY token""",
    "vocabulary": """
        SELECT token, row_number() OVER (ORDER BY n DESC, token) + 2 AS id FROM word_counts""",
    "argmax": """
        SELECT CAST(vec_id // 5 AS BIGINT) AS pair_id, CAST(vec_id % 5 AS BIGINT) AS pos,
               CAST(list_position(embedding, list_max(embedding)) - 1 AS BIGINT) AS id
        FROM embeddings""",
    # predictions as numbered words
    "predicted": """
        SELECT conv_id, turn, string_split(tgt_text, ' ') AS reference,
               list_filter(string_split(tgt_text, ' '), lambda w, i: i % 7 <> 0) AS candidate
        FROM conversation_pairs""",
    "sides": """
        SELECT conv_id, turn, 'c' AS side, candidate AS tokens FROM predicted
        UNION ALL SELECT conv_id, turn, 'r', reference FROM predicted""",
    "grams": """
        SELECT conv_id, turn, side, n, tokens[i:i + n - 1] AS gram, count(*) AS times
        FROM (SELECT conv_id, turn, side, tokens, n, unnest(range(1, len(tokens) - n + 2)) AS i
              FROM sides, (VALUES (1), (2), (3), (4)) AS orders(n))
        GROUP BY ALL""",
    "gram_matches": """
        SELECT c.conv_id, c.turn, c.n, sum(least(c.times, coalesce(r.times, 0))) AS matched,
               sum(c.times) AS total
        FROM (SELECT * FROM grams WHERE side = 'c') c
        LEFT JOIN (SELECT * FROM grams WHERE side = 'r') r
          ON r.conv_id = c.conv_id AND r.turn = c.turn AND r.n = c.n AND r.gram = c.gram
        GROUP BY c.conv_id, c.turn, c.n""",
    "bleu_counts": """
        SELECT p.conv_id, p.turn, len(candidate) AS c_len, len(reference) AS r_len,
        """
    + ", ".join(
        f"coalesce(max(matched) FILTER (n = {n}), 0) AS match_{n},"
        f" coalesce(max(total) FILTER (n = {n}), 0) AS total_{n}"
        for n in (1, 2, 3, 4)
    )
    + """
        FROM predicted p LEFT JOIN gram_matches m ON m.conv_id = p.conv_id AND m.turn = p.turn
        GROUP BY p.conv_id, p.turn, c_len, r_len""",
    "word_places": """
        SELECT conv_id, turn, side, token, pos,
               row_number() OVER (PARTITION BY conv_id, turn, side, token ORDER BY pos DESC) AS k
        FROM (SELECT conv_id, turn, side, lower(unnest(tokens)) AS token,
                     generate_subscripts(tokens, 1) AS pos FROM sides)""",
    "word_matches": """
        SELECT conv_id, turn, c.pos AS c, r.pos AS r,
               c.pos - lag(c.pos) OVER w = 1 AND r.pos - lag(r.pos) OVER w = 1 AS goes_on
        FROM (SELECT * FROM word_places WHERE side = 'c') c
        JOIN (SELECT * FROM word_places WHERE side = 'r') r USING (conv_id, turn, token, k)
        WINDOW w AS (PARTITION BY conv_id, turn ORDER BY c.pos)""",
    "vectors": """
        SELECT CAST(vec_id // 32 AS BIGINT) AS pair_id, vec_id % 2 = 0 AS is_candidate, vec_id,
               CAST(embedding AS DOUBLE[]) AS vec
        FROM embeddings""",
    "cosines": """
        SELECT c.pair_id, c.vec_id AS c, r.vec_id AS r, list_cosine_similarity(c.vec, r.vec) AS cosine
        FROM vectors c JOIN vectors r USING (pair_id)
        WHERE c.is_candidate AND NOT r.is_candidate""",
    "bert_precision": """
        SELECT pair_id, avg(best) AS precision
        FROM (SELECT pair_id, c, max(cosine) AS best FROM cosines GROUP BY pair_id, c)
        GROUP BY pair_id""",
    "bert_recall": """
        SELECT pair_id, avg(best) AS recall
        FROM (SELECT pair_id, r, max(cosine) AS best FROM cosines GROUP BY pair_id, r)
        GROUP BY pair_id""",
    "bert_scores": """
        SELECT pair_id, coalesce(precision, 0.0) AS precision, coalesce(recall, 0.0) AS recall,
               CASE WHEN coalesce(precision + recall, 0) = 0 THEN 0.0
                    ELSE 2 * precision * recall / (precision + recall) END AS f1
        FROM (SELECT DISTINCT pair_id FROM vectors)
        LEFT JOIN bert_precision USING (pair_id) LEFT JOIN bert_recall USING (pair_id)""",
}

_BLEU = """CASE WHEN match_1 = 0 OR match_2 = 0 OR match_3 = 0 OR match_4 = 0 THEN 0.0
    ELSE (CASE WHEN c_len > r_len THEN 1.0 ELSE exp(1 - r_len / c_len) END)
         * exp((ln(match_1 / total_1) + ln(match_2 / total_2)
              + ln(match_3 / total_3) + ln(match_4 / total_4)) / 4) END"""

# steps each step reads; "greedy" is recursive and set by the query
NEEDS = {
    "numbered_pairs": ["conversation_pairs"],
    "line_pairs": ["document_lines"],
    "numbered_line_pairs": ["line_pairs"],
    "counted": ["numbered_pairs"],
    "counted_conversations": ["conversation_pairs"],
    "counted_lines": ["numbered_line_pairs"],
    "counted_all": ["counted", "counted_lines"],
    "ordered": ["counted_all"],
    "ordered_lines": ["counted_lines"],
    "ordered_conversations": ["counted"],
    "packed": ["counted_all", "greedy"],
    "stream": ["packed"],
    "tokens": ["stream"],
    "sequences": ["packed"],
    "batches": ["sequences"],
    "padded": ["batches"],
    "word_counts": ["conversation_pairs"],
    "vocabulary": ["word_counts"],
    "predicted": ["conversation_pairs"],
    "sides": ["predicted"],
    "grams": ["sides"],
    "gram_matches": ["grams"],
    "bleu_counts": ["predicted", "gram_matches"],
    "word_places": ["sides"],
    "word_matches": ["word_places"],
    "cosines": ["vectors"],
    "bert_precision": ["cosines"],
    "bert_recall": ["cosines"],
    "bert_scores": ["vectors", "bert_precision", "bert_recall"],
    "greedy": ["ordered"],
    "greedy_lines": ["ordered_lines"],
    "greedy_conversations": ["ordered_conversations"],
    "greedy_batches": ["ordered_batches"],
    "ordered_batches": ["counted_batches"],
    "counted_batches": ["counted_all"],
}
STEPS |= {
    "greedy": _greedy("ordered", "pair_id"),
    "greedy_lines": _greedy("ordered_lines", "pair_id").replace("FROM greedy g", "FROM greedy_lines g"),
    "greedy_conversations": _greedy("ordered_conversations", "pair_id").replace(
        "FROM greedy g", "FROM greedy_conversations g"
    ),
    "counted_batches": """
        SELECT lang_pair, pair_id // 10 AS batch, sum(n_src + n_tgt) AS tok
        FROM counted_all GROUP BY lang_pair, batch""",
    "ordered_batches": _in_order("counted_batches", "batch", "tok"),
    "greedy_batches": _greedy("ordered_batches", "batch").replace(
        "FROM greedy g", "FROM greedy_batches g"
    ),
}


def _query(select: str, *steps: str) -> str:
    """``select`` after the steps it names and those they need."""
    ordered: list[str] = []

    def visit(step: str) -> None:
        for need in NEEDS.get(step, []):
            visit(need)
        if step not in ordered:
            ordered.append(step)

    for step in steps:
        visit(step)
    if not ordered:
        return select
    named = ",\n".join(f"{step} AS MATERIALIZED ({STEPS[step]})" if not step.startswith("greedy")
                       else f"{step} AS ({STEPS[step]})" for step in ordered)
    return f"WITH RECURSIVE {named}\n{select}"


def _shards(columns: str, more: str = "") -> str:
    return _query(f"SELECT {columns} FROM packed {more}", "packed")


def _pair_ids(src: str, tgt: str) -> str:
    return _query(
        f"SELECT conv_id, turn, {_text(src)} AS src, {_text(tgt)} AS tgt FROM conversation_pairs",
        "conversation_pairs",
    )


def _suffixed(text: str, max_len: int) -> str:
    return f"list_append(({_bytes(text)})[1:{max_len - 1}], 1)"


def _bits(ids: str, op: str) -> str:
    return f"array_to_string(list_transform({ids}, lambda t: CASE WHEN t {op} 0 THEN 1 ELSE 0 END), '')"


def _word_ids(side: str) -> str:
    return f"""
        SELECT p.conv_id, p.turn,
               array_to_string(list(coalesce(v.id, 2) ORDER BY p.pos), ' ') AS {side}
        FROM (SELECT conv_id, turn, unnest({_words(side + '_text')}) AS token,
                     generate_subscripts({_words(side + '_text')}, 1) AS pos
              FROM conversation_pairs) p
        LEFT JOIN vocabulary v ON v.token = p.token
        GROUP BY p.conv_id, p.turn"""


_SUMMARY = """lang_pair, split, shard_idx, count(*) AS pairs,
    CAST(sum(n_src) AS BIGINT) AS src_tokens, CAST(sum(n_tgt) AS BIGINT) AS tgt_tokens"""
_BY_SHARD = "GROUP BY lang_pair, split, shard_idx"

_BEST = """
    SELECT step, loss, min(loss) OVER before AS best_before,
           coalesce(loss < min(loss) OVER before, true) AS is_best
    FROM runlog WHERE split = 'val'
    WINDOW before AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"""

_CUT_AT_STOPS = f"""
    SELECT lang_pair, split, shard_idx, CAST(seq_id AS BIGINT) AS seq_id,
           s.seq AS source, t.seq AS target
    FROM (SELECT * FROM cut WHERE side = 'src') s JOIN (SELECT * FROM cut WHERE side = 'tgt') t
         USING (lang_pair, split, shard_idx, seq_id)"""

STEPS["numbered"] = f"""
        SELECT *, count(*) FILTER (token = {FULL_STOP}) OVER (
                   PARTITION BY lang_pair, shard_idx, side ORDER BY pos
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seq_id
        FROM tokens"""
STEPS["cut"] = f"""
        SELECT lang_pair, split, shard_idx, side, seq_id,
               {_text(f"list(token ORDER BY pos) FILTER (token <> {FULL_STOP})")} AS seq
        FROM numbered
        GROUP BY lang_pair, split, shard_idx, side, seq_id
        HAVING count(*) FILTER (token = {FULL_STOP}) > 0"""
NEEDS |= {"numbered": ["tokens"], "cut": ["numbered"]}

STEPS["files"] = """
        SELECT parse_filename(path) AS name, path,
               row_number() OVER (PARTITION BY lang ORDER BY parse_filename(path), path) - 1 AS file_no,
               lang
        FROM (SELECT 'corpus/' || source || '/' || doc_id || '.' || lang AS path, lang
              FROM documents)"""
STEPS["page_files"] = """
        SELECT page_id, regexp_replace(url, '[?#].*$', '') || name AS url, file_name, kind
        FROM pages, (VALUES ('/moses/en-xx.txt.zip', 'en-xx.txt.zip', 'zip'),
                            ('/raw/en.xml.gz', 'en.xml.gz', 'gzip'),
                            ('/readme', 'readme', 'none')) AS f(name, file_name, kind)"""

STEPS["totals"] = "SELECT lang_pair, split, count(*) AS total FROM sequences GROUP BY ALL"
NEEDS["totals"] = ["sequences"]
STEPS["filled"] = """
        SELECT lang_pair, split, shard_idx, seq_id, n + turn * total AS n
        FROM sequences JOIN totals USING (lang_pair, split), (VALUES (0), (1), (2)) AS t(turn)
        WHERE n + turn * total < total + (3 - total % 3) % 3"""
NEEDS["filled"] = ["sequences", "totals"]

STEPS["meteor_scores"] = """
        SELECT conv_id, turn, matches, chunks,
               CASE WHEN matches = 0 THEN 0.0
                    ELSE p * r / (0.9 * p + 0.1 * r) * (1 - 0.5 * power(chunks / matches, 3)) END
               AS meteor
        FROM (SELECT p.conv_id, p.turn, count(c) AS matches,
                     count(c) FILTER (NOT coalesce(goes_on, false)) AS chunks,
                     count(c) / len(candidate) AS p, count(c) / len(reference) AS r
              FROM predicted p LEFT JOIN word_matches m
                ON m.conv_id = p.conv_id AND m.turn = p.turn
              GROUP BY p.conv_id, p.turn, candidate, reference)"""
NEEDS["meteor_scores"] = ["predicted", "word_matches"]
# METEOR with stems: what the exact stage leaves is matched by stems
STEPS["inflected"] = """
        SELECT conv_id, turn, string_split(tgt_text, ' ') AS reference,
               list_filter(list_transform(string_split(tgt_text, ' '), lambda w, i:
                   CASE WHEN i % 7 = 0 THEN NULL WHEN NOT regexp_full_match(w, '[A-Za-z]+') THEN w
                        WHEN i % 3 = 2 THEN w || 'ing' WHEN i % 5 = 3 THEN w || 's' ELSE w END),
                   lambda w: w IS NOT NULL) AS candidate
        FROM conversation_pairs"""
STEPS["inflected_words"] = """
        SELECT conv_id, turn, side, lower(unnest(tokens)) AS token, generate_subscripts(tokens, 1) AS pos
        FROM (SELECT conv_id, turn, 'c' AS side, candidate AS tokens FROM inflected
              UNION ALL SELECT conv_id, turn, 'r', reference FROM inflected)"""
STEPS["distinct_words"] = "SELECT DISTINCT token FROM inflected_words"
STEPS["stems"] = stems("distinct_words")


def _met(words: str, form: str) -> str:
    """Pairs of places: the k-th last of a form with the k-th last of the other side."""
    numbered = f"""(SELECT *, row_number() OVER (PARTITION BY conv_id, turn, side, {form} ORDER BY pos DESC) AS k
                    FROM {words})"""
    return f"""
        SELECT conv_id, turn, c.pos AS c, r.pos AS r
        FROM (SELECT * FROM {numbered} WHERE side = 'c') c JOIN (SELECT * FROM {numbered} WHERE side = 'r') r
             USING (conv_id, turn, {form}, k)"""


STEPS["met_exactly"] = _met("inflected_words", "token")
STEPS["words_left"] = """
        SELECT w.conv_id, w.turn, w.side, w.pos, stem
        FROM inflected_words w JOIN stems USING (token)
        WHERE NOT EXISTS (SELECT 1 FROM met_exactly m WHERE m.conv_id = w.conv_id AND m.turn = w.turn
                          AND CASE WHEN w.side = 'c' THEN m.c ELSE m.r END = w.pos)"""
STEPS["met_by_stem"] = _met("words_left", "stem")
STEPS["met"] = """
        SELECT conv_id, turn, c, c - lag(c) OVER w = 1 AND r - lag(r) OVER w = 1 AS goes_on
        FROM (SELECT * FROM met_exactly UNION ALL SELECT * FROM met_by_stem)
        WINDOW w AS (PARTITION BY conv_id, turn ORDER BY c)"""
STEPS["stem_scores"] = STEPS["meteor_scores"].replace("predicted", "inflected").replace("word_matches", "met")
NEEDS |= {
    "inflected": ["conversation_pairs"],
    "inflected_words": ["inflected"],
    "distinct_words": ["inflected_words"],
    "stems": ["distinct_words"],
    "met_exactly": ["inflected_words"],
    "words_left": ["inflected_words", "stems", "met_exactly"],
    "met_by_stem": ["words_left"],
    "met": ["met_exactly", "met_by_stem"],
    "stem_scores": ["inflected", "met"],
}
STEPS["noisy_log"] = """
        SELECT CASE WHEN event_id % 11 = 3 THEN event_id || ' note resumed'
                    WHEN event_id % 13 = 5 THEN event_id || ' val n/a'
                    WHEN event_id % 17 = 7 THEN event_id || '0000000000000000000 ' || rest
                    ELSE event_id || ' ' || rest END AS line
        FROM (SELECT event_id, CASE WHEN event_type = 'view' THEN 'val' ELSE 'train' END || ' ' || value AS rest
              FROM events)"""
STEPS["plain"] = f"""
        SELECT pair_id, lang_pair, src_text, tgt_text,
               {_n_bytes('src_text')} AS n_src, {_n_bytes('tgt_text')} AS n_tgt
        FROM numbered_pairs"""
STEPS["ordered_plain"] = _in_order("plain", "pair_id", "n_src + n_tgt")
STEPS["greedy_plain"] = _greedy("ordered_plain", "pair_id").replace(
    "FROM greedy g", "FROM greedy_plain g"
)
STEPS["one_file"] = "SELECT 'en-ko' AS lang_pair, pair_id, n_src, n_tgt FROM counted_lines"
STEPS["file_batches"] = """
        SELECT lang_pair, pair_id // 10 AS batch, sum(n_src + n_tgt) AS tok
        FROM one_file GROUP BY lang_pair, batch"""
STEPS["ordered_files"] = _in_order("file_batches", "batch", "tok")
STEPS["greedy_files"] = _greedy("ordered_files", "batch").replace(
    "FROM greedy g", "FROM greedy_files g"
)
def _moved_by(half: str, key: tuple[int, int, int]) -> str:
    mixed = f"((({half}) % {PRIME} * {key[0]} + {key[1]}) % {PRIME})"
    return f"(xor({mixed}, {mixed} >> 15) * {key[2]} % {PRIME})"


def _permuted(x: str, source: str) -> str:
    """``source`` (with ``total``) and ``y``, where the network sends ``x``."""
    columns, left, right = [f"{x} % a AS h0", f"{x} // a AS g0"], "h0", "g0"
    for i, key in enumerate(round_keys(7, 2)):
        if i % 2 == 0:
            columns.append(f"({left} + {_moved_by(right, key)}) % a AS h{i + 1}")
            left = f"h{i + 1}"
        else:
            columns.append(f"({right} + {_moved_by(left, key)}) % b AS g{i + 1}")
            right = f"g{i + 1}"
    return f"""
        SELECT lang_pair, split, n, total, {right} * a + {left} AS y
        FROM (SELECT *, {', '.join(columns)}
              FROM (SELECT *, CAST(ceil(sqrt(total)) AS BIGINT) AS a,
                           (total + CAST(ceil(sqrt(total)) AS BIGINT) - 1) // CAST(ceil(sqrt(total)) AS BIGINT) AS b
                    FROM {source}))"""


STEPS["numbers"] = "SELECT lang_pair, split, n, total FROM sequences JOIN totals USING (lang_pair, split)"
STEPS["greedy_walk"] = f"""
        {_permuted('n', 'numbers')}
        UNION ALL
        {_permuted('y', '(SELECT * FROM greedy_walk WHERE y >= total)')}"""
STEPS["permuted"] = "SELECT lang_pair, split, n, y AS position FROM greedy_walk WHERE y < total"
STEPS["in_order"] = """
        SELECT lang_pair, split, shard_idx, seq_id, source, target, n AS position FROM sequences"""
STEPS["shuffled_all"] = """
        SELECT lang_pair, split, shard_idx, seq_id, source, target, position
        FROM sequences JOIN permuted USING (lang_pair, split, n)"""


def _slots(source: str) -> str:
    return f"""
        SELECT lang_pair, split, shard_idx, seq_id, source, target, position + turn * total AS slot
        FROM {source} JOIN totals USING (lang_pair, split), (VALUES (0), (1), (2)) AS t(turn)
        WHERE position + turn * total < total + (3 - total % 3) % 3"""


def _loaded(source: str) -> str:
    return f"""
        SELECT *, list_resize(source, max(len(source)) OVER b, 0) AS src,
               list_resize(target, max(len(target)) OVER b, 0) AS tgt
        FROM (SELECT *, slot % 3 AS rank, (slot // 3) // {BATCH_SIZE} AS batch_id,
                     (slot // 3) % {BATCH_SIZE} AS row_in_batch FROM {source})
        WINDOW b AS (PARTITION BY lang_pair, split, rank, batch_id)"""


STEPS |= {
    "slots": _slots("in_order"),
    "loaded": _loaded("slots"),
    "slots_all": _slots("shuffled_all"),
    "loaded_all": _loaded("slots_all"),
}
NEEDS |= {
    "plain": ["numbered_pairs"],
    "ordered_plain": ["plain"],
    "greedy_plain": ["ordered_plain"],
    "one_file": ["counted_lines"],
    "file_batches": ["one_file"],
    "ordered_files": ["file_batches"],
    "greedy_files": ["ordered_files"],
    "numbers": ["sequences", "totals"],
    "greedy_walk": ["numbers"],
    "permuted": ["greedy_walk"],
    "in_order": ["sequences"],
    "slots": ["in_order", "totals"],
    "loaded": ["slots"],
    "shuffled_all": ["sequences", "permuted"],
    "slots_all": ["shuffled_all", "totals"],
    "loaded_all": ["slots_all"],
}
_SPLIT = "CASE WHEN shard_idx = 0 THEN 'val' ELSE 'train' END AS split"

ORACLES = {
    "nested_ingest": _query(
        f"""SELECT lang_pair, {_SPLIT}, CAST(shard_idx AS BIGINT) AS shard_idx, pair_id,
                   {_text(_bytes('src_text'))} AS src, CAST(n_src AS BIGINT) AS n_src,
                   CAST(n_tgt AS BIGINT) AS n_tgt
            FROM (SELECT lang_pair, pair_id, shard_idx FROM greedy_plain)
            JOIN plain USING (lang_pair, pair_id)""",
        "greedy_plain",
    ),
    "ingest_rejects": """
        SELECT CASE WHEN a.conv_id % 7 = 0 THEN 'no translation'
                    WHEN b.conv_id IS NULL THEN 'target missing' ELSE 'kept' END AS reason,
               count(*) AS n_lines
        FROM conversations a LEFT JOIN conversations b
          ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant'
        WHERE a.role = 'user' GROUP BY reason""",
    "aligned_ingest": _query(
        f"""SELECT k.lang_pair, {_SPLIT}, CAST(g.shard_idx AS BIGINT) AS shard_idx, k.pair_id,
                   CAST(k.n_src AS BIGINT) AS n_src, CAST(k.n_tgt AS BIGINT) AS n_tgt
            FROM one_file k JOIN greedy_files g ON g.batch = k.pair_id // 10""",
        "greedy_files",
    ),
    "loader_batches": _query(
        f"""SELECT lang_pair, split, CAST(rank AS BIGINT) AS rank, CAST(batch_id AS BIGINT) AS batch_id,
                   CAST(row_in_batch AS BIGINT) AS row_in_batch,
                   CAST(batch_id // 2 AS BIGINT) AS step, CAST(batch_id % 2 AS BIGINT) AS micro_step,
                   shard_idx, seq_id, {_text('src')} AS source,
                   {_text('tgt[:-2]')} AS target_input, {_text('tgt[2:]')} AS target_output,
                   {_bits('src', '=')} AS src_padding_mask, {_bits('src', '<>')} AS src_attn_mask,
                   {_bits('tgt', '=')} AS tgt_padding_mask, {_bits('tgt', '<>')} AS tgt_attn_mask,
                   len(source) AS src_lengths, len(target) AS tgt_lengths
            FROM loaded""",
        "loaded",
    ),
    "loader_epoch": _query(
        f"""SELECT lang_pair, split, CAST(rank AS BIGINT) AS rank, CAST(batch_id AS BIGINT) AS batch_id,
                   CAST(row_in_batch AS BIGINT) AS row_in_batch,
                   CAST(batch_id // 2 AS BIGINT) AS step, CAST(batch_id % 2 AS BIGINT) AS micro_step,
                   shard_idx, seq_id, {_text('src')} AS source,
                   {_text('tgt[:-2]')} AS target_input, {_text('tgt[2:]')} AS target_output,
                   {_bits('src', '=')} AS src_padding_mask, {_bits('src', '<>')} AS src_attn_mask,
                   {_bits('tgt', '=')} AS tgt_padding_mask, {_bits('tgt', '<>')} AS tgt_attn_mask,
                   len(source) AS src_lengths, len(target) AS tgt_lengths
            FROM loaded_all""",
        "loaded_all",
    ),
    "score_report": _query(
        f"""SELECT metric, round(value, 4) AS value FROM (
                SELECT 'bleu' AS metric, avg({_BLEU}) AS value FROM bleu_counts
                UNION ALL SELECT 'corpus_bleu', {_BLEU} FROM (SELECT {", ".join(
                    f"sum({name}) AS {name}"
                    for name in [f"{k}_{n}" for k in ("match", "total") for n in (1, 2, 3, 4)]
                    + ["c_len", "r_len"])} FROM bleu_counts)
                UNION ALL SELECT 'meteor', avg(meteor) FROM meteor_scores
                UNION ALL SELECT 'bert_precision', avg(precision) FROM bert_scores
                UNION ALL SELECT 'bert_recall', avg(recall) FROM bert_scores
                UNION ALL SELECT 'bert_f1', avg(f1) FROM bert_scores)""",
        "bleu_counts",
        "meteor_scores",
        "bert_scores",
    ),
    "ingest_resumed": _shards(_SUMMARY, _BY_SHARD),
    "subword_roundtrip": _query("SELECT conv_id, turn, src_text, tgt_text FROM conversation_pairs", "conversation_pairs"),
    "segment_table_function": _query(
        f"""SELECT lang_pair, split, shard_idx, 'src' AS side, seq_id, {_text('source')} AS tokens FROM sequences
            UNION ALL
            SELECT lang_pair, split, shard_idx, 'tgt', seq_id, {_text('target')} FROM sequences""",
        "sequences",
    ),
    "stream_runs": """
        SELECT user_id AS run, CAST(event_id AS BIGINT) AS step, value AS loss,
               coalesce(value < min(value) OVER before, true) AS is_best
        FROM events WHERE event_type = 'view'
        WINDOW before AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "shard_summary": _shards(_SUMMARY, _BY_SHARD),
    "file_pairs": _query(
        """SELECT a.file_no, a.name AS src_name, b.name AS tgt_name
           FROM files a JOIN files b ON a.file_no = b.file_no
           WHERE a.lang = 'en' AND b.lang = 'fr'""",
        "files",
    ),
    "aligned_lines": _query("SELECT file_no, line_no, src_text, tgt_text FROM line_pairs", "line_pairs"),
    "nested_pairs": _query(
        """SELECT conv_id, turn, lang_pair,
                  translation[split_part(lang_pair, '-', 1)] AS src_text,
                  translation[split_part(lang_pair, '-', 2)] AS tgt_text
           FROM (SELECT *, MAP {'en': src_text, 'xx': tgt_text} AS translation
                 FROM conversation_pairs)""",
        "conversation_pairs",
    ),
    "multi_pair_counts": _query(
        f"""SELECT lang_pair, count(*) AS pairs,
                   CAST(sum({_n_bytes('src_text')}) AS BIGINT) AS src_tokens,
                   CAST(sum({_n_bytes('tgt_text')}) AS BIGINT) AS tgt_tokens
            FROM (SELECT lang_pair, src_text, tgt_text FROM line_pairs
                  UNION ALL SELECT lang_pair, src_text, tgt_text FROM conversation_pairs)
            GROUP BY lang_pair""",
        "line_pairs",
        "conversation_pairs",
    ),
    "manifest_files": _query("SELECT page_id, url, file_name, kind FROM page_files", "page_files"),
    "archive_lines": _query(
        """SELECT source || '.zip' AS path, d.doc_id || '.' || d.lang AS member,
                  CAST(line_no AS BIGINT) AS line_no, line
           FROM document_lines l JOIN documents d USING (doc_id)
           WHERE line <> '' OR line_no + 1 < len(string_split(d.text, chr(10)))""",
        "document_lines",
    ),
    "shard_listing": _shards(
        """DISTINCT lang_pair, split, shard_idx, printf('src_shard_%06d', shard_idx) AS src_name,
           printf('trg_shard_%06d', shard_idx) AS tgt_name, true AS complete"""
    ),
    "shard_read": _shards(
        f"lang_pair, shard_idx, pair_id, {_text('src_ids')} AS src, {_text('tgt_ids')} AS tgt",
        "WHERE split = 'train'",
    ),
    "shard_roundtrip": _shards("lang_pair, split, shard_idx, pair_id, n_src, n_tgt"),
    "strip_pairs": _query(
        f"""SELECT file_no, line_no, {_strip('src_text')} AS src_text,
                   {_strip('tgt_text')} AS tgt_text FROM line_pairs""",
        "line_pairs",
    ),
    "tokenize_bytes": _pair_ids(_bytes("src_text"), _bytes("tgt_text")),
    "tokenize_words": _query(
        f"""SELECT conv_id, turn, coalesce(src, '') AS src, coalesce(tgt, '') AS tgt
            FROM (SELECT conv_id, turn FROM conversation_pairs)
            LEFT JOIN ({_word_ids('src')}) USING (conv_id, turn)
            LEFT JOIN ({_word_ids('tgt')}) USING (conv_id, turn)""",
        "vocabulary",
    ),
    "mark_prefix": _pair_ids(
        f"list_prepend(1, {_bytes('src_text')})", f"list_prepend(1, {_bytes('tgt_text')})"
    ),
    "mark_suffix": _pair_ids(_suffixed("src_text", MAX_LEN), _suffixed("tgt_text", MAX_LEN)),
    "token_range_violations": """
        SELECT l_orderkey, l_linenumber, concat_ws(' ', a, b, c) AS ids
        FROM (SELECT CAST(l_orderkey AS BIGINT) AS l_orderkey,
                     CAST(l_linenumber AS BIGINT) AS l_linenumber, CAST(l_partkey AS BIGINT) AS a,
                     CAST(l_orderkey AS BIGINT) * 1000000 AS b, CAST(l_suppkey AS BIGINT) - 5 AS c
              FROM lineitem)
        WHERE NOT (a BETWEEN 0 AND 4294967295 AND b BETWEEN 0 AND 4294967295
                   AND c BETWEEN 0 AND 4294967295)""",
    "length_filter": _query(
        f"""SELECT conv_id, turn, CAST(n_src AS BIGINT) AS n_src, CAST(n_tgt AS BIGINT) AS n_tgt
           FROM counted_conversations WHERE n_src <= {MAX_LEN} AND n_tgt <= {MAX_LEN}""",
        "counted_conversations",
    ),
    "limit_examined": _query(
        """SELECT pair_id, CAST(n_src AS BIGINT) AS n_src, CAST(n_tgt AS BIGINT) AS n_tgt
           FROM counted WHERE pair_id < 150""",
        "counted",
    ),
    "limit_kept": _query(
        """SELECT pair_id, CAST(n_src AS BIGINT) AS n_src, CAST(n_tgt AS BIGINT) AS n_tgt
           FROM counted ORDER BY pair_id LIMIT 40""",
        "counted",
    ),
    "truncate_sequences": _shards(
        f"""lang_pair, pair_id, {_text('src_ids[1:128]')} AS source,
            {_text('tgt_ids[1:128]')} AS target"""
    ),
    "prompt_text": _query(
        f"SELECT conv_id, turn, '{PROMPT}' || src_text AS prompted FROM conversation_pairs",
        "conversation_pairs",
    ),
    "prompt_tokens": _query(
        f"""SELECT lang_pair, split, shard_idx, seq_id,
                   {_text(f"list_concat({_bytes(repr(PROMPT))}, source)")} AS source,
                   repeat('1', {len(PROMPT)}) || {_bits('source', '<>')} AS src_attn_mask,
                   repeat('0', {len(PROMPT)}) || {_bits('source', '=')} AS src_padding_mask,
                   src_lengths + {len(PROMPT)} AS src_lengths
            FROM padded""",
        "padded",
    ),
    "label_by_split": _query(
        f"""SELECT lang_pair, split, shard_idx, seq_id,
                   {_text("CASE WHEN shard_idx = 0 THEN target[2:] ELSE target[:-2] END")} AS labels
            FROM padded""",
        "padded",
    ),
    "raw_text_batch": _query(
        f"""SELECT CAST(batch_id AS BIGINT) AS batch_id, CAST(row_in_batch AS BIGINT) AS row_in_batch,
                   {_text('input_ids')} AS input_ids, {_bits('input_ids', '<>')} AS src_attn_mask,
                   {_text('labels')} AS labels
            FROM (SELECT batch_id, row_in_batch,
                         list_resize(source, max(len(source)) OVER b, 0) AS input_ids,
                         list_resize(target, max(len(target)) OVER b, 0) AS labels
                  FROM (SELECT pair_id // {BATCH_SIZE} AS batch_id,
                               pair_id % {BATCH_SIZE} AS row_in_batch,
                               {_suffixed('src_text', 256)} AS source,
                               {_suffixed('tgt_text', 256)} AS target
                        FROM (SELECT pair_id, '{PROMPT}' || src_text AS src_text, tgt_text
                              FROM numbered_pairs))
                  WINDOW b AS (PARTITION BY batch_id))""",
        "numbered_pairs",
    ),
    "corpus_totals": _query(
        """SELECT lang_pair, count(*) AS pairs, CAST(sum(n_src) AS BIGINT) AS src_tokens,
                  CAST(sum(n_tgt) AS BIGINT) AS tgt_tokens,
                  CAST(sum(n_src + n_tgt) AS BIGINT) AS tokens
           FROM counted_lines GROUP BY lang_pair""",
        "counted_lines",
    ),
    "shard_concat": _query(
        f"""SELECT lang_pair, split, shard_idx, side, CAST(start AS BIGINT) AS pos,
                   {_text(f'tokens[start + 1:start + {CHUNK}]')} AS tokens
            FROM (SELECT *, unnest(range(0, len(tokens), {CHUNK})) AS start FROM stream)""",
        "stream",
    ),
    "shard_profile": _query(
        """SELECT lang_pair, split, shard_idx, side, count(*) AS n_tokens,
                  count(*) FILTER (token = 1) AS n_markers
           FROM tokens GROUP BY lang_pair, split, shard_idx, side""",
        "tokens",
    ),
    "segment_mismatch": _query(
        f"""SELECT lang_pair, split, shard_idx,
                   count(*) FILTER (side = 'src' AND token = {FULL_STOP}) AS src_markers,
                   count(*) FILTER (side = 'tgt' AND token = {FULL_STOP}) AS tgt_markers
            FROM tokens GROUP BY lang_pair, split, shard_idx HAVING src_markers <> tgt_markers""",
        "tokens",
    ),
    "marker_positions": _query(
        """SELECT lang_pair, split, shard_idx, side, CAST(pos AS BIGINT) AS pos
           FROM tokens WHERE token = 1
           UNION ALL SELECT lang_pair, split, shard_idx, side, len(tokens) FROM stream""",
        "tokens",
    ),
    "token_length_profile": f"""
        SELECT lang, words, tokens, round(tokens / words, 4) AS tokens_per_word,
               CAST(round(1024 / (tokens / words)) AS BIGINT) AS words_in_1024
        FROM (SELECT lang,
                     CAST(sum(len(regexp_extract_all(text, '[^{SPACE_CLASS}]+'))) AS BIGINT) AS words,
                     CAST(sum({_n_bytes('text')}) AS BIGINT) AS tokens
              FROM documents GROUP BY lang)""",
    "runlog_parse": _query("SELECT step, split, loss FROM runlog", "runlog"),
    "runlog_rejects": _query(
        r"""SELECT * FROM (
               SELECT line, CASE WHEN NOT regexp_full_match(line, '\d+ (val|train) \S+') THEN 'no entry'
                          WHEN try_cast(string_split(line, ' ')[1] AS BIGINT) IS NULL THEN 'step out of range'
                          WHEN try_cast(string_split(line, ' ')[3] AS DOUBLE) IS NULL THEN 'loss is no number'
                      END AS reason
               FROM noisy_log)
           WHERE reason IS NOT NULL""",
        "noisy_log",
    ),
    "runlog_runs": """
        SELECT user_id AS run, CAST(event_id AS BIGINT) AS step, value AS loss, min(value) OVER before AS best_before,
               coalesce(value < min(value) OVER before, true) AS is_best
        FROM events WHERE event_type = 'view'
        WINDOW before AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""",
    "runlog_mean_loss": _query(
        """SELECT epoch, split, round(avg(loss), 4) AS mean_loss, count(*) AS batches
           FROM (SELECT *, CAST(step // 1000 AS BIGINT) AS epoch FROM runlog)
           GROUP BY epoch, split""",
        "runlog",
    ),
    "runlog_best": _query(_BEST, "runlog"),
    "runlog_best_step": _query(
        "SELECT step, loss FROM runlog WHERE split = 'val' ORDER BY loss, step LIMIT 1", "runlog"
    ),
    "runlog_events": _query(
        """SELECT step, step % 225 = 0 AS evaluates,
                  (step > 0 AND step % 225 = 0 AND step % 2000 = 0)
                  OR step = max(step) OVER () AS saves
           FROM runlog""",
        "runlog",
    ),
    "step_throughput": """
        SELECT CAST(event_id AS BIGINT) AS step, value AS dt, CAST(524288 AS BIGINT) AS tokens,
               round(524288.0::DOUBLE / nullif(value, 0), 4) AS tokens_per_sec
        FROM events""",
    "pack_greedy": _query(
        "SELECT lang_pair, pair_id, CAST(shard_idx AS BIGINT) AS shard_idx FROM greedy_lines",
        "greedy_lines",
    ),
    "pack_batched": _query(
        """SELECT k.lang_pair, k.pair_id, CAST(g.shard_idx AS BIGINT) AS shard_idx
           FROM counted_all k
           JOIN greedy_batches g ON g.lang_pair = k.lang_pair AND g.batch = k.pair_id // 10""",
        "greedy_batches",
    ),
    "split_assign": _query(
        """SELECT lang_pair, CASE WHEN shard_idx = 0 THEN 'val' ELSE 'train' END AS split,
                  count(*) AS pairs
           FROM greedy_lines GROUP BY ALL""",
        "greedy_lines",
    ),
    "segment_prefix": _query(
        f"""SELECT lang_pair, split, shard_idx, seq_id,
                   {_text('source')} AS source, {_text('target')} AS target
            FROM sequences""",
        "sequences",
    ),
    "segment_suffix": _query(_CUT_AT_STOPS, "cut"),
    "sequence_lookup": _query(
        f"""SELECT CAST(event_id AS BIGINT) AS idx, lang_pair, split, shard_idx, seq_id,
                  len(source) AS src_length, len(target) AS tgt_length,
                  md5({_text("list_concat(source, target)")}) AS tokens_md5
           FROM events
           JOIN (SELECT *, row_number() OVER (ORDER BY lang_pair, split) - 1 AS number, count(*) OVER () AS loaders
                 FROM totals) ON event_id % loaders = number
           JOIN sequences USING (lang_pair, split)
           WHERE n = event_id % total""",
        "totals",
    ),
    "batch_assign": _query(
        "SELECT lang_pair, split, shard_idx, seq_id, batch_id, row_in_batch FROM batches",
        "batches",
    ),
    "batch_pad": _query(
        f"""SELECT lang_pair, split, batch_id, row_in_batch, {_text('source')} AS source, {_text('target')} AS target
            FROM padded""",
        "padded",
    ),
    "batch_masks": _query(
        f"""SELECT lang_pair, split, batch_id, row_in_batch, {_bits('source', '=')} AS src_padding_mask,
                   {_bits('source', '<>')} AS src_attn_mask, {_bits('target', '=')} AS tgt_padding_mask,
                   {_bits('target', '<>')} AS tgt_attn_mask
            FROM padded""",
        "padded",
    ),
    "batch_shift": _query(
        f"""SELECT lang_pair, split, batch_id, row_in_batch, {_text('target[:-2]')} AS target_input,
                   {_text('target[2:]')} AS target_output
            FROM padded""",
        "padded",
    ),
    "batch_lengths": _query(
        "SELECT lang_pair, split, batch_id, row_in_batch, src_lengths, tgt_lengths FROM padded",
        "padded",
    ),
    "step_plan": _query(
        """SELECT DISTINCT lang_pair, split, batch_id, CAST(batch_id // 2 AS BIGINT) AS step,
                  CAST(batch_id % 2 AS BIGINT) AS micro_step
           FROM batches""",
        "batches",
    ),
    "rank_shards": _query(
        """SELECT *, CAST(position % 3 AS BIGINT) AS rank
           FROM (SELECT lang_pair, split, shard_idx,
                        row_number() OVER (PARTITION BY lang_pair, split ORDER BY shard_idx) - 1
                        AS position
                 FROM (SELECT DISTINCT lang_pair, split, shard_idx FROM packed))""",
        "packed",
    ),
    "rank_sequences": _query(
        """SELECT lang_pair, split, shard_idx, seq_id, CAST(n % 3 AS BIGINT) AS rank, CAST(n // 3 AS BIGINT) AS rank_row
           FROM filled""",
        "filled",
    ),
    "shard_head": _query(
        """SELECT lang_pair, split, shard_idx, side, CAST(pos AS BIGINT) AS pos, CAST(token AS BIGINT) AS token
           FROM tokens WHERE pos < 100""",
        "tokens",
    ),
    "shuffle_epoch": _query(
        """SELECT lang_pair, split, n,
                  row_number() OVER (PARTITION BY lang_pair, split ORDER BY md5('7:2:' || n), n) - 1
                  AS position
           FROM sequences""",
        "sequences",
    ),
    "shuffle_permutation": _query(
        "SELECT lang_pair, split, n, position, n AS back FROM permuted", "permuted"
    ),
    "argmax_decode": _query("SELECT pair_id, pos, id FROM argmax", "argmax"),
    "decode_predictions": _query(
        """SELECT a.pair_id, coalesce(string_agg(v.token, ' ' ORDER BY a.pos), '') AS text
           FROM argmax a LEFT JOIN vocabulary v ON v.id = a.id
           GROUP BY a.pair_id""",
        "argmax",
        "vocabulary",
    ),
    "decode_roundtrip": _query(
        "SELECT conv_id, turn, src_text, tgt_text FROM conversation_pairs", "conversation_pairs"
    ),
    "bleu_sentence": _query(
        f"SELECT conv_id, turn, round({_BLEU}, 4) AS bleu FROM bleu_counts", "bleu_counts"
    ),
    "bleu_corpus": _query(
        f"SELECT *, round({_BLEU}, 4) AS bleu FROM (SELECT count(*) AS pairs, "
        + ", ".join(
            f"CAST(sum({name}) AS BIGINT) AS {name}"
            for name in [f"{k}_{n}" for k in ("match", "total") for n in (1, 2, 3, 4)]
            + ["c_len", "r_len"]
        )
        + " FROM bleu_counts)",
        "bleu_counts",
    ),
    "meteor_exact": _query(
        "SELECT conv_id, turn, matches, chunks, round(meteor, 4) AS meteor FROM meteor_scores",
        "meteor_scores",
    ),
    "meteor_stem": _query(
        "SELECT conv_id, turn, matches, chunks, round(meteor, 4) AS meteor FROM stem_scores",
        "stem_scores",
    ),
    "bert_score_pairs": _query(
        """SELECT pair_id, round(precision, 4) AS precision, round(recall, 4) AS recall,
                  round(f1, 4) AS f1
           FROM bert_scores""",
        "bert_scores",
    ),
    "bert_score_mean": _query(
        """SELECT round(avg(precision), 4) AS bert_precision, round(avg(recall), 4) AS bert_recall,
                  round(avg(f1), 4) AS bert_f1
           FROM bert_scores""",
        "bert_scores",
    ),
    "stream_ingest": _query(
        f"""SELECT {_SUMMARY}
            FROM (SELECT lang_pair, shard_idx, n_src, n_tgt,
                         CASE WHEN shard_idx = 0 THEN 'val' ELSE 'train' END AS split
                  FROM (SELECT lang_pair, pair_id, CAST(shard_idx AS BIGINT) AS shard_idx
                        FROM greedy_conversations)
                  JOIN counted USING (lang_pair, pair_id))
            {_BY_SHARD}""",
        "counted",
        "greedy_conversations",
    ),
    "stream_runlog": _query(_BEST, "runlog"),
}

# the same shards, in whatever order the pairs arrive
ORACLES["stream_unordered"] = ORACLES["stream_ingest"]
