"""Spelling variants: near words by a bit-sliced position index.

Two words are near if one inserted, deleted or replaced character makes them equal.

1. Pairs of lengths s and s, or s and s + 1, differ at one place only, so that all in
   front of a window of places and all behind it are equal. A word goes to a block for each
   window (at first the two halves) of each length it can be paired with. A block with more than
   ``BLOCK_WORDS`` words is cut: its window is halved, until it has one place, where a
   block cannot have more words than the alphabet allows.
2. Blocks stream by in order. For a run of whole blocks there is, for each place and letter,
   a bitset of the words that have the letter there. Each word of length s asks for all
   words at once: step by step the set ``exact`` (no error so far), the set ``replaced``
   (one) and the set ``inserted`` (one, places shifted by one) are kept by word-wide ands
   and ors. What is left at the end are the near words.
3. A pair is counted in the window that holds the first place where it differs, once.
   Each block gives numbers and the best near word of a word, not pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.spans import lower_ascii, runs_of, text_bytes, worker_cache
from pairloom.llm.tables import map_texts, record_batch
from pairloom.session import materialise

MIN_CHARS = 7
MIN_COUNT = 2
RATIO = 10  # a form is so many times as frequent
SLIP = 31  # one run in so many loses a character
BLOCK_WORDS = 1024
BLOCK_CELLS = 1 << 24  # characters of a block
GROUP_WORDS = 1024  # indexed together
_LEAD = 0xC3  # first byte of U+00C0 to U+00FF in UTF-8
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), _LEAD]] = True
FOUND = "word string, n_near bigint, best_n bigint, best string"


def slipped(run: bytes, h: int, slip: int = SLIP) -> bytes:
    """The run, without one character if ``slip`` divides its hash."""
    if h % slip:
        return run
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def vocabulary(
    docs: DataFrame, key: str = "doc_id", text: str = "text",
    min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, slip: int = SLIP,
) -> DataFrame:
    """``word, n`` of the runs of letters of all texts, A-Z in lower case.

    One run in ``slip``, chosen by a hash of key and run, loses a character. Words of fewer
    than ``min_chars`` characters or ``min_count`` occurrences are left out. Null and empty
    texts have no words, repeated rows count each, a null key is hashed as an empty one.
    """

    def run(texts, others):
        worker_cache(None)
        buf, offsets = text_bytes(texts)
        buf = lower_ascii(buf)
        inside = _LETTER[buf]
        inside[1:] |= buf[:-1] == _LEAD
        starts, ends = runs_of(inside, offsets)
        chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
        long = chars[ends] - chars[starts] >= min_chars  # none grows
        starts, ends = starts[long], ends[long]
        doc = np.searchsorted(offsets, starts, "right") - 1
        raw = buf.tobytes()
        seeds = [zlib.crc32(f"{k or ''}:".encode()) for k in others[0].to_pylist()]
        words = [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
        for i, d in enumerate(doc.tolist()):
            h = zlib.crc32(words[i], seeds[d])
            if not h % slip:
                words[i] = slipped(words[i], h, slip)
        counts = pa.array(words, pa.binary()).value_counts()
        return {"word": counts.field("values").cast(pa.string()), "n": counts.field("counts")}

    counted = map_texts(docs, [text, F.col(key).cast("string")], "word string, n bigint", run)
    return counted.where(F.char_length("word") >= min_chars).groupBy("word").agg(
        F.sum("n").alias("n")
    ).where(F.col("n") >= min_count)


def _entry(s: Column, a: Column, b: Column) -> Column:
    """A word's place in the blocks of windows ``a`` to ``b`` of pairs with shorter length ``s``."""
    front = F.col("word").substr(F.lit(1), a)
    behind = F.call_function("right", F.col("word"), s - b)
    return F.struct(
        F.xxhash64(s, a, b, front, behind).alias("block"),
        s.alias("s"), a.alias("a"), b.alias("b"),
    )


def _halves(s: Column, a: Column, b: Column) -> list[Column]:
    middle = F.floor((a + b) / 2).cast("int")
    return [_entry(s, a, middle), _entry(s, middle, b)]


def blocks(words: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``word, n, block, s, a, b``: the blocks of each word."""
    size = F.char_length("word")
    rows = words.select(
        "word", "n", F.explode(F.array(size, size - 1)).alias("s")
    ).select("word", "n", F.explode(F.array(*_halves(F.col("s"), F.lit(0), F.col("s")))).alias("e"))
    rows, done = rows.select("word", "n", "e.*"), None
    while True:
        large = materialise(
            rows.groupBy("block")
            .agg(F.count(F.lit(1)).alias("size"), F.max("s").alias("s"), F.max(F.col("b") - F.col("a")).alias("width"))
            .where("width > 1 and size > 1")
            .where((F.col("size") > block_words) | (F.col("size") * F.col("s") > BLOCK_CELLS))
            .select("block"),
            "large-blocks",
        )
        if not large.limit(1).count():
            return rows if done is None else done.unionByName(rows)
        whole = rows.join(large, "block", "left_anti").select(rows.columns)
        done = whole if done is None else done.unionByName(whole)
        rows = (
            rows.join(large, "block", "left_semi")
            .select("word", "n", F.explode(F.array(*_halves(F.col("s"), F.col("a"), F.col("b")))).alias("e"))
            .select("word", "n", "e.*")
        )


def _letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the letters, a row for each word, and the lengths; places behind a word have -1."""
    sizes = np.array(list(map(len, words)))
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4")
    _, codes = np.unique(points, return_inverse=True)
    table = np.full((len(words), int(sizes.max())), -1, np.int16)
    table[np.arange(table.shape[1]) < sizes[:, None]] = codes
    return table, sizes


def _planes(column: np.ndarray, n_letters: int) -> np.ndarray:
    """Bitsets over the words, one for each letter, of those that have it in this column."""
    n = len(column)
    held = np.zeros((n_letters, -(-n // 64) * 64), bool)
    at = np.flatnonzero(column >= 0)
    held[column[at], at] = True
    return np.packbits(held, axis=1).view(np.uint64)


def near_pairs(words: list[str], s: int) -> tuple[np.ndarray, np.ndarray]:
    """``(i, j)``: words of ``s`` characters, and near words of ``s`` or ``s + 1``.

    A pair of two words of ``s`` characters is given in both directions.
    """
    table, sizes = _letters(words)
    n, n_letters = len(words), int(table.max()) + 1
    if table.shape[1] <= s:
        table = np.concatenate([table, np.full((n, s + 1 - table.shape[1]), -1, np.int16)], axis=1)
    asking = np.flatnonzero(sizes == s)
    whole = np.packbits(np.arange(-(-n // 64) * 64) < n).view(np.uint64)
    exact = np.repeat(whole[None], len(asking), axis=0)
    replaced, inserted = np.zeros_like(exact), np.zeros_like(exact)
    here = _planes(table[:, 0], n_letters)
    for i in range(s):
        letter = table[asking, i]
        behind = _planes(table[:, i + 1], n_letters)
        same = here[letter]
        inserted |= exact  # the other word has one more here
        inserted &= behind[letter]
        replaced &= same
        replaced |= exact & ~same
        exact &= same
        here = behind
    inserted |= exact

    def of_size(k: int) -> np.ndarray:
        flags = np.zeros(-(-n // 64) * 64, bool)
        flags[:n] = sizes == k
        return np.packbits(flags).view(np.uint64)

    found = (replaced & of_size(s)) | (inserted & of_size(s + 1))
    row = np.flatnonzero(found.any(axis=1))
    i, j = np.nonzero(np.unpackbits(found[row].view(np.uint8), axis=1)[:, :n])
    return asking[row[i]], j


def _in_group(rows: list[tuple]) -> dict[str, list]:
    """Numbers and the best near word of each word of whole blocks with one ``s``."""
    words = [r[0] for r in rows]
    n, block = (np.array([r[k] for r in rows]) for k in (1, 2))
    s, low, high = rows[0][3], *(np.array([r[k] for r in rows]) for k in (4, 5))
    i, j = near_pairs(words, s)
    own = block[i] == block[j]
    i, j = i[own], j[own]
    table, sizes = _letters(words)
    equal = table[i, :s] == table[j, :s]
    first = np.where(equal.all(axis=1), s, equal.argmin(axis=1))  # place of the difference
    first = np.minimum(first, s - 1)
    held = (low[i] <= first) & (first < high[i])
    i, j = i[held], j[held]
    longer = sizes[j] > s
    word, near = np.concatenate([i, j[longer]]), np.concatenate([j, i[longer]])
    if not len(word):
        return {}
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[near], -n[near], word))
    word, near = word[order], near[order]
    starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    return {
        "word": [words[k] for k in word[starts].tolist()],
        "n_near": np.diff(np.append(starts, len(word))),
        "best_n": n[near[starts]],
        "best": [words[k] for k in near[starts].tolist()],
    }


def near_words(rows: DataFrame) -> DataFrame:
    """``FOUND`` of the words with near words in a block, a row for each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(None)
        group: list[tuple] = []  # whole blocks with one s
        block: list[tuple] = []

        def close() -> Iterator[pa.RecordBatch]:
            if group:
                found = _in_group(group)
                if found:
                    yield record_batch(FOUND, found)
                group.clear()

        def put() -> Iterator[pa.RecordBatch]:
            if len(block) > 1:  # a word alone has no near words there
                size = len(group) + len(block)
                full = size > GROUP_WORDS or size * block[0][3] > BLOCK_CELLS
                if group and (full or group[0][3] != block[0][3]):
                    yield from close()
                group.extend(block)
            block.clear()

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if block and block[0][2:6] != row[2:6]:
                    yield from put()
                block.append(row)
        yield from put()
        yield from close()

    ordered = (
        rows.repartition("block").sortWithinPartitions("s", "block", "a")
        .select("word", "n", "block", "s", "a", "b")
    )
    return ordered.mapInArrow(run, FOUND)


def followed(forms: DataFrame) -> DataFrame:
    """``word, root`` of ``word, form``: the end of the chain of forms, by doubling steps.

    A form is ``RATIO`` times as frequent as its word, so chains are short and end.
    """
    at = materialise(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ends = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        steps = materialise(at.join(ends.hint("merge"), "root", "left"), "roots")
        if not steps.where("next is not null").limit(1).count():
            return at
        at = steps.select("word", F.coalesce("next", "root").alias("root"))


def variants(words: DataFrame, ratio: int = RATIO, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of ``words`` (``word, n``).

    The form is the near word with the largest ``n``, on ties the smallest, if that is at
    least ``ratio`` times the word's. Words must be unique and not null, and ``n`` above 0.
    An empty table gives no rows; other columns are not read.
    """
    words = materialise(words.select("word", "n"), "vocabulary")
    best = F.struct((-F.col("best_n")).alias("order"), "best")
    found = (
        near_words(blocks(words, block_words)).groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), F.min(best).alias("best"))
    )
    chosen = F.col("best.order") <= -ratio * F.col("n")
    rows = materialise(
        words.join(found.hint("merge"), "word", "left").select(
            "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(chosen, F.col("best.best")).alias("form"),
            F.when(chosen, -F.col("best.order")).alias("form_n"),
        ),
        "forms",
    )
    roots = followed(rows.where("form is not null"))
    return rows.join(roots.hint("merge"), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
