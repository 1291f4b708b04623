"""Substring deduplication by automata of recurring passages.

A phrase is a window of ``WINDOW`` words that starts at two places or more.

1. In each window the smallest hash of ``ANCHOR`` words is its anchor, so that equal
   windows have equal anchors. Rows give their anchors to the anchor's task, which sends
   those that recur back to the rows, as a table that is joined.
2. Consecutive windows with one anchor are a segment. Segments whose anchor recurs move, as
   words, to the shard of their anchor. An anchor with more than ``HOT_ROWS`` segments
   has several shards.
3. A shard confirms which windows recur in it, word by word, and compiles them into an
   Aho-Corasick automaton; all segments of the shard stream through it. Of the places that
   it locates for a window, all but the first are later ones. Windows of a divided
   anchor that are first in their shard meet again, by window, in a second automaton.
4. Places return to their rows as bit masks, and every later window loses its words.

The letters of an automaton are blocks of ``STRIDE`` words of its shard, numbered exactly; a
window is four letters, and a shard is read in ``STRIDE`` phases, one for each start. A letter is
written in ``DIGITS`` characters, each with an alphabet of its own: nodes with few children
are fast, and no match can begin inside a letter.

Places are compared by key, a null key being smaller than any other, and belong to a row,
which is a key with the digest of a text. Texts move once: both joins with them read the
same exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.spans import (
    Words,
    byte_hashes,
    distinct_spans,
    gram_hashes,
    mix,
    ranges,
    slices,
    text_bytes,
    words_of,
    worker_cache,
)
from pairloom.llm.tables import free_name, map_texts, record_batch

WINDOW = 20
ANCHOR = 8
STRIDE = 5
SEGMENT = WINDOW - ANCHOR + 1  # windows that can share an anchor
HOT_ROWS = 4096
HOT_PLACES = 14  # bits: an anchor of one long text is divided by place
SHARD_BYTES = 1 << 20  # of words that are settled at once; a larger group is a shard of its own
CARRY_ROWS, CARRY_BYTES = 4 * HOT_ROWS, 4 * SHARD_BYTES  # of one group before a part of it is settled
PIECE_BYTES = 1 << 18  # copied at once, since places of bytes take eight times their room
FIRST_ROWS = 1 << 14  # windows that are first in their shard, in a batch
DIGITS, DIGIT_BITS = 3, 7
ROW = ["key", "none", "row"]
ANCHORS = "anchor bigint, key bigint, none boolean, row bigint, n int"
RECURRING = "key bigint, none boolean, row bigint, anchor bigint, part int"
SEGMENTS = "anchor bigint, part bigint, key bigint, none boolean, row bigint, place int, words string"
LOCATED = "spread bigint, part bigint, key bigint, none boolean, row bigint, place int, later int, words string"


def window_anchors(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``ANCHOR`` words from each place on, and the smallest in each window in ``at``."""
    grams = gram_hashes(hashes, np.arange(len(hashes) - ANCHOR + 1), ANCHOR)
    low, width = grams, 1
    while width < SEGMENT:
        step = min(width, SEGMENT - width)
        low = np.minimum(low[:-step], low[step:])
        width += step
    return grams, low[at]


def anchor_places(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(place, anchor)`` of all places that have the smallest hash of a window in ``at``."""
    grams, low = window_anchors(hashes, at)
    highest = np.zeros(len(grams), np.uint64)  # of the windows that cover a place
    padded = np.zeros(len(hashes) + 1, np.uint64)
    padded[at] = low
    for shift in range(SEGMENT):
        np.maximum(highest[shift:], padded[: len(grams) - shift], out=highest[shift:])
    place = np.flatnonzero((highest == grams) & (highest > 0))
    return place, grams[place]


def segments(words: Words, at: np.ndarray, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(first, size)`` of runs of consecutive windows of a text with one anchor, ``SEGMENT`` at most.

    ``first`` are places in ``at``.
    """
    new = np.ones(len(at), bool)
    new[1:] = (
        (at[1:] != at[:-1] + 1)
        | (words.doc[at[1:]] != words.doc[at[:-1]])
        | (anchors[1:] != anchors[:-1])
    )
    run = np.flatnonzero(new)
    in_run = np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))
    first = np.flatnonzero(in_run % SEGMENT == 0)
    return first, np.diff(np.append(first, len(at)))


def row_anchors(rows: DataFrame) -> DataFrame:
    """``ANCHORS``: each anchor of each row, with the number of its places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache(None)
        for batch in batches:
            for start, texts in slices(batch.column(0)):
                words = words_of(texts)
                at = words.gram_starts(WINDOW)
                if not len(at):
                    continue
                place, anchors = anchor_places(words.hashes(), at)
                doc, anchors = words.doc[place], anchors.view(np.int64)
                order = np.lexsort((anchors, doc))
                doc, anchors = doc[order], anchors[order]
                new = np.ones(len(doc), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (anchors[1:] != anchors[:-1])
                new = np.flatnonzero(new)
                own = pa.array(doc[new] + start)
                found = {c: batch.column(i + 1).take(own) for i, c in enumerate(ROW)}
                yield record_batch(ANCHORS, found | {"anchor": anchors[new], "n": np.diff(np.append(new, len(doc)))})

    return rows.select("text", *ROW).mapInArrow(run, ANCHORS)


def _recurring_groups(rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of whole groups of one anchor, in order, the rows of those that recur, with their part."""
    anchor = rows["anchor"]
    begins = np.ones(len(anchor), bool)
    begins[1:] = anchor[1:] != anchor[:-1]
    new = begins.copy()  # equal rows count once
    for c in ROW:
        new[1:] |= rows[c][1:] != rows[c][:-1]
    rows, begins = {c: x[new] for c, x in rows.items()}, np.flatnonzero(begins[new])
    sizes = np.diff(np.append(begins, len(rows["anchor"])))
    n = rows["n"].astype(np.int64)
    total = np.add.reduceat(n, begins) if len(begins) else sizes
    before = np.cumsum(n) - n
    before -= np.repeat(before[begins], sizes)
    part = np.where(np.repeat(total > HOT_ROWS, sizes), before // HOT_ROWS, -1)
    recurs = np.repeat(total > 1, sizes)
    return {c: x[recurs] for c, x in (rows | {"part": part}).items() if c != "n"}


def recurring_anchors(anchors: DataFrame) -> DataFrame:
    """``RECURRING``: the anchors of two places or more, back at their rows.

    The rows of an anchor stream by in order; no more than ``HOT_ROWS`` and a batch are held.
    A part of a hot anchor has about ``HOT_ROWS`` places.
    """
    names = [x.split()[0] for x in ANCHORS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {c: np.zeros(0, bool if c == "none" else np.int64) for c in names}
        hot, index = None, 0  # an anchor that is known to be hot, and its places so far
        for batch in batches:
            rows = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(names)}
            if hot is not None:
                to = int(np.searchsorted(rows["anchor"], hot, "right"))
                more = {c: x[:to] for c, x in rows.items()}
                places = index + np.cumsum(more.pop("n").astype(np.int64))
                yield record_batch(RECURRING, more | {"part": (places - rows["n"][:to]) // HOT_ROWS})
                index = int(places[-1]) if to else index
                rows = {c: x[to:] for c, x in rows.items()}
            if not len(rows["anchor"]):
                continue
            hot = None
            rows = {c: np.concatenate([held[c], x]) for c, x in rows.items()}
            last = int(np.searchsorted(rows["anchor"], rows["anchor"][-1]))
            yield record_batch(RECURRING, _recurring_groups({c: x[:last] for c, x in rows.items()}))
            held = {c: x[last:] for c, x in rows.items()}
            if len(held["anchor"]) > HOT_ROWS:
                more = dict(held)
                places = np.cumsum(more.pop("n").astype(np.int64))
                yield record_batch(RECURRING, more | {"part": (places - held["n"]) // HOT_ROWS})
                hot, index = held["anchor"][0], int(places[-1])
                held = {c: x[:0] for c, x in held.items()}
        yield record_batch(RECURRING, _recurring_groups(held))

    ordered = anchors.repartition("anchor").sortWithinPartitions("anchor", *ROW).select(*names)
    return ordered.mapInArrow(run, RECURRING)


def _pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of spans, which may overlap, as strings."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    data, at = np.empty(offsets[-1], np.uint8), 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE_BYTES, "right")) - 1)
        one = slice(starts[at], ends[at])
        data[offsets[at] : offsets[to]] = buf[one if to == at + 1 else ranges(starts[at:to], sizes[at:to])]
        at = to
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    return pa.Array.from_buffers(pa.large_string(), len(sizes), buffers)


def recurring_segments(rows: DataFrame, kept: list[str]) -> DataFrame:
    """``SEGMENTS`` of rows with the list of their recurring anchors (``anchors``).

    Columns ``kept`` are read so that the exchange below is that of the last join, too.
    """

    def of_text(doc: np.ndarray, anchor: np.ndarray) -> np.ndarray:
        return mix(anchor ^ mix(doc.astype(np.uint64) + np.uint64(1)))

    def run(texts, others):
        words = words_of(texts)
        at = words.gram_starts(WINDOW)
        lists = others[0]
        entries = lists.flatten()
        sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy()
        known = of_text(np.repeat(np.arange(len(texts)), sizes), entries.field("anchor").to_numpy().view(np.uint64))
        parts = entries.field("part").to_numpy().astype(np.int64)
        order = np.argsort(known)
        known, parts = known[order], parts[order]
        anchors = window_anchors(words.hashes(), at)[1] if len(at) else np.zeros(0, np.uint64)
        own = of_text(words.doc[at], anchors)
        place = np.minimum(np.searchsorted(known, own), max(0, len(known) - 1))
        live = known[place] == own if len(known) else np.zeros(len(at), bool)
        at, anchors, parts = at[live], anchors[live], parts[place[live]]
        first, size = segments(words, at, anchors)
        begin, part = at[first], parts[first]
        doc = words.doc[begin]
        offset = begin - words.bounds[doc]
        rows_ = pa.array(doc)
        return {
            "anchor": anchors[first].view(np.int64),
            "part": np.where(part < 0, -1, part << 32 | offset >> HOT_PLACES),
            "place": offset,
            "words": _pieces(words.buf, words.starts[begin], words.ends[begin + size + WINDOW - 2]),
        } | {c: others[1 + i].take(rows_) for i, c in enumerate(ROW)}

    return map_texts(rows, ["text", "anchors", *ROW, *kept], SEGMENTS, run)


def exact_letters(codes: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """A number for each block of ``STRIDE`` words, equal for equal words and for no others."""
    grams = gram_hashes(hashes, np.arange(len(hashes) - STRIDE + 1), STRIDE)
    _, first, letter = np.unique(grams, return_index=True, return_inverse=True)
    n = len(grams)
    if any((codes[k : n + k] != codes[first[letter] + k]).any() for k in range(STRIDE)):
        blocks = np.stack([codes[k : n + k] for k in range(STRIDE)], axis=1)
        letter = np.unique(blocks, axis=0, return_inverse=True)[1].reshape(-1)
    return letter


def written(letters: np.ndarray) -> np.ndarray:
    """The characters of each letter, the highest digit first."""
    if len(letters) and int(letters.max()) >> DIGITS * DIGIT_BITS:
        raise ValueError("a shard has too many letters")
    digits = np.arange(DIGITS)
    values = letters[:, None] >> DIGIT_BITS * digits[::-1] & ((1 << DIGIT_BITS) - 1)
    return (values + (digits + 1 << DIGIT_BITS)).astype("<u4")


def compiled(patterns: list[str]):
    """The automaton of a shard; it gives the number of a pattern."""
    from ahocorasick import STORE_INTS, Automaton

    automaton = Automaton(STORE_INTS)
    for k, pattern in enumerate(patterns):
        automaton.add_word(pattern, k)
    automaton.make_automaton()
    return automaton


def located(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """``(window, pattern)`` of all occurrences of recurring windows, in one text each."""
    nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = words.gram_starts(WINDOW)
    if len(at) < 2:
        return nothing
    codes, distinct = distinct_spans(words.buf, words.starts, words.ends)
    buf, offsets = text_bytes(distinct.cast(pa.large_string()))
    hashes = byte_hashes(buf, offsets[:-1], offsets[1:])[codes]
    _, window, n = np.unique(gram_hashes(hashes, at, WINDOW), return_inverse=True, return_counts=True)
    again = at[n[window] > 1]
    if not len(again):
        return nothing
    letters = written(exact_letters(codes, hashes))
    steps = np.arange(0, WINDOW, STRIDE)
    size = DIGITS * len(steps)
    string = letters[again[:, None] + steps].tobytes().decode("utf-32-le")
    patterns = list(dict.fromkeys(string[i : i + size] for i in range(0, len(string), size)))
    automaton = compiled(patterns)
    places, found = [], []
    for phase in range(STRIDE):
        string = letters[phase::STRIDE].tobytes().decode("utf-32-le")
        matches = np.array(list(automaton.iter(string)) if automaton.kind else [], np.int64).reshape(-1, 2)
        places.append(phase + STRIDE * ((matches[:, 0] + 1) // DIGITS - len(steps)))
        found.append(matches[:, 1])
    places, found = np.concatenate(places), np.concatenate(found)
    whole = words.doc[places] == words.doc[places + WINDOW - 1]
    return places[whole], found[whole]


def later_windows(texts: pa.Array, key: np.ndarray, none: np.ndarray, place: np.ndarray) -> tuple[Words, np.ndarray]:
    """Words of segments, and the windows (places of their first words) that also start earlier.

    ``place`` is that of a segment in its text.
    """
    words = words_of(texts)
    window, pattern = located(words)
    doc = words.doc[window]
    of = none[doc], key[doc], place[doc] + window - words.bounds[doc]
    order = np.lexsort((of[2], of[1], ~of[0], pattern))
    pattern, window = pattern[order], window[order]
    of = [x[order] for x in of]
    begins = np.ones(len(pattern), bool)
    begins[1:] = pattern[1:] != pattern[:-1]
    begins = np.flatnonzero(begins)
    first = np.repeat(begins, np.diff(np.append(begins, len(pattern))))
    return words, window[np.any([x != x[first] for x in of], axis=0)]


def _settled(rows: pa.Table) -> tuple[Iterator[pa.RecordBatch], np.ndarray]:
    """``LOCATED`` of the segments of whole groups; and which segments hold a first window.

    Later windows are bits of a mask. Windows of a divided anchor that are first here go on,
    each by itself.
    """
    rows = rows.combine_chunks()
    column = {c: rows[c].to_numpy() for c in ("part", "key", "row", "place")}
    none = rows["none"].to_numpy().astype(bool)
    words, later = later_windows(rows["words"].combine_chunks(), column["key"], none, column["place"])
    masks = np.zeros(rows.num_rows, np.int64)
    doc = words.doc[later]
    np.bitwise_or.at(masks, doc, 1 << (later - words.bounds[doc]))
    at = words.gram_starts(WINDOW)
    is_first = np.ones(len(at), bool)
    is_first[np.searchsorted(at, later)] = False
    at = at[is_first]
    holds = np.zeros(rows.num_rows, bool)
    holds[words.doc[at]] = True
    at = at[column["part"][words.doc[at]] >= 0]

    def found(spread: np.ndarray, doc: np.ndarray, place: np.ndarray, later: np.ndarray, pieces: pa.Array) -> pa.RecordBatch:
        out = {"spread": spread.view(np.int64), "part": np.full(len(doc), -1), "none": none[doc], "place": place, "later": later}
        return record_batch(LOCATED, out | {c: column[c][doc] for c in ("key", "row")} | {"words": pieces})

    def batches() -> Iterator[pa.RecordBatch]:
        some = np.flatnonzero(masks)
        spread = mix(column["row"][some].view(np.uint64) ^ column["place"][some].astype(np.uint64))
        yield found(spread, some, column["place"][some], masks[some], pa.nulls(len(some), pa.large_string()))
        hashes = gram_hashes(words.hashes(), at, WINDOW) if len(at) else np.zeros(0, np.uint64)
        for k in range(0, len(at), FIRST_ROWS):
            first = at[k : k + FIRST_ROWS]
            doc = words.doc[first]
            pieces = _pieces(words.buf, words.starts[first], words.ends[first + WINDOW - 1])
            place = column["place"][doc] + first - words.bounds[doc]
            yield found(hashes[k : k + FIRST_ROWS], doc, place, np.zeros(len(doc), np.int64), pieces)

    return batches(), holds


def shards(batches: Iterator[pa.RecordBatch], group: list[str]) -> Iterator[pa.RecordBatch]:
    """``LOCATED`` of rows that come in order of their groups; the groups of ``SHARD_BYTES`` of words are a shard.

    The last group is held back until it is whole. A very large one is settled in parts,
    each with the segments before it that hold a first window; a part is as large as what is
    held of those before, so that no segment is settled often.
    """
    held, kept = None, (0, 0)  # rows and bytes of the held group that were settled
    for batch in batches:
        for at, words in slices(batch.column("words"), SHARD_BYTES):
            rows = pa.Table.from_batches([batch.slice(at, len(words))])
            rows = rows if held is None else pa.concat_tables([held, rows])
            same = np.ones(rows.num_rows, bool)
            for c in group:
                values = rows[c].to_numpy()
                same &= values == values[-1]
            last = int(same.argmax())
            if last:
                yield from _settled(rows.slice(0, last))[0]
                rows, kept = rows.slice(last), (0, 0)
            if rows.num_rows > max(CARRY_ROWS, 2 * kept[0]) or rows["words"].nbytes > max(CARRY_BYTES, 2 * kept[1]):
                found, holds = _settled(rows)
                yield from found
                rows = rows.filter(pa.array(holds))
                kept = rows.num_rows, rows["words"].nbytes
            held = rows
    if held is not None:
        yield from _settled(held)[0]


def later_places(rows: DataFrame, kept: list[str]) -> DataFrame:
    """``key, none, row, places`` of rows with windows that also start earlier.

    A place is a segment with a bit mask of those windows.
    """
    lists = recurring_anchors(row_anchors(rows)).groupBy(*ROW).agg(
        F.collect_list(F.struct("anchor", "part")).alias("anchors")
    )
    moved = recurring_segments(rows.join(lists.hint("merge"), ROW), kept)
    order = [F.desc("none"), "key", "place"]

    def first_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return shards(batches, ["anchor", "part"])

    def second_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def windows() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                done = pa.compute.is_null(batch.column("words"))
                ready.append(batch.filter(done))
                yield batch.filter(pa.compute.invert(done))

        ready: list[pa.RecordBatch] = []
        for found in shards(windows(), ["spread"]):
            yield from ready
            ready.clear()
            yield found
        yield from ready

    in_shards = (
        moved.repartition("anchor", "part").sortWithinPartitions("anchor", "part", *order)
        .mapInArrow(first_shards, LOCATED)
    )
    again = (
        in_shards.repartition("spread").sortWithinPartitions("spread", *order)
        .mapInArrow(second_shards, LOCATED)
    )
    # equal rows give equal windows, so masks are united and not added
    masks = again.groupBy(*ROW, "place").agg(F.bit_or("later").alias("later"))
    return masks.groupBy(*ROW).agg(F.collect_list(F.struct("place", "later")).alias("places"))


def words_in_repeats(texts: pa.Array, places: pa.Array) -> tuple[np.ndarray, Words]:
    """For each word of the slice whether it is in a window that also starts earlier."""
    words = words_of(texts)
    covered = np.zeros(len(words.starts) + 1, np.int64)
    found = places.flatten()
    if len(found):
        counts = pa.compute.fill_null(pa.compute.list_value_length(places), 0).to_numpy()
        base = np.repeat(words.bounds[:-1], counts) + found.field("place").to_numpy()
        masks = found.field("later").to_numpy()
        for off in range(SEGMENT):
            later = base[masks >> off & 1 == 1] + off
            np.add.at(covered, later, 1)
            np.add.at(covered, later + WINDOW, -1)
    return np.cumsum(covered)[:-1] > 0, words


def remove_repeats(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", rejoin: bool = True) -> DataFrame:
    """Columns ``keep``, ``n_words``, ``n_removed`` and ``kept_text`` of every document.

    A word goes if a window that covers it also starts earlier: in a document with a
    smaller key, or before in the same one. What is left is joined by single spaces;
    without ``rejoin``, a text that loses nothing stays as it is. Null and empty texts have no
    words; a null key counts as smallest; rows of one key are one document, so equal
    places in them do not count against each other. An empty table gives no rows.
    """
    # names of the caller's columns cannot clash with these
    kept = [(f"k{i}", dict(docs.dtypes)[c], c) for i, c in enumerate(keep)]
    names = [name for name, _, _ in kept]
    rows = docs.select(
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.coalesce(F.col(key).cast("bigint"), F.lit(0).cast("bigint")).alias("key"),
        F.col(key).isNull().alias("none"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"),
        *[F.col(c).alias(name) for name, _, c in kept],
    )
    found = rows.join(later_places(rows, names).hint("merge"), ROW, "left")  # alike at every size
    schema = ",".join(
        [f"{name} {kind}" for name, kind, _ in kept]
        + ["n_words bigint", "n_removed bigint", "kept_text string"]
    )

    def run(texts, others):
        gone, words = words_in_repeats(texts, others[0])
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = sums[words.bounds[1:]] - sums[words.bounds[:-1]]
        raw, offsets, bounds = words.buf.tobytes(), words.offsets.tolist(), words.bounds.tolist()
        left = (~gone).tolist()
        out = []
        for d, n in enumerate(removed.tolist()):
            whole = raw[offsets[d] : offsets[d + 1]]
            if n:
                whole = b" ".join(compress(whole.split(), left[bounds[d] : bounds[d + 1]]))
            elif rejoin:
                whole = b" ".join(whole.split())
            out.append(whole)
        return {
            "n_words": np.diff(words.bounds),
            "n_removed": removed,
            "kept_text": pa.array(out, pa.binary()).cast(pa.string()),
        } | {name: column for (name, _, _), column in zip(kept, others[1:])}

    found = map_texts(found, ["text", "places", *names], schema, run)
    return found.select(
        *[F.col(name).alias(c) for name, _, c in kept], "n_words", "n_removed", "kept_text"
    )


def digests(docs: DataFrame) -> DataFrame:
    """The counts of ``remove_repeats`` and the digest of the text that is left."""
    return remove_repeats(docs.select("doc_id", "text"), ["doc_id"]).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` without repeated passages; texts that lose nothing stay as they are.

    A text that loses words is what is left, joined by single spaces, and its
    ``n_chars``, if there is such a column, is counted anew. A null text stays null.
    """
    columns = [c for c in docs.columns if c != "text"]
    hidden = {c: free_name(docs, f"in_{i}") for i, c in enumerate(columns)}
    null = free_name(docs, "null_text")
    renamed = docs.select(
        "text", F.col("text").isNull().alias(null), *[F.col(c).alias(hidden[c]) for c in columns]
    )
    found = remove_repeats(renamed, [null, *hidden.values()], hidden["doc_id"], "text", rejoin=False)
    lost = F.col("n_removed") > 0

    def column(c: str):
        if c == "text":
            return F.when(~F.col(null), F.col("kept_text"))
        if c == "n_chars":
            return F.when(lost, F.char_length("kept_text").cast(dict(docs.dtypes)[c])).otherwise(F.col(hidden[c]))
        return F.col(hidden[c])

    return found.select(*[column(c).alias(c) for c in docs.columns])
