"""Token ids of whole texts, made once for each distinct chunk and put together.

The three tokenizers used here never join a word with white space behind it. A
chunk (white space and the word after it) is therefore encoded without looking at
its neighbours, and the ids of a text are those of its chunks in order. The chunks of a
slice are told apart by their bytes. Where no token of the ``tokenizers`` files reaches from
an ASCII letter or digit into a mark behind it, a chunk ends there, and where they lower-case, A to Z
do so before, so that fewer chunks are distinct. The Python process keeps a pool of chunks over
batches and tasks of a job: it is looked up by hash, and a chunk whose bytes are not
those of the pool's counts as new. Only new ones reach the encoder. The pool is emptied
at ``POOL_CHUNKS`` or ``POOL_BYTES``.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Sequence
from itertools import chain
from operator import itemgetter
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
import pyarrow.compute

from pairloom.llm.spans import SPACE, byte_hashes, chunk_starts, distinct_spans, lower_ascii, ranges, text_bytes, worker_cache

POOL_CHUNKS = 1_000_000
POOL_BYTES = 32 << 20  # of chunks and of ids, each
CALL_CHUNKS = 1 << 14  # given to the encoder at once
JOINED = 256  # chunks in a text for the library, which takes long for each text


def _concatenated(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all values and the offset of each."""
    at = np.frombuffer(values.buffers()[1], np.int64, len(values) + 1, values.offset * 8)
    data = values.buffers()[2]
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


class ChunkPool:
    def __init__(
        self,
        encode: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]],
        breaks: bytes | None = None,
        at_marks: bool = False,
        lower: bool = False,
    ):
        self.encode = encode  # of chunks (bytes): all ids, one after the other, and how many each has
        self.breaks, self.at_marks, self.lower = breaks, at_marks, lower
        self.clear()

    def clear(self) -> None:
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.entry = np.zeros(0, np.int64)  # of each hash
        self.bounds = np.zeros(1, np.int64)  # of the ids of each entry
        self.ids = np.zeros(0, np.int32)
        self.byte_bounds = np.zeros(1, np.int64)
        self.bytes = np.zeros(0, np.uint8)

    def _encoded(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, counts)`` of chunks."""
        lengths, parts = [], [np.zeros(0, np.int32)]
        for at in range(0, len(chunks), CALL_CHUNKS):
            ids, counts = self.encode(chunks.slice(at, CALL_CHUNKS))
            parts.append(ids)
            lengths.append(counts)
        return np.concatenate(parts), np.concatenate([np.zeros(0, np.int64), *lengths])

    def _known(self, hashes: np.ndarray, chunks: pa.Array) -> np.ndarray:
        """Entry of each chunk, -1 if the pool has other bytes or nothing under its hash."""
        out = np.full(len(hashes), -1)
        if not len(self.hashes):
            return out
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        entry = self.entry[at]
        buf, own = _concatenated(chunks)
        size = np.diff(own)
        hit = (self.hashes[at] == hashes) & (np.diff(self.byte_bounds)[entry] == size)
        if hit.any():
            sizes = size[hit]
            same = buf[ranges(own[:-1][hit], sizes)] == self.bytes[ranges(self.byte_bounds[entry[hit]], sizes)]
            ends = np.cumsum(sizes)
            hit[hit] = np.logical_and.reduceat(same, ends - sizes)
        out[hit] = entry[hit]
        return out

    def _add(self, hashes: np.ndarray, chunks: pa.Array) -> None:
        """Append chunks that are new; of equal hashes the pool keeps one."""
        ids, counts = self._encoded(chunks)
        buf, own = _concatenated(chunks)
        first = len(self.bounds) - 1
        self.ids = np.concatenate([self.ids, ids])
        self.bounds = np.concatenate([self.bounds, self.bounds[-1] + np.cumsum(counts)])
        self.bytes = np.concatenate([self.bytes, buf])
        self.byte_bounds = np.concatenate([self.byte_bounds, self.byte_bounds[-1] + own[1:]])
        order = np.argsort(hashes, kind="stable")
        at = np.searchsorted(self.hashes, hashes[order])
        self.hashes = np.insert(self.hashes, at, hashes[order])
        self.entry = np.insert(self.entry, at, first + order)

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """``(ids, bounds)``: ids of all texts, and where those of each text begin."""
        buf, offsets = text_bytes(texts)
        if self.lower:  # not before bytes of other characters, which may be marks that join the letter
            buf = np.where(np.append(buf[1:] < 0x80, True), lower_ascii(buf), buf)
        starts = chunk_starts(buf, offsets, self.breaks, self.at_marks)
        codes, chunks = distinct_spans(buf, starts, np.append(starts[1:], len(buf)))
        if len(self.hashes) + len(chunks) > POOL_CHUNKS or max(len(self.bytes), 4 * len(self.ids)) > POOL_BYTES:
            self.clear()
        own, at = _concatenated(chunks)
        hashes = byte_hashes(own, at[:-1], at[1:])
        entry = self._known(hashes, chunks)
        new = np.flatnonzero(entry < 0)
        if len(new):
            entry[new] = len(self.bounds) - 1 + np.arange(len(new))
            self._add(hashes[new], chunks.take(pa.array(new)))
        entry = entry[codes]
        counts = np.diff(self.bounds)[entry] if len(entry) else np.zeros(0, np.int64)
        ids = self.ids[ranges(self.bounds[entry], counts)]
        before = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
        return ids, before[np.searchsorted(starts, offsets)]


#: Characters for which a text is encoded as a whole: white space other than the
#: chunker's, and the beginning of the tokenizers' special tokens.
WHOLE = r"[\x1c-\x1f\x85\xa0\x{1680}\x{180e}\x{2000}-\x{200b}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]|<\|"


def flat_ids(lists: Sequence[Sequence[int]]) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(chain.from_iterable(lists), np.int32), np.array(list(map(len, lists)), np.int64)


def _joined_texts(chunks: pa.Array, joined: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Texts of ``joined`` chunks each, how many chunks each has, and the characters of each chunk."""
    buf, at = _concatenated(chunks)
    chars = np.concatenate([[0], np.cumsum((buf & 0xC0) != 0x80)])
    raw, cuts = buf.tobytes(), [*range(0, len(chunks), joined), len(chunks)]
    bounds = at[cuts].tolist()
    return [raw[a:b].decode() for a, b in zip(bounds, bounds[1:])], np.diff(cuts), np.diff(chars[at])


def encode_joined(tokenizer, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids and counts of chunks, of which ``JOINED`` at a time are one text for the library.

    A chunk that begins with white space and does not end with it is encoded alike behind any
    other such chunk; the others are texts of their own. Places of the ids in the text
    tell the chunks apart.
    """
    buf, at = _concatenated(chunks)
    alone = ~SPACE[buf[at[:-1]]] | SPACE[buf[at[1:] - 1]]
    order = np.argsort(alone, kind="stable")
    n = len(order) - int(alone.sum())
    parts = [
        _joined_texts(chunks.take(pa.array(order[:n])), JOINED),
        _joined_texts(chunks.take(pa.array(order[n:])), 1),
    ]
    texts, in_group, size = parts[0][0] + parts[1][0], *(np.concatenate(x) for x in zip(*(p[1:] for p in parts)))
    found = tokenizer.encode_batch(texts, add_special_tokens=False)
    ids, counts = flat_ids([x.ids for x in found])
    starts = np.fromiter(map(itemgetter(0), chain.from_iterable(x.offsets for x in found)), np.int64, len(ids))
    # places in all texts of this call, one after the other
    ends = np.cumsum(size)
    first = np.concatenate([[0], ends])[np.cumsum(in_group) - in_group]
    last = ends[np.cumsum(in_group) - 1] - 1
    owner = np.searchsorted(ends, np.minimum(starts + np.repeat(first, counts), np.repeat(last, counts)), "right")
    if (np.diff(owner) < 0).any():
        raise ValueError("ids do not stand in the order of their chunks")
    per_chunk = np.bincount(owner, minlength=len(order))
    begins = np.cumsum(per_chunk) - per_chunk
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return ids[ranges(begins[place], per_chunk[place])], per_chunk[place]


def tokenizers_encoder(path: str) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Encoder of a ``tokenizers`` file; the vocabulary is loaded once in a process."""

    def load():
        # a task has one core: threads of the library would only wait for each other
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        norm = tokenizer.normalizer
        lower = norm is not None and norm.normalize_str(ascii_uppercase) == ascii_lowercase
        return tokenizer, ChunkPool(lambda chunks: encode_joined(tokenizer, chunks), at_marks=True, lower=lower)

    def encode_texts(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        tokenizer, pool = worker_cache("tokenizer:" + path, load)
        texts = pa.compute.fill_null(texts, "")
        whole = pa.compute.match_substring_regex(texts, WHOLE)
        if not pa.compute.any(whole).as_py():
            return pool.encode_texts(texts)
        rest = pa.compute.if_else(whole, "", texts)
        ids, bounds = pool.encode_texts(rest)
        at = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        whole_texts = texts.take(pa.array(at)).to_pylist()
        own, own_counts = flat_ids([x.ids for x in tokenizer.encode_batch(whole_texts, add_special_tokens=False)])
        counts = np.diff(bounds)
        counts[at] = own_counts
        out = np.empty(int(counts.sum()), np.int32)
        after = np.concatenate([[0], np.cumsum(counts)])
        of_whole = np.zeros(len(out), bool)
        of_whole[ranges(after[at], counts[at])] = True
        out[~of_whole] = ids
        out[of_whole] = own
        return out, after

    return encode_texts
