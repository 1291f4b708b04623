"""Words and chunks of whole texts in Arrow batches, as arrays of byte offsets.

A word is a run of bytes other than space and ``\\t`` to ``\\r``; no byte of a
longer UTF-8 sequence is one of these. All texts of a batch lie in one buffer, so
that splitting and hashing are a few passes of numpy over it. Batches are cut
into slices of whole texts, which bounds the memory of those passes.
"""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute

SLICE_BYTES = 1 << 20  # of text at once; a longer text is a slice of its own
_BASE = 0x9E3779B97F4A7C15
_STEP = 0xD6E8FEB86659FD95
_LONG = 512
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_ALNUM, _MARK = 1, 2  # of ASCII; a mark is neither letter nor digit, white space or control
_KIND = np.zeros(256, np.uint8)
_KIND[33:127] = _MARK
_KIND[[*range(48, 58), *range(65, 91), *range(97, 123)]] = _ALNUM


def worker_cache(name: str | None, make: Callable = dict):
    """A value kept in the Python process over tasks; functions sent by value have no module.

    Only the last one is kept, so that a worker does not hold what the jobs before
    needed; ``None`` lets go of it.
    """
    kept = sys.modules.setdefault("_worker_cache", types.ModuleType("_worker_cache"))
    if getattr(kept, "name", None) != name:
        kept.name, kept.value = None, None
        kept.value = make() if name is not None else None
        kept.name = name
        pa.default_memory_pool().release_unused()
    return getattr(kept, "value", None)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit numbers (a bijection)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], np.uint64))[0])


def span_array(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.LargeBinaryArray:
    """The bytes of spans (rising, apart, none empty), one after the other."""
    sizes = ends - starts
    if len(starts) and (ends[:-1] != starts[1:]).any():
        edges = np.zeros(len(buf) + 1, np.int8)
        edges[starts] += 1
        edges[ends] -= 1
        data = buf.compress(np.cumsum(edges[:-1], dtype=np.int8).view(bool))
    else:
        data = buf[starts[0] : ends[-1]] if len(starts) else buf[:0]
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]
    return pa.Array.from_buffers(pa.large_binary(), len(sizes), buffers)


def distinct_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """``(code of each span, bytes of each code)``, told apart by their bytes."""
    if not len(starts):
        return np.zeros(0, np.int64), pa.array([], pa.large_binary())
    coded = span_array(buf, starts, ends).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def byte_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of the bytes of each span, eight bytes a step, each mixed into the last.

    Spans of more than ``_LONG`` bytes are hashed one by one (XXH3).
    """
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    lanes = np.ndarray(len(buf) + 1, "<u8", padded, strides=(1,))  # eight bytes from each place on
    size = ends - starts
    out = mix(size.astype(np.uint64) + np.uint64(_STEP))
    at = np.flatnonzero((size > 0) & (size <= _LONG))
    done = 0
    while len(at):
        left = size[at] - done
        bits = np.minimum(left, 8).astype(np.uint64) << np.uint64(3)
        lane = lanes[starts[at] + done] & (np.uint64(2**64 - 1) >> (np.uint64(64) - bits))
        out[at] = mix((out[at] ^ lane) * np.uint64(_BASE) + np.uint64(_STEP))
        at, done = at[left > 8], done + 8
    long = np.flatnonzero(size > _LONG)
    if len(long):
        from xxhash import xxh3_64_intdigest

        view = memoryview(np.ascontiguousarray(buf))
        for i, low, high in zip(long.tolist(), starts[long].tolist(), ends[long].tolist()):
            out[i] = xxh3_64_intdigest(view[low:high])
    return out


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hash of two hashes in their order; every bit of both is mixed before they meet."""
    return mix(left * np.uint64(_BASE) + mix(right + np.uint64(_STEP)))


def gram_hashes(hashes: np.ndarray, starts, n: int) -> np.ndarray:
    """Hash of the ``n`` hashes from each start on, put together from powers of two."""
    size = len(hashes) - n + 1
    out, level, width, done = None, hashes, 1, 0
    while size > 0:
        if n & width:
            part = level[done : done + size]
            out = part if out is None else _joined(out, part)
            done += width
        if done == n:
            return out[starts]
        level, width = _joined(level[:-width], level[width:]), 2 * width
    return np.zeros(0, np.uint64)


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, texts)`` of consecutive slices of at most ``limit`` bytes or one text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if not n:
        return
    ends = np.cumsum(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < n:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield at, texts.slice(at, to - at)
        at = to


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offset of each (one more than texts); null is empty."""
    texts = pa.compute.fill_null(texts, "").cast(pa.large_string())
    texts = pa.concat_arrays([texts])  # without the offset of a slice
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    buf = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return buf[at[0] : at[-1]], at - at[0]


def solid_places(buf: np.ndarray) -> np.ndarray:
    """Places of the bytes that are no white space."""
    return np.flatnonzero(~SPACE[buf])


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return np.where((buf >= 65) & (buf <= 90), buf + np.uint8(32), buf)


@dataclass
class Words:
    """Words of a slice; ``bounds[d]`` is the first word of text ``d``."""

    buf: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    bounds: np.ndarray
    offsets: np.ndarray

    def hashes(self, lower: bool = False) -> np.ndarray:
        return byte_hashes(lower_ascii(self.buf) if lower else self.buf, self.starts, self.ends)

    def of_texts(self, low: int, high: int) -> Words:
        """The words of texts ``low`` to ``high``, which is not included."""
        a, b = self.bounds[low], self.bounds[high]
        return Words(
            self.buf, self.starts[a:b], self.ends[a:b], self.doc[a:b] - low,
            self.bounds[low : high + 1] - a, self.offsets[low : high + 1],
        )

    def gram_starts(self, n: int) -> np.ndarray:
        """Words with which ``n`` words of one text begin."""
        at = np.arange(max(0, len(self.starts) - n + 1))
        return at[self.doc[at] == self.doc[at + n - 1]] if len(at) else at


def runs_of(solid: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``(starts, ends)`` of the maximal runs of set flags, each within one text."""
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = solid[firsts]
    finishes = solid.copy()
    finishes[:-1] &= ~solid[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    finishes[lasts] = solid[lasts]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


def words_of(texts: pa.Array) -> Words:
    buf, offsets = text_bytes(texts)
    starts, ends = runs_of(~SPACE[buf], offsets)
    bounds = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(buf, starts, ends, doc, bounds, offsets)


def chunk_starts(
    buf: np.ndarray, offsets: np.ndarray, breaks: bytes | None = None, at_marks: bool = False
) -> np.ndarray:
    """Starts of chunks: white space (or ``breaks``), if any, and what follows, within a text.

    ``at_marks`` begins one at an ASCII mark behind an ASCII letter or digit, too.
    """
    table = SPACE
    if breaks is not None:
        table = np.zeros(256, bool)
        table[list(breaks)] = True
    space = table[buf]
    begins = space.copy()
    begins[1:] &= ~space[:-1]
    if at_marks:
        kind = _KIND[buf]
        begins[1:] |= (kind[1:] == _MARK) & (kind[:-1] == _ALNUM)
    begins[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    return np.flatnonzero(begins)


def segment_any(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each segment whether one of its flags is set."""
    sums = np.concatenate([[0], np.cumsum(flags)])
    return sums[bounds[1:]] > sums[bounds[:-1]]


def segment_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers ``start, start + 1, …`` of each range, one range after the other."""
    counts = np.asarray(counts, np.int64)
    total = int(counts.sum())
    shift = np.asarray(starts, np.int64) - (np.cumsum(counts) - counts)
    return np.repeat(shift, counts) + np.arange(total)
