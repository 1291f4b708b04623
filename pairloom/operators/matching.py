"""Matching of the tokens of two sides, for a whole record batch at once.

A batch holds two list columns. Tokens are numbered over both, and all counting
and pairing is sorting of integer arrays that carry the row along.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class Side:
    """The tokens of one list column: row, place in the row, and token number."""

    def __init__(self, lists: pa.Array, codes: np.ndarray):
        lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        self.row = np.repeat(np.arange(len(lists)), lengths)
        self.place = np.arange(len(self.row)) - np.repeat(starts, lengths)
        self.left = np.repeat(lengths, lengths) - self.place  # tokens from here to the end
        self.code = codes


def number_tokens(candidates: pa.Array, references: pa.Array) -> tuple[Side, Side]:
    """Both sides with equal numbers for equal tokens."""
    values = pa.concat_arrays([candidates.flatten(), references.flatten()])
    codes = values.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    cut = len(candidates.flatten())
    return Side(candidates, codes[:cut]), Side(references, codes[cut:])


def _extend(grams: list[np.ndarray], sides: tuple[Side, Side], n: int) -> list[np.ndarray]:
    """Numbers of the n-grams at each place from those of the (n-1)-grams; -1
    where the row ends before."""
    top = max((int(side.code.max(initial=0)) for side in sides), default=0) + 1
    pairs = []
    for gram, side in zip(grams, sides):
        following = np.roll(side.code, -(n - 1))
        pairs.append(np.where(side.left >= n, gram * top + following, -1))
    _, dense = np.unique(np.concatenate(pairs), return_inverse=True)
    cut = len(pairs[0])
    return [
        np.where(side.left >= n, part, -1)
        for part, side in zip((dense[:cut], dense[cut:]), sides)
    ]


def clipped_matches(candidates: pa.Array, references: pa.Array, orders: int) -> np.ndarray:
    """For each row and each n up to ``orders``: the candidate's n-grams found in
    the reference, each no more often than it occurs there."""
    sides = number_tokens(candidates, references)
    grams = [side.code for side in sides]
    out = np.zeros((len(candidates), orders), dtype=np.int64)
    for n in range(1, orders + 1):
        if n > 1:
            grams = _extend(grams, sides, n)
        width = max((int(gram.max(initial=0)) for gram in grams), default=0) + 1
        counted = [
            np.unique((side.row * width + gram)[gram >= 0], return_counts=True)
            for gram, side in zip(grams, sides)
        ]
        common, c_at, r_at = np.intersect1d(
            counted[0][0], counted[1][0], assume_unique=True, return_indices=True
        )
        matched = np.minimum(counted[0][1][c_at], counted[1][1][r_at])
        out[:, n - 1] = np.bincount(common // width, matched, len(candidates))
    return out


def _from_the_end(side: Side, open_: np.ndarray, width: int):
    """Open occurrences: key of (row, token), number from the end among equal
    keys, and place in the batch."""
    at = np.flatnonzero(open_)
    key = side.row[at] * width + side.code[at]
    order = np.lexsort((-side.place[at], key))
    at, key = at[order], key[order]
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
    nth = np.arange(len(key)) - np.repeat(starts, np.diff(np.r_[starts, len(key)]))
    return key, nth, at


def matches_and_chunks(stages: list[tuple[pa.Array, pa.Array]]) -> np.ndarray:
    """For each row the number of matched tokens and of chunks of them.

    In each stage, with its own form of the tokens, the k-th last unmatched
    occurrence of a token meets the k-th last of the other side. A chunk goes on
    while both places grow by one.
    """
    rows = len(stages[0][0])
    used: list[np.ndarray] = []
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for candidates, references in stages:
        sides = number_tokens(candidates, references)
        if not used:
            used = [np.zeros(len(side.row), dtype=bool) for side in sides]
        width = max((int(side.code.max(initial=0)) for side in sides), default=0) + 1
        keys = [_from_the_end(side, ~taken, width) for side, taken in zip(sides, used)]
        longest = max((int(nth.max(initial=0)) for _, nth, _ in keys), default=0) + 1
        _, c_at, r_at = np.intersect1d(
            keys[0][0] * longest + keys[0][1],
            keys[1][0] * longest + keys[1][1],
            assume_unique=True,
            return_indices=True,
        )
        c, r = keys[0][2][c_at], keys[1][2][r_at]
        used[0][c] = True
        used[1][r] = True
        pairs.append((c, r))
    c = np.concatenate([pair[0] for pair in pairs])
    r = np.concatenate([pair[1] for pair in pairs])
    order = np.argsort(c)
    c, r = c[order], r[order]
    row = sides[0].row[c]
    goes_on = np.zeros(len(c), dtype=bool)
    goes_on[1:] = (row[1:] == row[:-1]) & (np.diff(c) == 1) & (np.diff(r) == 1)
    return np.stack(
        [np.bincount(row, minlength=rows), np.bincount(row[~goes_on], minlength=rows)], axis=1
    )


def rows_of(values: np.ndarray) -> pa.Array:
    """A matrix as a list column."""
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel().astype(np.int64)))
