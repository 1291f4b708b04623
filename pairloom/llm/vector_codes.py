"""Vector codes: a codebook for each part of a vector, by k-means with adaptive bounds.

Vectors are whole numbers, ``floor(SCALE * x)``. In each round every part is assigned to
the nearest entry of its codebook and entries move to the mean of their parts. What is
known of the distances is kept with each part over rounds: an upper bound for its own
entry, its ``b`` closest other entries with lower bounds in rising order, and one outer
bound for all the rest. When entries have moved, the upper bound grows by the move of
its entry, a lower one falls by that of its entry, the outer one by the largest move. Then

* a part whose upper bound is under the first lower bound stays where it is;
* else the upper bound is made exact, and compared again;
* else the entries whose lower bounds are not above it, or all where the outer bound
  is not, are compared in whole numbers, ties going to the lower index.

``b`` is as large as any part of a batch has needed, at least ``MIN_BOUNDS``. Bounds are
kept as whole steps of ``STEPS`` an octave, upper ones rounded up and lower ones down, so
that they take little room and only whole numbers decide in the end.

A round reads the table of parts and bounds that the round before has written to the
shared folder. Only codebooks and the sums of their parts reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.tables import as_arrow, join_weighted
from pairloom.session import materialise

SCALE = 256
PARTS = 16
ENTRIES = 64
ROUNDS = 2
FIRST_BOUNDS = 8  # an eighth of the entries
MIN_BOUNDS = 4
BATCH_ROWS = 1024
STEPS = 64  # of a bound in an octave
NO_BOUND = 32_000  # above any distance
LARGEST = 1 << 28  # components beyond it: their squares would not fit a sum
STATE = "x array<int>, codes array<smallint>, upper array<smallint>, near array<smallint>, lower array<smallint>, outer array<smallint>, compared bigint"
_ARRAYS = ("codes", "upper", "near", "lower", "outer")


def whole_vectors(rows: DataFrame, vector: str) -> DataFrame:
    """Rows of finite vectors; ``x`` is the vector in whole numbers."""
    too_large = F.raise_error(F.lit(f"a component is larger than {LARGEST // SCALE}"))

    def whole(v: Column) -> Column:
        small = F.abs(v) <= LARGEST // SCALE
        return F.when(small, F.floor(v.cast("double") * SCALE).cast("int")).otherwise(too_large)

    finite = F.forall(
        vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    )
    x = F.when(finite, F.transform(vector, whole))
    return rows.withColumn("x", x).where(F.col("x").isNotNull())


def _distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances, whole numbers, over the last axis."""
    d = x.astype(np.int64) - entries
    return (d * d).sum(-1)


def _down(x: np.ndarray) -> np.ndarray:
    """Steps of the largest bound that is surely not above ``x``."""
    steps = np.floor(STEPS * np.log2(np.maximum(x, 0) + 1) - 1e-6)
    return np.clip(steps, 0, NO_BOUND).astype(np.int16)


def _up(x: np.ndarray) -> np.ndarray:
    return np.clip(np.ceil(STEPS * np.log2(x + 1) + 1e-6), 0, NO_BOUND).astype(np.int16)


def _value(steps: np.ndarray) -> np.ndarray:
    """The distance of a number of steps."""
    return np.where(steps >= NO_BOUND, np.inf, np.exp2(np.minimum(steps, NO_BOUND) / STEPS) - 1)


def _ranked(d: np.ndarray, b: int) -> tuple[np.ndarray, ...]:
    """Of rows of distances to all entries: own entry, upper bound, the next ``b``, outer bound."""
    order = np.argsort(d, axis=-1, kind="stable")  # ties: the lower index first
    root = np.sqrt(np.take_along_axis(d, order, -1).astype(float))
    outer = _down(root[..., b + 1]) if d.shape[-1] > b + 1 else np.full(d.shape[:-1], NO_BOUND, np.int16)
    return order[..., 0], _up(root[..., 0]), order[..., 1 : b + 1], _down(root[..., 1 : b + 1]), outer


def first_state(x: np.ndarray, books: np.ndarray, b: int = FIRST_BOUNDS) -> dict[str, np.ndarray]:
    """Assign the parts ``x`` (rows, parts, size) by all distances, with ``b`` bounds.

    ``compared`` counts the distances to entries other than the own one.
    """
    n_entries = books.shape[1]
    found = _ranked(_distances(x[:, :, None, :], books[None]), min(b, n_entries - 1))
    return dict(zip(_ARRAYS, found)) | {"compared": np.full(len(x), x.shape[1] * (n_entries - 1))}


def next_state(x: np.ndarray, state: dict[str, np.ndarray], books: np.ndarray, moves: np.ndarray) -> dict[str, np.ndarray]:
    """Assign again after the entries have moved, using and renewing the bounds."""
    n, parts, _ = x.shape
    part = np.arange(parts)
    codes, near = state["codes"].astype(np.int64), state["near"].astype(np.int64)
    b = near.shape[-1]
    outer = _down(_value(state["outer"]) - moves.max(1))
    lower = _down(_value(state["lower"]) - moves[part[:, None], near])
    # in rising order: a bound holds for all entries behind it, too
    rising = np.concatenate([lower, outer[..., None]], -1)[..., ::-1]
    rising = np.minimum.accumulate(rising, -1)[..., ::-1]
    lower, bound = rising[..., :-1].copy(), rising[..., 0]
    upper = _up(_value(state["upper"]) + moves[part, codes])
    i, p = np.nonzero(upper >= bound)
    # the exact distance may settle it
    d = _distances(x[i, p], books[p, codes[i, p]])
    upper[i, p] = _up(np.sqrt(d.astype(float)))
    left = upper[i, p] >= bound[i, p]
    i, p = i[left], p[left]
    all_ = upper[i, p] >= outer[i, p]
    compared, needed = np.zeros(n, np.int64), MIN_BOUNDS
    np.add.at(compared, i[all_], books.shape[1] - 1)
    some_i, some_p = i[~all_], p[~all_]
    if len(some_i):
        i_, p_ = some_i, some_p
        within = (upper[i_, p_][:, None] >= lower[i_, p_]).sum(1)  # the first ones: bounds rise
        needed = max(needed, int(within.max()))
        np.add.at(compared, i_, within)
        tried = np.concatenate([codes[i_, p_][:, None], near[i_, p_]], 1)
        d = _distances(x[i_, p_][:, None, :], books[p_[:, None], tried])
        live = np.arange(b + 1) <= within[:, None]  # the others keep their order and bounds
        order = np.lexsort((np.where(live, tried, 0), np.where(live, d, np.arange(b + 1)), ~live), axis=1)
        tried = np.take_along_axis(tried, order, 1)
        root = np.sqrt(np.take_along_axis(d, order, 1).astype(float))
        bounds = np.where(live[:, 1:], _down(root[:, 1:]), lower[i_, p_])
        bounds = np.concatenate([bounds, outer[i_, p_][:, None]], 1)[:, ::-1]
        codes[i_, p_], upper[i_, p_], near[i_, p_] = tried[:, 0], _up(root[:, 0]), tried[:, 1:]
        lower[i_, p_] = np.minimum.accumulate(bounds, 1)[:, ::-1][:, :-1]
    if all_.any():
        i_, p_ = i[all_], p[all_]
        needed = b
        found = _ranked(_distances(x[i_, p_][:, None, :], books[p_]), b)
        codes[i_, p_], upper[i_, p_], near[i_, p_], lower[i_, p_], outer[i_, p_] = found
    if needed < b:  # shorter lists from now on; what falls off is above the outer bound
        outer = np.minimum(outer, lower[..., needed])
        near, lower = near[..., :needed], lower[..., :needed]
    return dict(zip(_ARRAYS, (codes, upper, near, lower, outer))) | {"compared": compared}


def _nested(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    flat = values.reshape(len(values), -1)
    offsets = pa.array(np.arange(len(flat) + 1) * flat.shape[1], pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(flat.reshape(-1), kind))


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _kept(rows: DataFrame) -> str:
    """Types of the columns that go with a vector from round to round: ``k0``, ``k1``, …"""
    return "".join(f"{c} {kind}, " for c, kind in rows.dtypes if c.startswith("k"))


def _batch(x: pa.Array, state: dict[str, np.ndarray], kept: list[pa.Array]) -> pa.RecordBatch:
    arrays = [_nested(state[c], pa.int16()) for c in _ARRAYS]
    columns = [*kept, x, *arrays, as_arrow(state["compared"], pa.int64())]
    names = [*(f"k{i}" for i in range(len(kept))), "x", *_ARRAYS, "compared"]
    return pa.RecordBatch.from_arrays(columns, names=names)


def begin(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """State of all parts of ``rows`` (``x`` and kept columns) after the first assignment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                *kept, x = (c.slice(at, BATCH_ROWS) for c in batch.columns)
                parts = _matrix(x).reshape(len(x), books.shape[0], -1)
                yield _batch(x, first_state(parts, books), kept)

    names = [c for c in rows.columns if c.startswith("k")]
    return rows.select(*names, "x").mapInArrow(run, _kept(rows) + STATE)


def advance(state: DataFrame, books: np.ndarray, moves: np.ndarray) -> DataFrame:
    """State after the next assignment, to moved codebooks."""
    n_kept = len(state.columns) - len(_ARRAYS) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(n_kept + 3).value_lengths().to_numpy()
            # lists have one length in a batch that was written, and may have another in the next
            cuts = sorted({0, len(lengths), *(np.flatnonzero(np.diff(lengths)) + 1), *range(0, len(lengths), BATCH_ROWS)})
            for low, high in zip(cuts, cuts[1:]):
                part = batch.slice(low, high - low)
                n, parts = part.num_rows, books.shape[0]
                known = {c: _matrix(part.column(n_kept + 1 + k)).reshape(n, parts, -1) for k, c in enumerate(_ARRAYS)}
                known |= {c: known[c][..., 0] for c in ("codes", "upper", "outer")}
                x = _matrix(part.column(n_kept)).reshape(n, parts, -1)
                yield _batch(part.column(n_kept), next_state(x, known, books, moves), part.columns[:n_kept])

    return state.mapInArrow(run, _kept(state) + STATE)


def moved_books(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """Each entry is the mean of its parts, rounded down; one without parts stays.

    Sums are made in batches; a row for each entry of each part reaches the driver.
    """
    parts, entries, size = books.shape
    schema = "at int, n bigint, sums array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _matrix(batch.column(1)).astype(np.int64)
            if not len(codes):
                continue
            x = _matrix(batch.column(0)).astype(np.int64).reshape(-1, size)
            at = (codes + np.arange(parts) * entries).reshape(-1)
            order = np.argsort(at, kind="stable")
            present, first = np.unique(at[order], return_index=True)
            sums = np.add.reduceat(x[order], first, axis=0)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(present, pa.int32()),
                    pa.array(np.diff(np.append(first, len(at))), pa.int64()),
                    _nested(sums, pa.int64()),
                ],
                names=["at", "n", "sums"],
            )

    summed = (
        state.select("x", "codes").mapInArrow(run, schema).groupBy("at")
        .agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(size)])
    )
    out = books.reshape(-1, size).copy()
    for row in summed.collect():
        out[row["at"]] = [row[f"s{k}"] // row["n"] for k in range(size)]
    return out.reshape(books.shape)


def compress(
    rows: DataFrame, order: str, rounds: int = ROUNDS, parts: int = PARTS, entries: int = ENTRIES
) -> tuple[DataFrame, np.ndarray]:
    """State of the parts of ``rows`` (``x`` and kept columns) and the codebooks (parts, entries, size).

    Codebooks start as the parts of the ``entries`` smallest rows by ``order``, and move
    ``rounds`` times; all parts are assigned once more at the end. There is a row at least.
    """
    first = rows.orderBy(F.col(order).asc_nulls_first(), "x").limit(entries).select("x").collect()
    books = np.array([r["x"] for r in first], np.int64)
    books = np.ascontiguousarray(books.reshape(len(books), parts, -1).transpose(1, 0, 2))
    state = begin(rows, books)
    for _ in range(rounds):
        state = materialise(state, "bounds")
        moved = moved_books(state, books)
        moves = np.sqrt(_distances(moved, books).astype(float)) * (1 + 1e-12)
        books, state = moved, advance(state, moved, moves)
    return state, books


def coded(state: DataFrame, books: np.ndarray) -> DataFrame:
    """Kept columns, ``code`` (two hex digits a part) and ``error`` (squared distance)."""
    n_kept = len(state.columns) - len(_ARRAYS) - 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = _matrix(batch.column(n_kept + 1)).astype(np.int64)
            if not len(codes):
                continue
            parts = np.arange(books.shape[0])
            x = _matrix(batch.column(n_kept)).reshape(len(codes), len(parts), -1)
            error = _distances(x, books[parts, codes]).sum(1)
            digits = [bytes(row).hex() for row in codes.astype(np.uint8)]
            columns = [*batch.columns[:n_kept], pa.array(digits), pa.array(error, pa.int64())]
            names = [*(f"k{i}" for i in range(n_kept)), "code", "error"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = state.columns[: n_kept + 2]
    return state.select(names).mapInArrow(run, _kept(state) + "code string, error bigint")


def books_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def digests(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, code, error, label_error, codebooks_sha256`` of every kept row.

    Rows whose vector is null, or holds a null or non-finite component, are dropped, and so
    are those whose vector has not the length of the one with the smallest id, or no
    multiple of ``PARTS``. A null id is the smallest; repeated rows are coded alike; fewer
    rows than entries give smaller codebooks; null labels are one label; an empty table
    gives no rows. A component of 2**20 or more ends the job: squares would not fit a sum.
    """
    named = vectors.select(F.col(vec_id).alias("k0"), F.col(label).alias("k1"), F.col(vector).alias("v"))
    rows = whole_vectors(named, "v").where((F.size("x") > 0) & (F.size("x") % PARTS == 0))
    rows = rows.select("k0", F.to_json(F.struct("k1")).alias("k1"), "x")
    first = rows.orderBy(F.col("k0").asc_nulls_first(), "x").select(F.size("x").alias("n")).first()
    if first is None:
        kind = dict(vectors.dtypes)[vec_id]
        schema = f"vec_id {kind}, code string, error bigint, label_error bigint, codebooks_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    state, books = compress(rows.where(F.size("x") == first["n"]), "k0")
    found = materialise(coded(state, books), "codes")
    sums = materialise(
        found.groupBy("k1").agg(F.sum("error").alias("label_error"), F.count(F.lit(1)).alias("n")),
        "label-errors",
    )
    return join_weighted(found, sums, ["k1"], "n").select(
        F.col("k0").alias("vec_id"), "code", "error", "label_error",
        F.lit(books_digest(books)).alias("codebooks_sha256"),
    )
