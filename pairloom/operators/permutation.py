"""A shuffle without a sort: each place of 0 .. n - 1 is computed from the row number alone.

A number is taken apart as ``x = right * a + left`` with ``a`` about the square root of
``n``. In turn each half is moved by a keyed function of the other one, which can be undone
(a Feistel network). The network permutes 0 .. a * b - 1, where ``a * b - n < a``; a number that
leaves 0 .. n - 1 goes through it again until it is back (cycle walking), so the whole is a
permutation of 0 .. n - 1. The same steps backwards give the row of a place.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


ROUNDS = 6
PRIME = (1 << 31) - 1  # products of two numbers below it fit 62 bits
WALKS = 64  # for n up to WALKS ** 2 a cycle cannot be longer; beyond, chances are under (1 / 64) ** 64


def round_keys(seed: int, epoch: int) -> list[tuple[int, int, int]]:
    """Two factors and a summand below ``PRIME`` for each round."""
    keys = []
    for i in range(ROUNDS):
        digest = hashlib.md5(f"{seed}:{epoch}:{i}".encode()).digest()
        parts = [int.from_bytes(digest[k : k + 4], "big") % (PRIME - 1) + 1 for k in (0, 4, 8)]
        keys.append(tuple(parts))
    return keys


def _moved_by(half: Column, key: Column) -> Column:
    mixed = (F.pmod(half, F.lit(PRIME)) * key["m1"] + key["k"]) % PRIME
    return mixed.bitwiseXOR(F.shiftright(mixed, 15)) * key["m2"] % PRIME


def _network(x: Column, n: Column, keys: list[tuple[int, int, int]], forwards: bool) -> Column:
    a = F.ceil(F.sqrt(n))
    b = F.call_function("div", n + a - 1, a)
    rounds = [
        F.struct(
            F.lit(i % 2 == 0).alias("left"),
            *[F.lit(v).cast("bigint").alias(c) for c, v in zip(("m1", "k", "m2"), key)],
        )
        for i, key in enumerate(keys)
    ]
    sign = 1 if forwards else -1

    def step(halves: Column, key: Column) -> Column:
        left, right = halves["l"], halves["r"]
        return F.when(
            key["left"], F.struct(F.pmod(left + sign * _moved_by(right, key), a).alias("l"), right.alias("r"))
        ).otherwise(F.struct(left.alias("l"), F.pmod(right + sign * _moved_by(left, key), b).alias("r")))

    start = F.struct((x % a).alias("l"), F.call_function("div", x, a).alias("r"))
    return F.aggregate(
        F.array(*(rounds if forwards else rounds[::-1])), start, step, lambda halves: halves["r"] * a + halves["l"]
    )


def _walked(x: Column, n: Column, seed: int, epoch: int, forwards: bool) -> Column:
    keys = round_keys(seed, epoch)
    x, n = x.cast("bigint"), n.cast("bigint")
    once = _network(x, n, keys, forwards)
    back = F.aggregate(
        F.sequence(F.lit(1), F.lit(WALKS)),
        once,
        lambda y, _: F.when(y < n, y).otherwise(_network(y, n, keys, forwards)),
    )
    lost = F.raise_error(F.lit("a number has not come back")).cast("bigint")
    return F.when(once < n, once).otherwise(F.when(back < n, back).otherwise(lost))


def place_of_row(row: Column, n: Column, seed: int, epoch: int) -> Column:
    """Place of row ``row`` of 0 .. n - 1 in the order of a seed and epoch."""
    return _walked(row, n, seed, epoch, True)


def row_of_place(place: Column, n: Column, seed: int, epoch: int) -> Column:
    """The row at a place: the inverse of ``place_of_row``."""
    return _walked(place, n, seed, epoch, False)
