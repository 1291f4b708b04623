"""Following the logs of many runs, whose lines may come late.

The state of a run is its list of best validations, in order of steps with falling losses. A late
line that is better than those before it takes away the title of the ones after it that
are not better than it: they are taken back and given again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pairloom.sources import runlog

#: Runs share states, since each call for a state takes milliseconds, whatever it holds.
BUCKETS = 1 << 12
STATE = "runs array<string>, sizes array<bigint>, steps array<bigint>, losses array<double>"


def changes(lines: DataFrame, column: str = "line", buckets: int = BUCKETS) -> DataFrame:
    """``run, step, loss, is_best, change`` of a stream of ``run`` and log lines.

    ``change`` is 1 for a row and -1 for one that is taken back. Runs of one hash, of
    ``buckets``, share a state; a stream that goes on needs the number it began with.
    """
    log = runlog.parse(lines, column).where(F.col("split") == "val")
    kind = dict(log.dtypes)["run"]
    run = F.col("run")
    # pandas has no nulls among whole numbers: runs are texts there
    as_text = {"binary": F.hex(run), "timestamp": F.unix_micros(run).cast("string")}.get(kind, run.cast("string"))
    from_text = {"binary": F.unhex(run), "timestamp": F.timestamp_micros(run.cast("bigint"))}.get(kind, run.cast(kind))
    log = log.select(F.pmod(F.xxhash64(as_text), F.lit(buckets)).alias("bucket"), as_text.alias("run"), "step", "loss")

    def follow(_: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best: dict[str | None, list[tuple[int, float]]] = {}
        if state.exists:
            names, sizes, *entries = state.get
            held = zip(*entries)
            best = {name: list(islice(held, size)) for name, size in zip(names, sizes)}
        arrived: dict[str | None, list[tuple[int, float]]] = defaultdict(list)
        for part in parts:
            for name, *row in zip(part["run"].tolist(), part["step"].tolist(), part["loss"].tolist()):
                arrived[name].append(tuple(row))
        out: list[tuple] = []
        for name, rows in arrived.items():
            out += [(name, *change) for change in _corrected(best.setdefault(name, []), sorted(rows))]
        if any(is_best for _, _, _, is_best, _ in out):  # else all titles are as they were
            steps, losses = zip(*chain.from_iterable(best.values()))
            state.update((list(best), [len(x) for x in best.values()], list(steps), list(losses)))
        yield pd.DataFrame(out, columns=["run", "step", "loss", "is_best", "change"])

    changed = log.groupBy("bucket").applyInPandasWithState(
        follow, "run string, step bigint, loss double, is_best boolean, change bigint", STATE,
        "append", GroupStateTimeout.NoTimeout,
    )
    return changed.withColumn("run", from_text)


def _corrected(best: list[tuple[int, float]], rows: list[tuple[int, float]]) -> Iterator[tuple]:
    """``step, loss, is_best, change`` of new ``rows`` of a run; they go into its list of ``best``."""
    for row in rows:
        at = bisect_left(best, row)
        is_best = at == 0 or row[1] < best[at - 1][1]
        yield (*row, is_best, 1)
        if is_best:
            end = at
            while end < len(best) and best[end][1] >= row[1]:
                yield (*best[end], True, -1)
                yield (*best[end], False, 1)
                end += 1
            best[at:end] = [row]


def current(changed: DataFrame) -> DataFrame:
    """``run, step, loss, is_best`` after all changes so far."""
    rows = changed.groupBy("run", "step", "loss", "is_best").agg(F.sum("change").alias("n")).where("n > 0")
    return rows.select("run", "step", "loss", "is_best", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("_")).drop("_")
