"""Options of the jobs. Nothing is left out unless a caller sets a limit; the usual
limits are 10**7 pairs, and 1024 (nested) or 512 (aligned) tokens."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Ingest:
    """Corpus to shards."""

    shard_size: int = 10**8  # source and target tokens of a shard
    max_pairs: int | None = None  # of each language pair
    max_seq_len: int | None = None


@dataclass(frozen=True)
class AlignedIngest(Ingest):
    """Line-aligned files to shards."""

    batch_size: int = 1000  # input lines between two looks at the shard size
    fine_tune: bool = False  # marker last and truncation, instead of marker first


@dataclass(frozen=True)
class Loader:
    """Shards to batches."""

    batch_size: int = 64
    max_seq_len: int | None = None  # tokens of a side that are kept
    pad_id: int = 0
    tokens_per_step: int = 524_288
    world_size: int = 1
    shuffle: bool = True
    seed: int = 0
    step_seq_len: int = 256  # tokens a sequence counts for in a step, without a limit
