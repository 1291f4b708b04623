"""Near-duplicates by a chosen-path similarity join of shingle sets.

1. Texts with equal sets form a class; only the class, with its smallest document,
   goes on. A set has ``COORDINATES`` minwise tokens.
2. In each of ``TREES`` independent trees the root chooses one coordinate and sends
   a set to the child named by its token there. A node with more than ``NODE_SETS``
   sets chooses ``BRANCHES`` more coordinates, and so on. The sets of a small node
   are all compared by their tokens; those that may be alike are tied to a cluster.
   A pair of similarity s shares a node in one tree with a chance of about s, so all
   trees miss it with a chance of about ``(1 - s) ** TREES``.
3. Clusters are checked on full sets, each set moving once: pairs in the order of
   estimated similarity, passing over those already connected. A cluster of more than
   ``NODE_SETS`` sets is cut into blocks, and every pair of blocks is checked, so no
   task grows with the cluster; a cluster of many shingles is cut, too.
4. Links that hold give the components.

Nodes that are still large at ``MAX_DEPTH`` become one cluster each, so nothing is
lost there either.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.components import components
from pairloom.llm.spans import gram_hashes, mix, mix_int, words_of, worker_cache
from pairloom.llm.tables import free_name, map_texts
from pairloom.session import materialise

SHINGLE = 5
PERCENT = 85  # of the union that two sets must share
COORDINATES = 64
TREES = 10
BRANCHES = 2
NODE_SETS = 2048
UNIT_SHINGLES = 4 << 20  # of a block of a cluster, about
MAX_DEPTH = 6
#: Estimates below these are no candidates: five deviations under the threshold.
NODE_ESTIMATE = 0.62  # of COORDINATES tokens
CHECK_TOKENS = 128
CHECK_ESTIMATE = 0.69  # of CHECK_TOKENS tokens
NO_KEY = -(1 << 63)
SET_SCHEMA = "key bigint, n_shingles bigint, sum1 bigint, sum2 bigint, tokens array<int>"


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """``(shingles, bounds)``: the sorted distinct shingle hashes of each text."""
    words = words_of(texts)
    hashes = words.hashes(lower=True)
    at = words.gram_starts(SHINGLE)
    counts = np.diff(words.bounds)
    short = np.flatnonzero((counts > 0) & (counts < SHINGLE))
    doc = np.concatenate([words.doc[at], short])
    grams = np.concatenate(
        [gram_hashes(hashes, at, SHINGLE), *[gram_hashes(hashes, words.bounds[short[counts[short] == n]], n) for n in range(1, SHINGLE)]]
    )
    doc = np.concatenate([words.doc[at], *[short[counts[short] == n] for n in range(1, SHINGLE)]])
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    doc, grams = doc[new], grams[new]
    return grams, np.searchsorted(doc, np.arange(len(counts) + 1))


def minwise(shingles: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """``n`` minwise tokens (32 bits) of each set; of an empty set 0."""
    some = np.diff(bounds) > 0
    out = np.zeros((len(some), n), np.uint32)
    if some.any():
        firsts = bounds[:-1][some]
        for k in range(n):
            salted = (shingles ^ np.uint64(mix_int(k + 1))) * np.uint64(mix_int(k + 1001) | 1)
            salted ^= salted >> np.uint64(32)
            salted *= np.uint64(0xD6E8FEB86659FD93)
            out[some, k] = np.minimum.reduceat(salted, firsts) >> np.uint64(32)
    return out


def describe(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Size, fingerprint of the set (two sums) and minwise tokens of every row."""

    def run(texts, others):
        worker_cache(None)
        shingles, bounds = shingle_sets(texts)
        sums = []
        for salt in (1, 2):
            mixed = np.concatenate([[np.uint64(0)], np.cumsum(mix(shingles ^ np.uint64(mix_int(salt))))])
            sums.append((mixed[bounds[1:]] - mixed[bounds[:-1]]).view(np.int64))
        tokens = minwise(shingles, bounds, COORDINATES).view(np.int32)
        return {
            "key": others[0],
            "n_shingles": np.diff(bounds),
            "sum1": sums[0],
            "sum2": sums[1],
            "tokens": pa.ListArray.from_arrays(
                pa.array(np.arange(0, tokens.size + 1, COORDINATES), pa.int32()), pa.array(tokens.reshape(-1))
            ),
        }

    return map_texts(docs, [text, F.coalesce(F.col(key), F.lit(NO_KEY))], SET_SCHEMA, run)


def joined(rows: DataFrame, narrow: DataFrame) -> DataFrame:
    """Rows joined with a table that grows with them, in the same way at every size."""
    return rows.join(narrow.hint("merge"), "key")


def _chosen(node: Column, k: int) -> Column:
    """Coordinate that a node chooses for its branch ``k``."""
    return F.pmod(F.xxhash64(node, F.lit(k)), F.lit(COORDINATES)).cast("int")


def _child(node: Column, coordinate: Column, tokens: Column) -> Column:
    return F.xxhash64(node, coordinate, F.get(tokens, coordinate))


def alike(tokens: np.ndarray, least: float, rows: slice | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``(i, j, share)`` of pairs i < j that agree in at least ``least`` of their tokens."""
    n = len(tokens)
    step = max(1, (1 << 24) // max(1, tokens.size))
    for a in range(0, n, step):
        part = tokens[a : a + step]
        share = np.zeros((len(part), n - a), np.uint8)
        for k in range(tokens.shape[1]):
            share += part[:, k, None] == tokens[None, a:, k]
        i, j = np.nonzero(share >= least * tokens.shape[1])
        later = j > i
        yield i[later] + a, j[later] + a, share[i[later], j[later]] / tokens.shape[1]


class Forest:
    """Disjoint sets over 0 .. n - 1; the root is the smallest member."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def tie(self, i: int, j: int) -> None:
        i, j = sorted((self.root(i), self.root(j)))
        self.parent[j] = i

    def links(self, keys: np.ndarray) -> dict[str, list[int]]:
        """Each member that is no root, with its root."""
        pairs = [(keys[i], keys[self.root(i)]) for i in range(len(self.parent)) if self.root(i) != i]
        return {"a": [int(a) for a, _ in pairs], "b": [int(b) for _, b in pairs]}


def _table(links: dict[str, list[int]]) -> pa.Table:
    return pa.table({k: pa.array(v, pa.int64()) for k, v in links.items()})


def _in_node(rows: pa.Table) -> pa.Table:
    """Tie the sets of one small node whose tokens agree well enough."""
    rows = rows.sort_by("key")
    keys = rows["key"].to_numpy()
    tokens = rows["tokens"].combine_chunks().values.to_numpy().reshape(len(keys), COORDINATES)
    forest = Forest(len(keys))
    for i, j, _ in alike(tokens, NODE_ESTIMATE):
        for a, b in zip(i.tolist(), j.tolist()):
            forest.tie(a, b)
    return _table(forest.links(keys))


def candidate_links(sets: DataFrame, trees: int = TREES, node_sets: int = NODE_SETS) -> DataFrame:
    """Links ``a, b`` between sets (``key, tokens``) that share a node and may be alike."""
    root = F.xxhash64("tree")
    members = materialise(
        sets.select("key", "tokens", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree"))
        .select("key", _child(root, _chosen(root, 0), F.col("tokens")).alias("node")),
        "tree-nodes",
    )
    found = None
    for depth in range(1, MAX_DEPTH + 1):
        sizes = materialise(
            members.groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("low")).where("n > 1"),
            "node-sizes",
        )
        inside = members.join(sizes.hint("merge"), "node")
        small = joined(sets, inside.where(F.col("n") <= node_sets).select("node", "key"))
        links = small.select("node", "key", "tokens").groupBy("node").applyInArrow(_in_node, "a bigint, b bigint")
        large = inside.where(F.col("n") > node_sets)
        if depth == MAX_DEPTH:
            links = links.union(large.select(F.col("key").alias("a"), F.col("low").alias("b")).where("a <> b"))
        links = materialise(links.distinct(), "candidate-links")
        found = links if found is None else found.union(links)
        if depth == MAX_DEPTH or not sizes.where(F.col("n") > node_sets).limit(1).count():
            return found.distinct()
        node = F.col("node")
        members = materialise(
            joined(sets, large.select("node", "key"))
            .select("key", F.explode(F.array(*[_child(node, _chosen(node, k), F.col("tokens")) for k in range(1, BRANCHES + 1)])).alias("node"))
            .distinct(),
            "tree-nodes",
        )


def confirmed_links(sets: list[np.ndarray], left: np.ndarray, forest: Forest, exhaustive: bool) -> None:
    """Tie the sets that hold the threshold; ``left`` says of which block a set is.

    Pairs of two blocks or, in a unit of one block, all pairs are checked, the
    likeliest first; a pair that is connected already needs no check.
    """
    bounds = np.concatenate([[0], np.cumsum(list(map(len, sets)))])
    tokens = minwise(np.concatenate(sets), bounds, CHECK_TOKENS).astype(np.uint16)
    found = [np.concatenate(x) for x in zip(*alike(tokens, CHECK_ESTIMATE))]
    if not found:
        return
    i, j, share = found
    wanted = exhaustive | (left[i] != left[j])
    i, j, share = i[wanted], j[wanted], share[wanted]
    for k in np.argsort(-share, kind="stable").tolist():
        a, b = int(i[k]), int(j[k])
        if forest.root(a) != forest.root(b):
            common = len(np.intersect1d(sets[a], sets[b], True))
            if 100 * common >= PERCENT * (len(sets[a]) + len(sets[b]) - common):
                forest.tie(a, b)


def _in_unit(rows: pa.Table) -> pa.Table:
    rows = rows.sort_by("key")
    keys, blocks = rows["key"].to_numpy(), rows["block"].to_numpy()
    values = rows["shingles"].combine_chunks()
    sets = [np.asarray(values[i].values).view(np.uint64) for i in range(len(keys))]
    forest = Forest(len(keys))
    confirmed_links(sets, blocks, forest, bool((rows["i"].to_numpy() == rows["j"].to_numpy()).all()))
    return _table(forest.links(keys))


def check_links(
    docs: DataFrame, clusters: DataFrame, sizes: DataFrame, key: str, text: str, node_sets: int = NODE_SETS
) -> DataFrame:
    """Links ``a, b`` between sets of a cluster (``node, component``) that hold the threshold.

    ``sizes`` has the ``n_shingles`` of each set (``key``).
    """
    sized = clusters.join(sizes.select(F.col("key").alias("node"), "n_shingles").hint("merge"), "node")
    sizes = sized.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("total"))
    blocks = F.greatest(F.ceil(F.col("n") / node_sets), F.ceil(F.col("total") / UNIT_SHINGLES)).cast("int")
    placed = (
        clusters.join(sizes, "component")
        .select(
            F.col("node").alias("key"), "component", blocks.alias("blocks"),
            F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"),
        )
    )
    keyed = docs.select(F.coalesce(F.col(key), F.lit(NO_KEY)).alias("key"), F.col(text).alias("text"))
    rows = joined(keyed, placed)

    def make(texts, others):
        shingles, bounds = shingle_sets(texts)
        return dict(zip(("key", "component", "blocks", "block"), others)) | {
            "shingles": pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(shingles.view(np.int64)))
        }

    made = map_texts(
        rows, ["text", "key", "component", "blocks", "block"],
        "key bigint, component bigint, blocks int, block int, shingles array<bigint>", make,
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    units = made.select("*", other.alias("other")).select(
        "key", "component", "block", "shingles",
        F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
    )
    return units.groupBy("component", "i", "j").applyInArrow(_in_unit, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", trees: int = TREES, node_sets: int = NODE_SETS) -> DataFrame:
    """``key, n_shingles, component_id, kept`` of every row of ``docs``.

    Texts without words are linked with nothing. Rows with one key count as one
    document; null keys do so too, and are smaller than any other. Other columns
    are not read. Keys must not span all of 64 bits (both ends at once); an empty table
    gives no rows.
    """
    # null keys take the smallest number: make room for them
    low, high = docs.agg(F.min(key), F.max(key)).first()
    shift = 1 if low == NO_KEY else 0
    if shift and high == -NO_KEY - 1:
        raise ValueError("keys span all of 64 bits")
    docs = docs.select((F.col(key) + shift).alias("shifted"), F.col(text).alias("whole"))
    key, text = "shifted", "whole"
    described = materialise(describe(docs, key, text), "described")
    same = ["sum1", "sum2", "n_shingles"]
    classes = materialise(
        described.where("n_shingles > 0").groupBy(*same)
        .agg(F.min("key").alias("first"), F.min_by("tokens", "key").alias("tokens")),
        "classes",
    )
    sets = classes.select(F.col("first").alias("key"), "tokens", "n_shingles")
    clusters = components(candidate_links(sets.drop("n_shingles"), trees, node_sets))
    links = check_links(docs, clusters, sets, key, text, node_sets)
    # a key of several rows ties their classes
    rows = described.select("key", *same).join(
        classes.select(*same, "first").hint("merge"), same, "left"
    )
    ties = (
        rows.groupBy("key").agg(F.min("first").alias("b"), F.max("first").alias("c")).where("b <> c")
        .join(rows.select("key", F.col("first").alias("a")), "key").select("a", "b")
    )
    whole = components(links.union(ties).where("a is not null"))
    found = rows.join(whole.hint("merge"), F.col("first") == F.col("node"), "left").select(
        "key", "n_shingles", F.coalesce("component", "first", "key").alias("component")
    )
    real = lambda c: F.when(F.col(c) != NO_KEY, F.col(c) - shift)
    return found.select(
        real("key").alias("doc_id"), "n_shingles", real("component").alias("component_id"),
        (F.col("key") == F.col("component")).alias("kept"),
    )


def keep_one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, all columns unchanged."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias(name := free_name(docs, "gone")))
    return docs.join(
        gone.distinct().hint("merge"), docs["doc_id"].eqNullSafe(F.col(name)), "left_anti"
    )
