"""Quality rules: a decision list learned from labelled statistics of texts.

Statistics of whole texts are counted in Arrow batches. On a bounded sample of
labelled documents, sequential covering learns rules for low quality: a rule grows
by the threshold condition with the highest information gain, is pruned on rows
held back, and is kept if it is precise on those; then its rows are covered and the
next rule is grown. The list becomes one ordered Spark CASE expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.samples import MAX_SAMPLE, one_of_each, sample_rows
from pairloom.llm.spans import byte_hashes, mix, segment_sums, words_of, worker_cache
from pairloom.llm.tables import free_name, map_texts

SYMBOLS = "#*$%&|<>"  # fixed value
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
OTHER_STATISTICS = ("n_lines", "n_upper", "n_digits", "n_marks", "n_distinct")
MAX_RULES = 12
MAX_CONDITIONS = 4
MIN_PRECISION = 0.8  # of a rule on the rows held back
THRESHOLDS = 64  # candidates for each ratio
SEED = 9


def _table(characters: str) -> np.ndarray:
    table = np.zeros(256, np.int32)
    table[list(characters.encode())] = 1
    return table


def text_statistics(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """Columns ``keep`` and counts of each whole text; a null text has no words."""
    tables = {
        "n_symbols": _table(SYMBOLS),
        "n_upper": _table("".join(map(chr, range(65, 91)))),
        "n_digits": _table("0123456789"),
        "n_marks": _table("!?"),
    }
    # counted columns keep their names for the caller, so his own are renamed meanwhile
    types = dict(docs.dtypes)
    kept = [(f"k{i}", types[c]) for i, c in enumerate(keep)]
    schema = ",".join(
        [f"{c} {kind}" for c, kind in kept]
        + [f"{c} bigint" for c in (*STATISTICS, *OTHER_STATISTICS)]
    )

    def run(texts, others):
        worker_cache(None)
        words = words_of(texts)
        buf, offsets, bounds = words.buf, words.offsets, words.bounds
        n_docs = len(offsets) - 1
        salt = mix(np.arange(1, n_docs + 1, dtype=np.uint64))
        solid = np.zeros(len(buf) + 1, np.int32)  # +1 where a word begins, -1 behind it
        solid[words.starts] += 1
        solid[words.ends] -= 1
        solid = np.cumsum(solid[:-1])
        found = {
            "n_words": np.diff(bounds),
            "word_chars": segment_sums(solid * ((buf & 0xC0) != 0x80), offsets),
        }
        for name, table in tables.items():
            found[name] = segment_sums(table[buf], offsets)
        hashes = words.hashes()
        at = words.gram_starts(3)
        covered = np.zeros(len(hashes) + 1, np.int32)
        if len(at):
            grams = hashes[at] + np.uint64(3) * mix(hashes[at + 1]) + np.uint64(5) * mix(mix(hashes[at + 2]))
            grams = mix(grams ^ salt[words.doc[at]])
            _, place, counts = np.unique(grams, return_inverse=True, return_counts=True)
            again = at[counts[place] > 1]
            np.add.at(covered, again, 1)
            np.add.at(covered, again + 3, -1)
        found["n_repeat_words"] = segment_sums((np.cumsum(covered)[:-1] > 0).astype(np.int64), bounds)
        _, first = np.unique(mix(hashes ^ salt[words.doc]), return_index=True)
        found["n_distinct"] = np.bincount(words.doc[first], minlength=n_docs)
        # lines of a text end at a line end or at the end of the text
        breaks = np.flatnonzero(buf == 10)
        begins = np.union1d(offsets[:-1], breaks + 1)
        begins = begins[begins < len(buf)]
        ends = np.append(begins[1:], len(buf))
        ends = ends - (buf[ends - 1] == 10) if len(buf) else ends
        has_word = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, begins)
        begins, ends = begins[has_word], ends[has_word]
        line_doc = np.searchsorted(offsets, begins, "right") - 1
        keys = mix(byte_hashes(buf, begins, ends) ^ salt[line_doc])
        _, first = np.unique(keys, return_index=True)
        found["n_lines"] = np.bincount(line_doc, minlength=n_docs)
        found["n_dup_lines"] = found["n_lines"] - np.bincount(line_doc[first], minlength=n_docs)
        return found | {name: column for (name, _), column in zip(kept, others)}

    counted = map_texts(docs, [text, *keep], schema, run)
    return counted.select(
        *[F.col(name).alias(c) for (name, _), c in zip(kept, keep)],
        *[F.col(c) for c in (*STATISTICS, *OTHER_STATISTICS) if c not in keep],
    )


def base_failed() -> Column:
    """The fixed rules, on the counted columns."""
    n = F.col("n_words")
    return (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)


#: Features of the rules: a count for each unit of another count.
RATIOS = {
    "words": ("n_words", None),
    "chars_per_word": ("word_chars", "n_words"),
    "symbols_per_word": ("n_symbols", "n_words"),
    "dup_lines_per_line": ("n_dup_lines", "n_lines"),
    "repeat_words_per_word": ("n_repeat_words", "n_words"),
    "upper_per_char": ("n_upper", "word_chars"),
    "digits_per_char": ("n_digits", "word_chars"),
    "marks_per_word": ("n_marks", "n_words"),
    "distinct_per_word": ("n_distinct", "n_words"),
    "words_per_line": ("n_words", "n_lines"),
}


@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool
    threshold: float

    def column(self) -> Column:
        over, under = RATIOS[self.feature]
        value = F.col(over).cast("double")
        if under:
            value = F.when(F.col(under) > 0, value / F.col(under)).otherwise(F.lit(0.0))
        return value >= self.threshold if self.at_least else value < self.threshold

    def holds(self, x: dict[str, np.ndarray]) -> np.ndarray:
        value = x[self.feature]
        return value >= self.threshold if self.at_least else value < self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.at_least else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def ratios(counts: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out = {}
    for name, (over, under) in RATIOS.items():
        value = counts[over].astype(float)
        out[name] = value if under is None else np.where(counts[under] > 0, value / np.maximum(counts[under], 1), 0.0)
    return out


def _covers(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    held = np.ones(n, bool)
    for condition in rule:
        held &= condition.holds(x)
    return held


def _grow(x, bad, live, candidates) -> Rule:
    """Add the condition with the highest gain of information until no good row is covered."""
    rule: list[Condition] = []
    held = live.copy()
    while len(rule) < MAX_CONDITIONS and (held & ~bad).any():
        p0, n0 = (held & bad).sum(), (held & ~bad).sum()
        best, best_gain = None, 1e-9
        for condition, holds in candidates:
            now = held & holds
            p = (now & bad).sum()
            if p:
                gain = p * (np.log2(p / now.sum()) - np.log2(p0 / (p0 + n0)))
                if gain > best_gain:
                    best, best_gain = (condition, holds), gain
        if best is None:
            break
        rule.append(best[0])
        held &= best[1]
    return tuple(rule)


def learn_rules(counts: dict[str, np.ndarray], bad: np.ndarray) -> list[Rule]:
    """Decision list for ``bad`` rows; each third row is held back for pruning."""
    n = len(bad)
    x = ratios(counts)
    back = np.arange(n) % 3 == 0
    candidates = [
        (c := Condition(name, at_least, float(t)), c.holds(x))
        for name, value in x.items()
        for t in np.unique(np.quantile(value, np.linspace(0, 1, THRESHOLDS)))
        for at_least in (True, False)
    ] if n else []
    rules: list[Rule] = []
    left = np.ones(n, bool)
    while len(rules) < MAX_RULES and (left & bad & ~back).any():
        rule = _grow(x, bad, left & ~back, candidates)

        def value(r: Rule) -> tuple[float, int]:
            held = _covers(r, x, n) & left & back
            p, m = (held & bad).sum(), held.sum()
            return (2 * p - m) / max(m, 1), -len(r)

        if rule:
            rule = max((rule[:k] for k in range(1, len(rule) + 1)), key=value)
        held = _covers(rule, x, n) & left
        p, m = (held & back & bad).sum(), (held & back).sum()
        if not rule or p < 3 or p < MIN_PRECISION * m:
            break
        rules.append(rule)
        left &= ~held
    return rules


def verdict(rules: list[Rule]) -> Column:
    """True for rows that no rule rejects: an ordered conditional expression."""
    out = F
    for rule in rules:
        held = rule[0].column()
        for condition in rule[1:]:
            held = held & condition.column()
        out = out.when(held, F.lit(False))
    return F.lit(True) if out is F else out.otherwise(F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, limit: int = MAX_SAMPLE) -> list[Rule]:
    """Learn from at most ``limit`` labelled documents that pass the fixed rules."""
    chosen = (
        sample_rows(labels.where("doc_id is not null and quality is not null").select("doc_id", "quality"), "doc_id", SEED, limit)
        .dropDuplicates(["doc_id"])
    )
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("digest")).join(F.broadcast(chosen), "doc_id")
    counted = text_statistics(rows, ["doc_id", "quality", "digest"]).where(~base_failed())
    sample = one_of_each(counted, "doc_id", "digest").toPandas().sort_values(["doc_id", "n_words", "n_symbols"])
    counts = {c: sample[c].to_numpy() for c in (*STATISTICS, *OTHER_STATISTICS)}
    return learn_rules(counts, sample["quality"].to_numpy() == 0)


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every document.

    Null and empty texts have no words and fail; repeated rows are judged alike;
    without labels only the fixed rules reject.
    """
    rules = fit(docs, labels)
    counted = text_statistics(docs, ["doc_id"])
    return counted.select(
        "doc_id",
        *STATISTICS,
        base_failed().alias("base_failed"),
        (~base_failed() & verdict(rules)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that ``judge`` keeps, all columns unchanged."""
    rules = fit(docs, labels)
    columns = docs.columns
    hidden = {c: free_name(docs, f"in_{i}") for i, c in enumerate(columns)}
    renamed = docs.select(*[F.col(c).alias(hidden[c]) for c in columns])
    counted = text_statistics(renamed, list(hidden.values()), hidden["text"])
    return counted.where(~base_failed() & verdict(rules)).select(
        *[F.col(hidden[c]).alias(c) for c in columns]
    )
