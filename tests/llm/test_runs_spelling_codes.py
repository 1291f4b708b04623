"""Line runs, spelling variants and vector codes against brute force."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairloom.llm import line_runs, spelling, vector_codes

SCHEMA = "doc_id bigint, text string, h1 string, line int, word string"  # names the operators use
RNG = np.random.default_rng(11)


def table_of(spark, rows):
    return spark.createDataFrame([(k, t, "x", 1, "y") for k, t in rows], SCHEMA).repartition(3)


# line runs


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))


def plain_lines(rows):
    """Result of each distinct row; rows of one key are one document."""
    holders = collections.defaultdict(set)
    for k, t in rows:
        for line in (t or "").split("\n"):
            if len(key_of(line)) >= line_runs.MIN_CHARS:
                holders[key_of(line)].add(k)
    found = {}
    for k, t in rows:
        lines = (t or "").split("\n")
        last = [max((x for x in holders[key_of(x)] if x is not None), default=None) if len(key_of(x)) >= line_runs.MIN_CHARS else None for x in lines]
        gone = [len(key_of(x)) >= line_runs.MIN_CHARS and len(holders[key_of(x)]) >= line_runs.MIN_DOCS and k != m for x, m in zip(lines, last)]
        found[k, t] = (len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g))
    return found


def line_rows():
    shared = [f"Shared line {i} with É and enough characters in it" for i in range(6)]
    short = "a line under forty characters, it stays"
    exact = "x" * 39 + "é"  # forty characters, one of two bytes
    rows = [(None, None), (1, ""), (2, "\n"), (3, " \r\n\t\n"), (None, short), (None, shared[0] + "\n" + shared[1])]
    for i in range(40):
        some = [shared[j] if RNG.random() < 0.5 else f"own line {i} {j} that nobody else has, surely" for j in range(6)]
        some[0] = f"\t{some[0].upper() if i % 2 and some[0].isascii() else some[0]} \x0b"
        rows.append((10 + i, "\n".join([*some, short, exact if i % 4 == 0 else "", some[1]])))
    rows += [rows[8], rows[9], (20, shared[2] + "\r\n" + shared[2]), (None, shared[3])]  # repeated rows and keys
    rows.append((-(1 << 63), shared[4] + "\n" + shared[5]))
    return rows


@pytest.mark.parametrize("parts, batches, fan_out", [(1, 1, 2), (5, 6, 2), (3, 4, 3)])
def test_lines_are_those_of_brute_force(spark, shuffle_partitions, parts, batches, fan_out):
    shuffle_partitions(parts)
    rows = line_rows()
    found = line_runs.remove_lines(table_of(spark, rows), ["doc_id", "text", "h1"], batches=batches, fan_out=fan_out)
    plain = plain_lines(rows)
    assert any(n for _, n, _ in plain.values())
    got = [((r["doc_id"], r["text"]), (r["n_lines"], r["n_dropped"], r["kept_text"])) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(((row, plain[row]) for row in rows), key=repr)


def test_hot_lines_and_long_texts(spark):
    """Half of the lines are one line; a text is longer than a slice."""
    hot = "the line that every document of the table has at its top"
    cold = [f"line {i} stands in five documents of this table, no more" for i in range(3000)]
    rows = [(i, hot + "\n" + "\n".join(cold[i // 5 * 30 : i // 5 * 30 + 30])) for i in range(500)]
    rows.append((1000, "\n".join([hot] + [f"a filling line of the long text, number {i}" for i in range(40_000)])))
    assert len(rows[-1][1]) > 1 << 20
    found = {r["doc_id"]: r for r in line_runs.digests(table_of(spark, rows)).collect()}
    for (k, t), (n, gone, kept) in plain_lines(rows).items():
        digest = hashlib.sha256(kept.encode()).hexdigest()
        assert tuple(found[k]) == (k, n, gone, digest)


def test_no_lines(spark):
    empty = table_of(spark, [(1, "x")]).where("false")
    assert line_runs.digests(empty).count() == 0


def test_runs_tell_seen_lines(spark):
    """A batch that comes later knows the lines of the runs, also after a compaction."""
    runs = line_runs.LineRuns(spark, fan_out=2)
    batches = [[(1, 7), (2, 7)], [(2, 5), (3, 5), (3, 4)], [(1, 3), (3, 3), (4, 3)]]
    seen = []
    for rows in batches:
        df = spark.createDataFrame([(h, h, k) for h, k in rows], "h1 bigint, h2 bigint, key bigint")
        seen.append({r["h1"]: (r["seen"], r["n"], r["last"]) for r in runs.add(df).collect()})
    assert seen[1] == {2: (True, 1, 5), 3: (False, 2, 5)}
    assert seen[2] == {1: (True, 1, 3), 3: (True, 1, 3), 4: (False, 1, 3)}
    assert {r["h1"]: (r["n"], r["last"]) for r in runs.frequent(3).collect()} == {3: (3, 5)}


# spelling variants


def is_near(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [x for x in counts if is_near(w, x)] for w in counts}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= spelling.RATIO * counts[w] else None
    found = {}
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        found[w] = (form[w], root, counts[w], len(near[w]), counts.get(form[w]))
    return found


def results(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def crowded_words(n):
    """Words of few letters, so that many are near and blocks are large."""
    words = {"".join(RNG.choice(list("abé"), RNG.integers(7, 10))) for _ in range(n)}
    words |= {"a" * 7, "a" * 8, "a" * 9, "a" * 40, "a" * 41, "b" + "a" * 40, "ab" * 600, "ab" * 600 + "a"}
    return {w: int(10 ** RNG.integers(0, 7) + RNG.integers(1, 3)) for w in sorted(words)}


@pytest.mark.parametrize("block_words, parts", [(1024, 1), (4, 3), (30, 2)])
def test_variants_are_those_of_brute_force(spark, shuffle_partitions, block_words, parts):
    shuffle_partitions(parts)
    counts = crowded_words(400)
    df = spark.createDataFrame([(w, n, 1, "z") for w, n in counts.items()], "word string, n bigint, s int, block string")
    assert results(spelling.variants(df, block_words=block_words)) == plain_variants(counts)


def test_groups_of_many_words(monkeypatch):
    words = sorted({"".join(RNG.choice(list("abc"), 8)) for _ in range(150)} | {"".join(RNG.choice(list("abc"), 9)) for _ in range(150)})
    i, j = spelling.near_pairs(words, 8)
    got = sorted((words[a], words[b]) for a, b in zip(i.tolist(), j.tolist()))
    assert got == sorted((a, b) for a in words for b in words if len(a) == 8 and is_near(a, b) and len(b) >= 8)


def plain_vocabulary(rows):
    counts = collections.Counter()
    for k, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def test_vocabulary_and_variants_of_texts(spark):
    stems = ["Language", "maßgeblich", "ÀÉîõÿ×÷", "streaming", "weitergehend", "abcdefg"]
    rows = [(None, None), (0, ""), (0, "Language language"), (None, "streaming streaming7streaming"), (5, "x" * 300 + " " + "x" * 300)]
    rows += [(i, " ".join(str(RNG.choice(stems)) + str(RNG.choice(["", ".", "1", "日本"])) for _ in range(200))) for i in range(60)]
    rows += [rows[-1], rows[-1], (99, "longest " * 150_000)]
    counts = plain_vocabulary(rows)
    assert len(rows[-1][1]) > 1 << 20 and len(counts) > 8
    vocabulary = spelling.vocabulary(table_of(spark, rows))
    assert {r["word"]: r["n"] for r in vocabulary.collect()} == counts
    assert results(spelling.variants(vocabulary)) == plain_variants(counts)
    assert spelling.variants(spelling.vocabulary(table_of(spark, rows).where("false"))).count() == 0


# vector codes


def plain_codes(vectors, rounds=2, entries=64, parts=16):
    """Plain k-means on whole numbers; ``vectors`` are (id, values) in order of ids."""
    x = np.array([[int(np.floor(256 * np.float64(np.float32(v)))) for v in values] for _, values in vectors])
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        return d.argmin(-1), d.min(-1)

    for _ in range(rounds):
        codes, _ = assign()
        for p in range(parts):
            for e in range(books.shape[1]):
                own = x[codes[:, p] == e, p]
                if len(own):
                    books[p, e] = own.sum(0) // len(own)
    codes, d = assign()
    return codes, d.sum(1), books


@pytest.mark.parametrize("n, size, spread", [(300, 64, 0.2), (500, 32, 0.004), (40, 16, 1.0), (3, 64, 1.0)])
def test_codes_are_those_of_plain_means(spark, n, size, spread):
    """Small spreads have many ties; fewer vectors than entries; nulls and rows that go."""
    good = [(i, [float(v) for v in RNG.normal(0, spread, size)]) for i in range(n)]
    if n > 40:
        good[70] = (70, good[3][1])
    rows = [(i * 2, v, i % 3 if i % 5 else None, "x") for i, v in good]
    bad = [(1, None, 1, "x"), (3, good[0][1][:-1] + [None], 1, "x"), (5, [float("nan")] * size, 1, "x"), (7, good[0][1][:-1] + [float("-inf")], 1, "x"), (9, [], 1, "x"), (2 * n + 1, [0.5] * 48, 1, "x")]
    bad += [(11, [1.0] * (size + 1), 2, "x")]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>, label int, k0 string").repartition(3)
    codes, error, books = plain_codes(good)
    of_label = collections.Counter()
    for (_, _, label, _), e in zip(rows, error.tolist()):
        of_label[label] += e
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    found = sorted(map(tuple, vector_codes.digests(df).collect()))
    assert found == [
        (k, bytes(c).hex(), e, of_label[label], digest)
        for (k, _, label, _), c, e in zip(rows, codes.astype(np.uint8), error.tolist())
    ]
    assert vector_codes.digests(df.where("false")).count() == 0


def test_repeated_and_null_ids(spark):
    values = [[float(v) for v in RNG.normal(0, 1, 16)] for _ in range(4)]
    rows = [(None, values[0], 1), (None, values[1], 1), (1, values[2], 1), (1, values[2], 1), (2, values[3], None)]
    found = vector_codes.digests(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect()
    assert collections.Counter(r["vec_id"] for r in found) == {None: 2, 1: 2, 2: 1}
    assert len({r["code"] for r in found if r["vec_id"] == 1}) == 1 and {r["error"] for r in found} == {0}


@pytest.mark.parametrize("bounds", [1, 3, 8, 63])
def test_bounds_never_change_an_assignment(bounds):
    """Many rounds of moves, small and large; the bounds save comparisons."""
    x = RNG.integers(-60, 60, (400, 4, 4))
    books = np.ascontiguousarray(x[:64].transpose(1, 0, 2))
    state = vector_codes.first_state(x, books, bounds)
    compared = 0
    for move in (1, 0, 2, 30, 1, 1):
        moved = books + RNG.integers(-move, move + 1, books.shape)
        moves = np.sqrt(((moved - books) ** 2).sum(-1).astype(float))
        books, state = moved, vector_codes.next_state(x, state, moved, moves)
        d = ((x[:, :, None, :] - books[None]) ** 2).sum(-1)
        assert (state["codes"] == d.argmin(-1)).all()
        at = np.take_along_axis(d, state["near"].astype(np.int64), -1)
        assert (vector_codes._value(state["lower"]) ** 2 <= at * (1 + 1e-9)).all()
        compared += state["compared"].sum()
    assert compared < 6 * x.shape[0] * 4 * 63
