"""The stem algorithm of ``functions.stems`` as SQL, written from the published rules.

Each step is a sub-query that adds a column; ``k`` has ``v`` or ``c`` for each letter of
the word so far, so that the kinds of a stem are a prefix of it.
"""

from __future__ import annotations

from pairloom.functions.stems import STEP_2, STEP_3, STEP_4


def _kinds(word: str) -> str:
    """Vowels and consonants; a y is what the letter before it is not."""
    x = f"regexp_replace(regexp_replace({word}, '[^aeiouy]', 'c', 'g'), '[aeiou]', 'v', 'g')"
    x = f"regexp_replace({x}, '^y', 'c')"
    for _ in range(4):  # each pass settles one y of a run at least
        x = f"replace(replace({x}, 'vy', 'vc'), 'cy', 'cv')"
    return x


def _measure(kinds: str) -> str:
    return f"((length({kinds}) - length(replace({kinds}, 'vc', ''))) // 2)"


def _kinds_left(n: int) -> str:
    """Kinds of the word without its last ``n`` letters."""
    return f"substr(k, 1, length(k) - {n})"


def _word_left(n: int) -> str:
    return f"substr(w, 1, length(w) - {n})"


def _double(word: str, kinds: str) -> str:
    return f"(length({word}) > 1 AND substr({word}, -1) = substr({word}, -2, 1) AND {kinds} LIKE '%c')"


def _short(word: str, kinds: str) -> str:
    return f"({kinds} LIKE '%cvc' AND substr({word}, -1) NOT IN ('w', 'x', 'y'))"


def _rules(rules: dict[str, str], least: int, more: dict[str, str] | None = None) -> str:
    """The longest ending that fits is replaced if the measure before it is above ``least``."""
    cases = []
    for ending in sorted(rules, key=len, reverse=True):
        n = len(ending)
        holds = f"{_measure(_kinds_left(n))} > {least}" + (more or {}).get(ending, "")
        cases.append(f"WHEN w LIKE '%{ending}' THEN CASE WHEN {holds} THEN {_word_left(n)} || '{rules[ending]}' ELSE w END")
    return f"CASE {' '.join(cases)} ELSE w END"


def stems(tokens: str) -> str:
    """Query of ``token, stem`` for the column ``token`` of a table."""

    def step(query: str, expression: str) -> str:
        return f"SELECT token, {expression} AS w FROM (SELECT token, w, {_kinds('w')} AS k FROM ({query}))"

    query = f"SELECT token, token AS w FROM {tokens} WHERE regexp_full_match(token, '[a-z]{{3,}}')"
    query = step(query, f"""CASE WHEN w LIKE '%sses' OR w LIKE '%ies' THEN {_word_left(2)} WHEN w LIKE '%ss' THEN w
        WHEN w LIKE '%s' THEN {_word_left(1)} ELSE w END""")
    # the ending goes first; what it leaves is mended in a step of its own
    cut = f"""SELECT token, w, CASE WHEN w LIKE '%eed' THEN NULL
            WHEN w LIKE '%ed' AND {_kinds_left(2)} LIKE '%v%' THEN {_word_left(2)}
            WHEN w LIKE '%ing' AND {_kinds_left(3)} LIKE '%v%' THEN {_word_left(3)} END AS s, k
        FROM (SELECT token, w, {_kinds('w')} AS k FROM ({query}))"""
    query = f"""SELECT token, CASE
            WHEN w LIKE '%eed' THEN CASE WHEN {_measure(_kinds_left(3))} > 0 THEN {_word_left(1)} ELSE w END
            WHEN s IS NULL THEN w
            WHEN s LIKE '%at' OR s LIKE '%bl' OR s LIKE '%iz' THEN s || 'e'
            WHEN {_double('s', 'sk')} AND substr(s, -1) NOT IN ('l', 's', 'z') THEN substr(s, 1, length(s) - 1)
            WHEN {_measure('sk')} = 1 AND {_short('s', 'sk')} THEN s || 'e' ELSE s END AS w
        FROM (SELECT *, substr(k, 1, length(s)) AS sk FROM ({cut}))"""
    query = step(query, f"CASE WHEN w LIKE '%y' AND {_kinds_left(1)} LIKE '%v%' THEN {_word_left(1)} || 'i' ELSE w END")
    query = step(query, _rules(STEP_2, 0))
    query = step(query, _rules(STEP_3, 0))
    ion = f" AND substr({_word_left(3)}, -1) IN ('s', 't')"
    query = step(query, _rules(dict.fromkeys(STEP_4, ""), 1, {"ion": ion}))
    stem, kinds = _word_left(1), _kinds_left(1)
    query = step(query, f"""CASE WHEN w LIKE '%e' AND ({_measure(kinds)} > 1
        OR ({_measure(kinds)} = 1 AND NOT {_short(stem, kinds)})) THEN {stem} ELSE w END""")
    query = step(query, f"CASE WHEN w LIKE '%l' AND {_double('w', 'k')} AND {_measure('k')} > 1 THEN {_word_left(1)} ELSE w END")
    return f"SELECT t.token, coalesce(f.w, t.token) AS stem FROM {tokens} t LEFT JOIN ({query}) f USING (token)"
