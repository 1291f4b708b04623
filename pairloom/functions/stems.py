"""Stems of English words by the published algorithm of Porter (1980).

A word is [C](VC)^m[V], with C and V runs of consonants and vowels; y is a vowel behind
a consonant. A rule replaces an ending where its condition holds for the stem before
it; of the endings of a step the longest that fits is the only one that is tried.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql.functions import arrow_udf

# Fixed values of the published algorithm: ending and replacement of each rule.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize",
    "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive",
    "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion",
    "ou", "ism", "ate", "iti", "ous", "ive", "ize",
)


def _kinds(word: str) -> str:
    """``v`` or ``c`` for each letter."""
    kinds = ""
    for i, letter in enumerate(word):
        vowel = letter in "aeiou" or (letter == "y" and i > 0 and kinds[-1] == "c")
        kinds += "v" if vowel else "c"
    return kinds


def _measure(word: str) -> int:
    return _kinds(word).count("vc")


def _doubled(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _short_end(word: str) -> bool:
    """Consonant, vowel, consonant at the end, the last one not w, x or y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(word: str) -> str:
    for ending, new in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if word.endswith(ending):
            return word[: len(word) - len(ending)] + new
    return word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if _measure(word[:-3]) > 0 else word
    for ending in ("ed", "ing"):
        stem = word[: -len(ending)]
        if word.endswith(ending):
            if "v" not in _kinds(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _doubled(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if _measure(stem) == 1 and _short_end(stem) else stem
    return word


def _replaced(word: str, rules: dict[str, str]) -> str:
    ending = _longest(word, rules)
    if ending is None or _measure(word[: len(word) - len(ending)]) == 0:
        return word
    return word[: len(word) - len(ending)] + rules[ending]


def _dropped(word: str) -> str:
    ending = _longest(word, STEP_4)
    if ending is None:
        return word
    stem = word[: len(word) - len(ending)]
    fits = _measure(stem) > 1 and (ending != "ion" or stem.endswith(("s", "t")))
    return stem if fits else word


def _tidied(word: str) -> str:
    if word.endswith("e"):
        stem = word[:-1]
        m = _measure(stem)
        if m > 1 or (m == 1 and not _short_end(stem)):
            word = stem
    if word.endswith("l") and _doubled(word) and _measure(word) > 1:
        word = word[:-1]
    return word


def stem(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters, and others than a-z, stay."""
    if len(word) < 3 or not (word.isascii() and word.isalpha()):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    return _tidied(_dropped(_replaced(_replaced(word, STEP_2), STEP_3)))


def _stem_lists(lists: pa.Array) -> pa.Array:
    """Each distinct token of a batch is stemmed once."""
    tokens = lists.flatten().dictionary_encode()
    stems = pa.array([stem(t) for t in tokens.dictionary.to_pylist()], pa.string())
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array([0, *lengths.cumsum().tolist()], pa.int32())
    return pa.ListArray.from_arrays(offsets, stems.take(tokens.indices))


def stemmed(tokens: Column | str) -> Column:
    """Stems of an array of lower-case tokens, in their places; null gives an empty array."""
    return arrow_udf(_stem_lists, "array<string>")(tokens)
