"""Text columns: white space, words, prompts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points of Python's str.isspace, as characters and as a
# regular-expression class.
SPACES = "".join(
    map(
        chr,
        [
            *range(0x09, 0x0E),
            *range(0x1C, 0x21),
            0x85,
            0xA0,
            0x1680,
            *range(0x2000, 0x200B),
            0x2028,
            0x2029,
            0x202F,
            0x205F,
            0x3000,
        ],
    )
)
SPACE_CLASS = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)


# Words between white space. Runs of printable ASCII are taken without testing
# every character against the class.
WORD = f"(?:[!-~]++|[^{SPACE_CLASS}]++)++"


def strip(text: Column) -> Column:
    """Remove white space, of any Unicode kind, from both ends."""
    return F.btrim(text, F.lit(SPACES))


def word_count(text: Column) -> Column:
    """Number of words between white space."""
    return F.regexp_count(text, F.lit(WORD))


def words(text: Column) -> Column:
    """The words between white space."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def language(lang_pair: Column, side: int) -> Column:
    """Source (0) or target (1) language of ``"de-en"``."""
    return F.get(F.split(lang_pair, "-"), F.lit(side))


def prompt(source_language: str, target_language: str) -> str:
    """Instruction put before every source text."""
    return f"Translate {source_language} to {target_language}: "
