"""Words as the search sees them.

Only ASCII A-Z is folded. A word is a run of ASCII letters, digits or any
character from U+0080 up; everything else, ``_`` included, separates words.
``lower()`` alone is not usable: it also folds non-ASCII letters.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The folded alphabet and the word characters.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD_CHARS = r"0-9A-Za-z\x{80}-\x{10FFFF}"

_PY_WORD = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")
_PY_FOLD = str.maketrans(UPPER, LOWER)


def fold(text: Column) -> Column:
    """Fold A-Z. Pure-ASCII values (byte count = character count) take the fast path."""
    is_ascii = F.octet_length(text) == F.char_length(text)
    return F.when(is_ascii, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def raw_words(text: Column) -> Column:
    """All words of a text in order, not folded yet."""
    return F.regexp_extract_all(text, F.lit(f"[{WORD_CHARS}]+"), F.lit(0))


def words(text: Column) -> Column:
    """All folded words of a text in order."""
    return raw_words(F.translate(text, UPPER, LOWER))


def split_words(text: str) -> list[str]:
    """The same rule for a query string held by the caller."""
    return [w.translate(_PY_FOLD) for w in _PY_WORD.findall(text)]
