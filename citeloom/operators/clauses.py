"""Search conditions as plain values.

The caller states what to match as a tree of these; malformed input raises
``ValueError`` here, before any job starts. Each leaf knows how to test text
columns (`scan form`); the postings form is in ``operators.postings``.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeloom.functions import record as R
from citeloom.functions.tokens import WORD_CHARS, split_words
from citeloom.operators.normalize import RECORD_COLUMNS

_WORD = f"[{WORD_CHARS}]"
_GAP = f"[^{WORD_CHARS}]"
_WORD_END = f"(?!{_WORD})"


def _starting(word: str) -> str:
    """A literal that begins at a word start."""
    return f"{word}(?<!{_WORD}{word})"


BARRIER = "\uffff"  # not a character of any text; stands between joined columns
DEFAULT_DISTANCE = 10  # fixed value: words allowed between two near operands


def _column_name(field: str) -> str:
    for name in RECORD_COLUMNS:
        if name.lower() == field.lower():
            return name
    raise ValueError(f"unknown field {field!r}")


def _single_words(texts: tuple[str, ...]) -> tuple[str, ...]:
    folded = []
    for text in texts:
        found = split_words(text)
        if len(found) != 1 or BARRIER in text:
            raise ValueError(f"{text!r} is not one word")
        folded.append(found[0])
    return tuple(folded)


class Clause:
    """Base of all conditions; ``&`` and ``|`` combine them."""

    def __and__(self, other: Clause) -> And:
        return And(self, other)

    def __or__(self, other: Clause) -> Or:
        return Or(self, other)


@dataclass(frozen=True)
class Phrase(Clause):
    """Adjacent words in order within one column; the last may be a prefix."""

    words: tuple[str, ...]
    field: str | None = None
    prefix: bool = False

    def __post_init__(self) -> None:
        if not self.words:
            raise ValueError("a phrase needs at least one word")
        object.__setattr__(self, "words", _single_words(tuple(self.words)))
        if self.field is not None:
            object.__setattr__(self, "field", _column_name(self.field))

    def regex(self) -> str:
        """Pattern of the phrase; ``(?i)`` without a Unicode flag folds ASCII letters only.

        The first word stands before the check of what precedes it: a pattern that
        starts with a literal is scanned several times faster than one that starts
        with a look-behind.
        """
        first, rest = self.words[0], self.words[1:]
        end = "" if self.prefix else _WORD_END
        return f"(?i){_starting(first)}" + "".join(f"{_GAP}++{w}" for w in rest) + end


def Term(word: str, field: str | None = None, prefix: bool = False) -> Phrase:
    """One word or word prefix: a phrase of length one."""
    return Phrase((word,), field, prefix)


@dataclass(frozen=True)
class Near(Clause):
    """Two words in one column, either order, at most ``distance`` words between."""

    left: Phrase
    right: Phrase
    distance: int = DEFAULT_DISTANCE
    field: str | None = None

    def __post_init__(self) -> None:
        if self.distance < 0:
            raise ValueError("distance must not be negative")
        for side in (self.left, self.right):
            if not isinstance(side, Phrase) or len(side.words) != 1 or side.field:
                raise ValueError("near takes two single words; state the field on the clause")
        if self.field is not None:
            object.__setattr__(self, "field", _column_name(self.field))

    def regex(self) -> str:
        between = f"{_GAP}++(?:{_WORD}++{_GAP}++){{0,{self.distance}}}?"

        def ordered(a: Phrase, b: Phrase) -> str:
            a_tail = f"{_WORD}*+" if a.prefix else _WORD_END
            b_end = "" if b.prefix else _WORD_END
            return f"{_starting(a.words[0])}{a_tail}{between}{b.words[0]}{b_end}"

        return f"(?i)(?:{ordered(self.left, self.right)}|{ordered(self.right, self.left)})"


SCOPES = ("label", "folder", "type")


@dataclass(frozen=True)
class InScope(Clause):
    """Records with exactly this label id, folder id or display type."""

    kind: str
    key: str

    def __post_init__(self) -> None:
        if self.kind not in SCOPES or not isinstance(self.key, str):
            raise ValueError(f"no such scope: {self.kind!r}, {self.key!r}")

    @property
    def term(self) -> str:
        """The scope as a posting; ``@`` and ``:`` occur in no word."""
        return f"@{self.kind}:{self.key}"


def scope_keys(kind: str) -> Column:
    """A record's label ids, folder ids or display types."""
    if kind == "type":
        return R.display_types(F.col("type"))
    return F.col({"label": "labels", "folder": "folders"}[kind])


class _Group(Clause):
    def __init__(self, *parts: Clause) -> None:
        if not parts or not all(isinstance(p, Clause) for p in parts):
            raise ValueError("every operand must be a clause")
        self.parts = parts


class And(_Group):
    """All parts match, each in any column."""


class Or(_Group):
    """At least one part matches."""


@dataclass(frozen=True)
class Not(Clause):
    """Records that match ``keep`` and do not match ``drop``."""

    keep: Clause
    drop: Clause

    def __post_init__(self) -> None:
        if not isinstance(self.keep, Clause) or not isinstance(self.drop, Clause):
            raise ValueError("every operand must be a clause")


def typed_text(text: str, field: str | None = None) -> Clause | None:
    """Plain typed words: all must match, the last one as a prefix while it is being
    typed, that is unless white space follows it. Text without words gives None."""
    found = split_words(text)
    if not found:
        return None
    open_end = bool(split_words(text[-1]))
    terms = [Term(w, field) for w in found[:-1]] + [Term(found[-1], field, open_end)]
    return terms[0] if len(terms) == 1 else And(*terms)


def leaves(clause: Clause) -> list[Phrase | Near]:
    """Distinct leaf conditions in order of appearance."""
    if isinstance(clause, _Group):
        found = [leaf for part in clause.parts for leaf in leaves(part)]
    elif isinstance(clause, Not):
        found = leaves(clause.keep) + leaves(clause.drop)
    else:
        found = [clause]
    return list(dict.fromkeys(found))


def required_words(clause: Clause) -> list[tuple[str, bool]]:
    """(word, is prefix) pairs that every match holds; an OR requires none of its parts."""
    if isinstance(clause, And):
        return [w for part in clause.parts for w in required_words(part)]
    if isinstance(clause, Not):
        return required_words(clause.keep)
    if isinstance(clause, Near):
        return required_words(clause.left) + required_words(clause.right)
    if isinstance(clause, InScope):
        return [(clause.term, False)]
    if isinstance(clause, Phrase):
        last = len(clause.words) - 1
        return [(w, clause.prefix and i == last) for i, w in enumerate(clause.words)]
    return []


def combine(clause: Clause, test) -> Column:
    """The boolean Column of a tree, given a Column for each leaf."""
    if isinstance(clause, And):
        return reduce(lambda a, b: a & b, [combine(p, test) for p in clause.parts])
    if isinstance(clause, Or):
        return reduce(lambda a, b: a | b, [combine(p, test) for p in clause.parts])
    if isinstance(clause, Not):
        return combine(clause.keep, test) & ~combine(clause.drop, test)
    return test(clause)


def row_predicate(clause: Clause, columns: list[str] | None = None) -> Column:
    """The tree as one filter over text columns. NULL text never matches.

    A word or phrase without a field is looked for once in all columns joined, with a
    barrier word between columns that no clause can name. Closeness counts words, so
    there the columns are tested one by one.
    """
    names = columns or RECORD_COLUMNS
    joined = F.concat_ws(f" {BARRIER} ", *names)

    def test(leaf: Phrase | Near | InScope) -> Column:
        if isinstance(leaf, InScope):
            found = F.array_contains(scope_keys(leaf.kind), leaf.key)
            return F.coalesce(found, F.lit(False))
        if leaf.field is None and isinstance(leaf, Phrase):
            return joined.rlike(leaf.regex())
        scope = [leaf.field] if leaf.field else names
        hits = [F.coalesce(F.col(c).rlike(leaf.regex()), F.lit(False)) for c in scope]
        return reduce(lambda a, b: a | b, hits)

    return combine(clause, test)
