"""Column expressions over one BibTeX entry (flat string columns)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def author_names(author: Column) -> Column:
    """``Last, First Second and ...`` as an array of ``Last FS``; NULL stays NULL.

    Names are split on a whitespace-delimited ``and``, so a name that ends in
    those letters stays whole.
    """

    def one(name: Column) -> Column:
        last = F.trim(F.substring_index(name, ",", 1))
        given = F.substr(name, F.instr(name, F.lit(",")) + 1)
        parts = F.filter(F.split(given, r"\s+"), lambda p: p != "")
        initials = F.array_join(F.transform(parts, lambda p: F.upper(F.left(p, F.lit(1)))), "")
        return F.when(F.contains(name, F.lit(",")), F.concat(last, F.lit(" "), initials)).otherwise(
            F.trim(name)
        )

    names = F.filter(F.split(author, r"\s+and\s+"), lambda n: F.trim(n) != "")
    return F.transform(names, one)


def name_block(names: Column) -> Column:
    return F.coalesce(F.array_join(names, ", "), F.lit(""))


def _first_word(name: Column) -> Column:
    return F.coalesce(F.get(F.split(F.trim(name), r"\s+"), F.lit(0)), F.lit(""))


def first_name(names: Column) -> Column:
    return _first_word(F.get(names, F.lit(0)))


def final_name(names: Column) -> Column:
    return _first_word(F.try_element_at(names, F.lit(-1)))


def journal(value: Column) -> Column:
    return F.coalesce(F.translate(value, ".", ""), F.lit(""))


def title(value: Column) -> Column:
    """Drop one opening and one closing brace, each on its own."""
    return F.regexp_replace(F.regexp_replace(value, r"^\{", ""), r"\}\z", "")


def pages_part(pages: Column) -> Column:
    return F.when(pages.isNotNull(), F.concat(F.lit(":"), pages, F.lit("."))).otherwise("")


def pmid_part(pmid: Column) -> Column:
    return F.when(pmid.isNotNull(), F.concat(F.lit(" PMID: "), pmid, F.lit("."))).otherwise("")
