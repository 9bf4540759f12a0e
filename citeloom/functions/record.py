"""Column expressions over one library record (nested input columns).

Every function takes and returns Columns, so a whole record is derived in one
projection inside code generation, without any shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
UNKNOWN = "-"
PDF_MARK = "📜"
LABEL_MARK = " 🏷"
NO_PDF = " "
ARTICLE_ATTACHMENT = "[article_pdf].pdf"
SPECIAL_KINDS = ["Commentary", "Review", "News"]
TITLE_PATTERN_CHARS = 30
DEFAULTS = {
    "pmid": "-",
    "citekey": "-",
    "journal": "-",
    "abstract": "",
    "issue": "",
    "pages": "",
    "gdrive_id": "",
    "_id": "",
}


def or_default(name: str) -> Column:
    """A source field with its default for an absent value."""
    return F.coalesce(F.col(name), F.lit(DEFAULTS[name]))


def is_complete(flag: Column) -> Column:
    """False for 1 / true in whatever type the export used; NULL counts as complete."""
    text = F.lower(flag.cast("string"))
    return ~F.coalesce(text.isin("1", "1.0", "true"), F.lit(False))


def strip_dots(journal: Column) -> Column:
    return F.translate(journal, ".", "")


def author_block(authors: Column) -> Column:
    names = F.transform(authors, lambda a: a["formatted"])
    return F.coalesce(F.array_join(names, ", "), F.lit(""))


def first_author(authors: Column) -> Column:
    return F.coalesce(F.get(authors, F.lit(0))["last"], F.lit(""))


def last_author(authors: Column) -> Column:
    return F.coalesce(F.try_element_at(authors, F.lit(-1))["last"], F.lit(""))


def year(published: Column) -> Column:
    return F.coalesce(published["year"], F.lit(UNKNOWN))


def publication_type(pubtype: Column, kind: Column) -> Column:
    return F.when(kind.isin(SPECIAL_KINDS), kind).otherwise(F.coalesce(pubtype, F.lit("")))


def joined(values: Column) -> Column:
    """Names or ids as one display text."""
    return F.coalesce(F.array_join(values, ","), F.lit(""))


def has_attachment(attachments: Column) -> Column:
    return F.coalesce(F.size(attachments), F.lit(0)) > 0


def _fix_ellipsis(text: Column) -> Column:
    return F.replace(text, F.lit("...  "), F.lit("... "))


def exact_file(attachments: Column) -> Column:
    """The name of the article file where the export states one, else NULL."""
    first = F.get(attachments, F.lit(0))
    return F.when(first["source_filename"] == ARTICLE_ATTACHMENT, _fix_ellipsis(first["filename"]))


def glob_title(title: Column) -> Column:
    """The literal title part of a file pattern."""
    head = F.substring(F.coalesce(title, F.lit("")), 1, TITLE_PATTERN_CHARS)
    return _fix_ellipsis(head)


def file_name(attachments: Column, first: Column, title: Column) -> Column:
    """Exact file name, or ``Last*first title characters*``, or '' without attachment."""
    stated = F.get(attachments, F.lit(0))["source_filename"] == ARTICLE_ATTACHMENT
    head = F.substring(F.coalesce(title, F.lit("")), 1, TITLE_PATTERN_CHARS)
    pattern = _fix_ellipsis(F.concat(first, F.lit("*"), head, F.lit("*")))
    return (
        F.when(~has_attachment(attachments), F.lit(""))
        .when(stated, F.coalesce(exact_file(attachments), F.lit("")))
        .otherwise(pattern)
    )


def pdf_flag(attachments: Column) -> Column:
    return F.when(has_attachment(attachments), F.lit(PDF_MARK)).otherwise(F.lit(NO_PDF))


def drive_id(attachments: Column, own: Column) -> Column:
    return F.coalesce(F.get(attachments, F.lit(0))["gdrive_id"], own, F.lit(""))


def short_reference(first: Column, last: Column, journal: Column, pub_year: Column) -> Column:
    return F.concat(first, F.lit("-"), last, F.lit(", "), journal, F.lit(" "), pub_year)


def full_reference(
    authors: Column, title: Column, journal: Column, pub_year: Column,
    issue: Column, pages: Column, pmid: Column,
) -> Column:
    return F.concat(
        authors, F.lit(". "), F.coalesce(title, F.lit("")), F.lit(". "), journal, F.lit(" "),
        pub_year, F.lit(";"), issue, F.lit(":"), pages, F.lit(". PMID: "), pmid,
    )


def summary_type(pub_type: Column) -> Column:
    """The type as it is counted in a facet summary."""
    return F.replace(F.lower(pub_type), F.lit("pp_"), F.lit(""))


def display_type(pub_type: Column) -> Column:
    """Spaces for underscores, only the first letter of the whole text upper-case."""
    plain = F.replace(F.replace(pub_type, F.lit("PP_"), F.lit("")), F.lit("_"), F.lit(" "))
    return F.concat(F.upper(F.substring(plain, 1, 1)), F.lower(F.substr(plain, F.lit(2))))


def display_types(pub_type: Column) -> Column:
    """The display form of every non-empty comma part of a type."""
    parts = F.filter(F.split(pub_type, ","), lambda t: t != "")
    return F.transform(parts, display_type)


def reference_with_pmid(subtitle: Column, pmid: Column) -> Column:
    return F.concat_ws(" ", subtitle, pmid)


def prefixed_key(citekey: Column, prefix: str = "@") -> Column:
    return F.concat(F.lit(prefix), citekey)


def link(base: str, key: Column) -> Column:
    """A URL for a non-empty id, else NULL."""
    return F.when(key != "", F.concat(F.lit(base), key))
