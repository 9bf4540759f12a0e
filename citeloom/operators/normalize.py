"""Library records to the flat, searchable record table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions import bibtex as B
from citeloom.functions import record as R

# The searchable columns of a record.
RECORD_COLUMNS = [
    "_id", "abstract", "citekey", "fileName", "first", "folder", "folderID", "fullReference",
    "journal", "label", "labelID", "last", "pdfFlag", "pmid", "subtitle", "title", "gdrive_id",
    "type", "year",
]
ARRAY_COLUMNS = ["labelsNamed", "labels", "foldersNamed", "folders"]


def complete_only(library: DataFrame) -> DataFrame:
    return library.filter(R.is_complete(F.col("incomplete")))


def with_defaults(library: DataFrame) -> DataFrame:
    """Defaults for absent source fields; a source without the column gets it too."""
    present = set(library.columns)
    return library.withColumns(
        {
            name: R.or_default(name) if name in present else F.lit(value)
            for name, value in R.DEFAULTS.items()
        }
    )


def normalize(library: DataFrame, *keep: str) -> DataFrame:
    """Drop incomplete records and derive the record table; ``keep`` names further columns to
    carry along. No shuffle: one projection."""
    base = with_defaults(complete_only(library))
    attachments = F.col("attachments")
    step1 = base.withColumns(
        {
            "first": R.first_author(F.col("author")),
            "last": R.last_author(F.col("author")),
            "authors": R.author_block(F.col("author")),
            "year": R.year(F.col("published")),
            "journal": R.strip_dots(F.col("journal")),
            "type": R.publication_type(F.col("pubtype"), F.col("kind")),
            "label": R.joined(F.col("labelsNamed")),
            "labelID": R.joined(F.col("labels")),
            "folder": R.joined(F.col("foldersNamed")),
            "folderID": R.joined(F.col("folders")),
            "pdfFlag": R.pdf_flag(attachments),
            "gdrive_id": R.drive_id(attachments, F.col("gdrive_id")),
        }
    )
    c = F.col
    full = R.full_reference(
        c("authors"), c("title"), c("journal"), c("year"), c("issue"), c("pages"), c("pmid")
    )
    step2 = step1.withColumns(
        {
            "fileName": R.file_name(attachments, c("first"), c("title")),
            "subtitle": R.short_reference(c("first"), c("last"), c("journal"), c("year")),
            "fullReference": full,
        }
    )
    return step2.select("ord", *RECORD_COLUMNS, *ARRAY_COLUMNS, *keep)


def normalize_bib(entries: DataFrame) -> DataFrame:
    """BibTeX entries (flat columns) with names, references and renamed key columns."""
    c = F.col
    present = set(entries.columns)
    optional = ["author", "journal", "pages", "pmid", "volume", "annot", "year", "title"]
    base = entries.withColumns(
        {name: F.lit(None).cast("string") for name in optional if name not in present}
    )
    named = base.withColumn("names", B.author_names(c("author")))
    step = named.withColumns(
        {
            "firstAuthor": B.first_name(c("names")),
            "lastAuthor": B.final_name(c("names")),
            "authorBlock": B.name_block(c("names")),
            "journal": B.journal(c("journal")),
            "title": B.title(c("title")),
            "pagesPart": B.pages_part(c("pages")),
            "pmidPart": B.pmid_part(c("pmid")),
            "pmid": F.coalesce(c("pmid"), F.lit("")),
            "volume": F.coalesce(c("volume"), F.lit("-")),
            "annot": F.coalesce(c("annot"), F.lit("")),
        }
    )
    # An entry without year or title still has references.
    year, title = F.coalesce(c("year"), F.lit("-")), F.coalesce(c("title"), F.lit(""))
    short = F.concat(
        c("firstAuthor"), F.lit("-"), c("lastAuthor"), F.lit(", "), c("journal"), F.lit(" "),
        year, F.lit(" "), c("pmid"),
    )
    full = F.concat(
        c("authorBlock"), F.lit(". "), title, F.lit(". "), c("journal"), F.lit(" "),
        year, F.lit(";"), c("volume"), c("pagesPart"), c("pmidPart"),
    )
    return (
        step.withColumns({"shortRef": short, "fullRef": full})
        .drop("names", "pagesPart", "pmidPart")
        .withColumnsRenamed({"ID": "myID", "file": "myFile"})
    )
