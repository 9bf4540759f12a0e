"""The build job: an export folder to published record, facet and word tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from citeloom.operators import facets, postings
from citeloom.operators.normalize import normalize, normalize_bib
from citeloom.operators.refresh import changed_files
from citeloom.sources import bib, library, store


def build_library(
    spark: SparkSession,
    source: str,
    root: str,
    read: Callable[[SparkSession, str], DataFrame] = library.read_lines,
    allow_rejected: bool = False,
) -> int:
    """Build a new version when any input file differs; returns the current version.

    Pieces of the input that are no record go to the version's ``rejected`` table. If there
    are any, the build fails before it publishes, unless ``allow_rejected``.

    Records are written once and every other table reads them back. The manifest is
    the file list as it was before the read, and the version is published last.
    """
    version = store.current_version(spark, root)
    files = store.list_files(spark, source)
    if version:
        seen = store.open_table(spark, root, "manifest")
        if changed_files(files, seen).isEmpty():
            return version
    draft = store.begin(spark, root)
    store.write_table(files, draft, "manifest")
    found = read(spark, source)
    if library.CORRUPT in found.columns:
        bad = store.write_table(library.rejected(found), draft, "rejected")
        refuse(bad, draft.path("rejected"), allow_rejected)
        found = library.accepted(found)
    keyed = postings.keyed(normalize(found))
    records = store.write_table(keyed, draft, "records")
    store.write_table(facets.label_facet(records), draft, "label_facet")
    store.write_table(facets.folder_facet(records), draft, "folder_facet")
    store.write_table(facets.type_facet(records), draft, "type_facet")
    words = postings.with_scopes(postings.vocabulary(records), records)
    n_rows = postings.write_vocabulary(words, draft.path("vocabulary"))
    postings.write_lists(records, draft.path("postings"), n_rows)
    lists, counts = (spark.read.parquet(draft.path(t)) for t in ("postings", "vocabulary"))
    store.write_table(postings.band_counts(lists, vocabulary=counts), draft, "bands")
    store.publish(spark, draft)
    return draft.version


def refuse(bad: DataFrame, path: str, allowed: bool) -> None:
    n = bad.count()
    if n and not allowed:
        raise ValueError(f"{n} pieces of the input are no record, see {path}")


def build_bib(spark: SparkSession, source: str, root: str, allow_rejected: bool = False) -> int:
    """All entries of a folder of ``.bib`` files as one table over the union of their fields.

    Blocks that are no entry, and entries with text that no field takes, go to the version's
    ``rejected`` table and fail the build unless ``allow_rejected``.
    """
    draft = store.begin(spark, root)
    bad = store.write_table(bib.rejected(spark, source), draft, "rejected")
    refuse(bad, draft.path("rejected"), allow_rejected)
    read = bib.read_entries(spark, source)
    entries = bib.entry_columns(read, bib.all_fields(read))
    store.write_table(normalize_bib(entries), draft, "entries")
    store.publish(spark, draft)
    return draft.version
