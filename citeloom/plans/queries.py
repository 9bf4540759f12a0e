"""One named query per operator, over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.functions import bibtex as B
from citeloom.functions import record as R
from citeloom.operators import facets, files, refresh, search
from citeloom.functions.tokens import words
from citeloom.operators.batch import batch_search, typed_queries
from citeloom.operators.batch_trees import batch_trees
from citeloom.operators.clauses import InScope, Near, Not, Phrase, Term, row_predicate, typed_text
from citeloom.operators.normalize import RECORD_COLUMNS, complete_only, normalize, normalize_bib
from citeloom.operators.normalize import with_defaults
from citeloom.operators.postings import (
    band_counts, keyed, matching_records, occurrences, position_lists, vocabulary, with_scopes,
    write_lists, write_vocabulary,
)
from citeloom.plans import delta, driver_view
from citeloom.plans.driver_view import bib_text, table
from citeloom.session import scratch_dir
from citeloom.sources import bib, raw
from citeloom.sources import library as lib_io

Query = Callable[[SparkSession, str], DataFrame]

LINK_BASES = {
    "record": "https://library.example/p/",
    "label": "https://library.example/label/",
    "folder": "https://library.example/folder/",
    "drive": "https://drive.example/file/",
}

CLAUSES = {
    "search_term": Term("thanedble"),
    "search_and": Term("thanedble") & Term("and") & Term("src1"),
    "search_prefix": Term("thaned", prefix=True) & Term("onor"),
    "search_field": Term("the", "title") & Term("src1", "LABEL"),
    "search_phrase": Phrase(("of", "the")) & Phrase(("and", "th"), prefix=True),
    "search_or": (Term("thanedble") | Term("onwh")) & Term("review", "type"),
    "search_not": Not(Term("that") | Term("der"), Term("the") & Term("of")),
    "search_near": Near(Term("thanedble"), Term("the"), 3) | Near(Term("der"), Term("die")),
}

# Tables written once per session and table folder, and the plans that stay the same.
_written: dict[tuple[str, str, str], str] = {}
_plans: dict[tuple[str, str, str], DataFrame] = {}


def _once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        path = scratch_dir(spark, name)
        write(path)
        _written[key] = path
    return _written[key]


def _stored(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> DataFrame:
    path = _once(spark, sf_dir, name, write)
    return _plan(spark, sf_dir, f"stored {name}", lambda s, d: s.read.parquet(path))


def _plan(spark: SparkSession, sf_dir: str, name: str, define: Query) -> DataFrame:
    """A lazy definition used by many queries, analysed once."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _plans:
        _plans[key] = define(spark, sf_dir)
    return _plans[key]


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "library", driver_view.library)


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "records", lambda s, d: normalize(library(s, d)))


def unlabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(
        spark, sf_dir, "unlabelled", lambda s, d: driver_view.library(s, d, labels=False)
    )


def unlabelled_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records for queries that use no label column: no join."""
    return _plan(spark, sf_dir, "unlabelled_records", lambda s, d: normalize(unlabelled(s, d)))


def bib_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, "bib", driver_view.bib_entries)


def stored_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record table as a build leaves it; searches read this."""
    return _stored(
        spark, sf_dir, "records", lambda path: keyed(records(spark, sf_dir)).write.parquet(path)
    )


def stored_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(
        spark, sf_dir, "postings",
        lambda path: write_lists(
            stored_records(spark, sf_dir), path,
            stored_vocabulary(spark, sf_dir).agg(F.sum("n_occurrences")).first()[0] or 0,
        ),
    )


def stored_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(
        spark, sf_dir, "bands",
        lambda path: band_counts(
            stored_postings(spark, sf_dir), vocabulary=stored_vocabulary(spark, sf_dir)
        ).write.parquet(path),
    )


def stored_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored(
        spark, sf_dir, "vocabulary",
        lambda path: write_vocabulary(
            with_scopes(vocabulary(stored_records(spark, sf_dir)), stored_records(spark, sf_dir)),
            path,
        ),
    )


def library_lines(spark: SparkSession, sf_dir: str) -> str:
    """The library as JSON Lines in the shared folder."""
    return _once(spark, sf_dir, "lines", lambda p: lib_io.write_lines(library(spark, sf_dir), p))


def library_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lib_io.accepted(lib_io.read_lines(spark, library_lines(spark, sf_dir)))
    return read.select(
        "_id", "incomplete", "title", "abstract", F.col("published.year").alias("year"),
        R.author_block(F.col("author")).alias("authors"), "journal", "pmid",
        R.joined(F.col("labelsNamed")).alias("label"), R.joined(F.col("folders")).alias("folderID"),
        F.get("attachments", F.lit(0))["filename"].alias("filename"), "pubtype", "kind",
    )


def raw_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.raw_import(spark, library_lines(spark, sf_dir))


def raw_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.text_fields(raw.read_raw(spark, library_lines(spark, sf_dir)))


def variant_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = raw.variant_fields(driver_view.mixed_lines(spark, sf_dir))
    return fields.select("_id", "field", "type", "text")


def variant_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.variant_schema(raw.variant_fields(driver_view.mixed_lines(spark, sf_dir)))


def schema_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = raw.read_raw(spark, library_lines(spark, sf_dir))
    return raw.key_census(lines).select("key", "n_records")


def union_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw.union_schema(
        table(spark, sf_dir, "conversations"),
        table(spark, sf_dir, "events"),
        table(spark, sf_dir, "benchmark"),
    )


def label_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = library_lines(spark, sf_dir)
    target = _once(
        spark, sf_dir, "export", lambda p: lib_io.export_label(spark, source, "interesting", p)
    )
    return raw.raw_import(spark, target)


def bib_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _once(
        spark, sf_dir, "bib", lambda p: bib_text(bib_entries(spark, sf_dir)).write.text(p)
    )
    fields = ["author", "title", "journal", "year", "volume", "pages", "pmid", "annot", "file", "month"]
    return bib.entry_columns(bib.read_entries(spark, path), fields)


def refresh_changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stand for files: some are new since the manifest, some differ, some are gone."""
    pages = table(spark, sf_dir, "pages")
    path = F.concat(F.lit("/in/"), F.col("page_id").cast("string"), F.lit("/"), F.col("url"))
    at = F.timestamp_seconds(F.col("page_id") * 60 + 1_700_000_000)
    now = pages.filter("page_id % 7 <> 3").select(path.alias("path"), at.alias("mtime"))
    shift = F.when(F.col("page_id") % 5 == 1, 60).when(F.col("page_id") % 5 == 2, -60).otherwise(0)
    then = F.timestamp_seconds(F.col("page_id") * 60 + 1_700_000_000 + shift)
    seen = pages.filter("page_id % 5 <> 0").select(path.alias("path"), then.alias("mtime"))
    return refresh.changed_files(now, seen)


def _refreshed(spark: SparkSession, sf_dir: str) -> str:
    """A library of eight folders of files, built when two of them hold an earlier state and one
    is empty, then refreshed."""
    every = library(spark, sf_dir).withColumn("b", F.col("ord") % 8)

    def earlier(b: int):
        return every.filter(F.col("b") == b).withColumn("labelsNamed", F.array(F.lit("draft")))

    def write(path: str) -> None:
        source, root = f"{path}/in", f"{path}/lib"

        def put(rows: DataFrame, b: int) -> None:
            rows.drop("b").write.mode("overwrite").json(f"{source}/b={b}")

        every.filter("b not in (3, 5, 7)").write.partitionBy("b").json(source)
        put(earlier(3), 3)
        put(earlier(5), 5)
        delta.refresh_library(spark, source, root)
        put(every.filter("b = 3"), 3)
        put(every.filter("b = 7"), 7)
        put(every.limit(0), 5)
        delta.refresh_library(spark, source, root)

    return f"{_once(spark, sf_dir, 'refreshed', write)}/lib"


def refresh_delta_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    facet = delta.open_live(spark, _refreshed(spark, sf_dir), "label_facet")
    return facet.select("label", "total", "label_id", "summary")


def refresh_delta_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words_table = delta.open_live(spark, _refreshed(spark, sf_dir), "vocabulary")
    return words_table.filter(~F.col("term").startswith("@"))


def file_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of article files, title-named files and page urls as the searched listing."""
    recs = unlabelled(spark, sf_dir).filter("ord % 4 <> 2").withColumn(
        "first", R.first_author(F.col("author"))
    )
    listing = recs.selectExpr(
        "explode(array("
        " concat('/lib/b/', _id, '.pdf'), concat('/lib/a', ord % 5, '/', _id, '.pdf'),"
        " concat('/lib/', ord % 10, '/', first, ' - ', replace(title, '/', '_'), '.pdf'))) as path"
    )
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("path"))
    return files.list_paths(listing.unionByName(urls))


def resolve_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = files.wanted_files(complete_only(unlabelled(spark, sf_dir)))
    return files.resolve_files(wanted, file_paths(spark, sf_dir)).select("_id", "fileName", "path")


def search_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of every benchmark text is one query."""
    sentences = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(F.split("text", r"\.")).alias("n", "sentence")
    )
    numbered = sentences.withColumn("query_id", F.col("item_id") * 1000 + F.col("n"))
    asked = typed_queries(numbered, "query_id", "sentence")
    return batch_search(asked, stored_postings(spark, sf_dir), stored_vocabulary(spark, sf_dir))


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "benchmark").select(
        "item_id", F.posexplode(F.split("text", r"\.")).alias("n", "sentence")
    )
    return parts.select((F.col("item_id") * 1000 + F.col("n")).alias("query_id"), "sentence")


def search_batch_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sentence of four words or more is a tree over its words a, b, c, d, in turn
    "a b" OR "c d*"; (a AND b) NOT c; a NEAR/3 c AND a label; (title:a OR title:b) AND c's first
    three letters. Shorter ones are one word."""
    w = [f"w[{i}]" for i in range(4)]

    def leaf(step: int, op: str, *terms: str, field: str = "null", distance: str = "null") -> str:
        pairs = ", ".join(
            f"named_struct('word', {t.rstrip('*')}, 'is_prefix', {str(t.endswith('*')).lower()})" for t in terms
        )
        return (f"named_struct('step', {step}, 'op', '{op}', 'field', cast({field} as string),"
                f" 'terms', array({pairs}), 'distance', cast({distance} as int))")

    def join(step: int, op: str) -> str:
        return (f"named_struct('step', {step}, 'op', '{op}', 'field', cast(null as string), 'terms',"
                " cast(null as array<struct<word:string,is_prefix:boolean>>), 'distance', cast(null as int))")

    a, b, c, d = w
    forms = [
        [leaf(0, "phrase", a, b), leaf(1, "phrase", c, d + "*"), join(2, "or")],
        [leaf(0, "phrase", a), leaf(1, "phrase", b), join(2, "and"), leaf(3, "phrase", c), join(4, "not")],
        [leaf(0, "near", a, c, distance="3"), leaf(1, "label", "'L-src1'"), join(2, "and")],
        [leaf(0, "phrase", a, field="'title'"), leaf(1, "phrase", b, field="'title'"), join(2, "or"),
         leaf(3, "phrase", f"left({c}, 3)*"), join(4, "and")],
    ]
    arrays = " ".join(f"when query_id % 4 = {i} then array({', '.join(f)})" for i, f in enumerate(forms))
    found = _sentences(spark, sf_dir).select("query_id", words(F.col("sentence")).alias("w"))
    nodes = found.filter("size(w) > 0").selectExpr(
        "query_id", f"inline(case when size(w) < 4 then array({leaf(0, 'phrase', a)}) {arrays} end)"
    )
    return batch_trees(nodes, stored_postings(spark, sf_dir), stored_vocabulary(spark, sf_dir))


def _select(*columns) -> Query:
    return lambda spark, sf_dir: records(spark, sf_dir).select(*columns)


def _unlabelled(*columns) -> Query:
    return lambda spark, sf_dir: unlabelled_records(spark, sf_dir).select(*columns)


def display_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unlabelled_records(spark, sf_dir).select(
        "_id", R.display_type(F.col("type")).alias("display_type"),
        R.summary_type(F.col("type")).alias("summary_type"),
    )


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    def joined(ids: str, base: str):
        return R.joined(F.transform(ids, lambda i: R.link(LINK_BASES[base], i)))

    return records(spark, sf_dir).select(
        "_id", R.link(LINK_BASES["record"], F.col("_id")).alias("record_link"),
        R.link(LINK_BASES["drive"], F.col("gdrive_id")).alias("drive_link"),
        joined("labels", "label").alias("label_links"),
        joined("folders", "folder").alias("folder_links"),
    )


def _matches(name: str) -> Query:
    return lambda spark, sf_dir: search.match_records(
        stored_records(spark, sf_dir), CLAUSES[name]
    ).select("_id", "year", "title")


def _postings_matches(name: str) -> Query:
    return lambda spark, sf_dir: matching_records(
        stored_postings(spark, sf_dir), CLAUSES[name], stored_vocabulary(spark, sf_dir)
    ).select("_id", "year")


def _scoped(scope: Callable[[DataFrame, str], DataFrame], key: str) -> Query:
    return lambda spark, sf_dir: search.match_records(
        scope(stored_records(spark, sf_dir), key), typed_text("the")
    ).select("_id", "label", "folder", "type")


def _scoped_postings(kind: str, key: str) -> Query:
    return lambda spark, sf_dir: matching_records(
        stored_postings(spark, sf_dir), InScope(kind, key) & typed_text("the"),
        stored_vocabulary(spark, sf_dir),
    ).select("_id", "year")


def _top(oldest_first: bool) -> Query:
    return lambda spark, sf_dir: search.search(
        stored_records(spark, sf_dir), typed_text("the an"), oldest_first=oldest_first
    ).select("ord", "_id", "year", "title")


def _top_postings(oldest_first: bool) -> Query:
    """Newest or oldest years first, until the hits are certain."""
    return lambda spark, sf_dir: search.search_postings(
        stored_postings(spark, sf_dir), stored_records(spark, sf_dir), typed_text("the an"),
        oldest_first=oldest_first, columns=["_id", "year", "title"],
        vocabulary=stored_vocabulary(spark, sf_dir), bands=stored_bands(spark, sf_dir),
    ).select("ord", "_id", "year", "title")


def search_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.result_rows(search.search(stored_records(spark, sf_dir), typed_text("the an")))


def facet_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    facet = facets.label_facet(records(spark, sf_dir))
    return facets.most_used_first(facet.filter(row_predicate(typed_text("src1"), ["label"])))


def facet_search_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    facet = facets.folder_facet(unlabelled_records(spark, sf_dir))
    return facets.most_used_first(facet.filter(row_predicate(typed_text("en"), ["folder"])))


def facet_search_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    facet = facets.type_facet(unlabelled_records(spark, sf_dir))
    return facets.most_used_first(facet.filter(row_predicate(typed_text("art"), ["type"])))


def _bib(*columns) -> Query:
    return lambda spark, sf_dir: normalize_bib(bib_entries(spark, sf_dir)).select(*columns)


def bib_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = B.author_names(F.col("author"))
    return bib_entries(spark, sf_dir).select(
        "ID", F.coalesce(F.size(names), F.lit(0)).cast("long").alias("n_authors"),
        B.name_block(names).alias("authorBlock"),
    )


def queries() -> dict[str, Query]:
    found: dict[str, Query] = {
        "library_scan": library_scan,
        "raw_import": raw_import,
        "raw_fields": raw_fields,
        "schema_keys": schema_keys,
        "variant_fields": variant_fields,
        "variant_schema": variant_schema,
        "union_schema": union_schema,
        "label_export": label_export,
        "complete_only": lambda s, d: complete_only(unlabelled(s, d)).select("_id", "title"),
        "defaults": lambda s, d: with_defaults(unlabelled(s, d)).select(*R.DEFAULTS),
        "journal_clean": _unlabelled("_id", "journal"),
        "author_block": lambda s, d: complete_only(unlabelled(s, d)).select(
            "_id", R.author_block(F.col("author")).alias("authors")
        ),
        "first_last": _unlabelled("_id", "first", "last"),
        "pub_year": _unlabelled("_id", "year"),
        "pub_type": _unlabelled("_id", "type"),
        "label_text": _select("_id", "label", "labelID", "folder", "folderID"),
        "file_pattern": _unlabelled("_id", "fileName", "gdrive_id"),
        "pdf_flag": _unlabelled("_id", "pdfFlag"),
        "short_ref": _unlabelled("_id", "subtitle"),
        "full_ref": _unlabelled("_id", "fullReference"),
        "display_type": display_type,
        "links": _links,
        "library_normalize": _select("ord", *RECORD_COLUMNS),
        "facet_labels": lambda s, d: facets.most_used_first(facets.label_facet(records(s, d))),
        "facet_folders": lambda s, d: facets.most_used_first(facets.folder_facet(unlabelled_records(s, d))),
        "facet_types": lambda s, d: facets.most_used_first(facets.type_facet(unlabelled_records(s, d))),
        "facet_pivot": lambda s, d: facets.facet_pivot(records(s, d), "labelsNamed", "labels"),
        "facet_display": lambda s, d: facets.facet_display(
            facets.label_facet(records(s, d)), "label", "label_id"
        ),
        "facet_search": facet_search,
        "postings": lambda s, d: occurrences(position_lists(stored_records(s, d))).select(
            "term", "col", "_id", "pos"
        ),
        "term_stats": lambda s, d: vocabulary(records(s, d)),
        **{name: _matches(name) for name in CLAUSES},
        **{f"{name}_postings": _postings_matches(name) for name in CLAUSES},
        "search_in_label": _scoped(search.in_label, "L-src1"),
        "search_in_folder": _scoped(search.in_folder, "F-EN_src1"),
        "search_in_type": _scoped(search.in_type, "Journal article"),
        "search_in_label_postings": _scoped_postings("label", "L-src1"),
        "search_in_folder_postings": _scoped_postings("folder", "F-EN_src1"),
        "search_in_type_postings": _scoped_postings("type", "Journal article"),
        "facet_search_folders": facet_search_folders,
        "facet_search_types": facet_search_types,
        "search_top_desc": _top(False),
        "search_top_asc": _top(True),
        "search_top_postings": _top_postings(False),
        "search_top_postings_asc": _top_postings(True),
        "search_display": search_display,
        "search_batch": search_batch,
        "search_batch_trees": search_batch_trees,
        "bib_scan": bib_scan,
        "bib_authors": bib_authors,
        "bib_first_last": _bib("myID", "firstAuthor", "lastAuthor"),
        "bib_title": _bib("myID", "title"),
        "bib_refs": _bib(
            "myID", "myFile", "journal", "volume", "pmid", "annot", "shortRef", "fullRef"
        ),
        "resolve_files": resolve_files,
        "refresh_changed_files": refresh_changed_files,
        "refresh_delta_facet": refresh_delta_facet,
        "refresh_delta_words": refresh_delta_words,
    }
    return found
