"""Refresh that rewrites only what changed: tables kept per source file.

Every refresh that finds new, changed or removed files writes one part: the rows of the
files it read, in a folder of its own. Each row carries its file's key (part number and file
number, the first digits of ``rec``), and counts (facets, vocabulary) are kept per file, so
a file is taken out by its key alone: nothing of it is read or written again. The version's
manifest names the part that holds each live file, its tombstones the keys of files that
were changed or removed since in parts that are still read.

A live table is the union of the live parts without the tombstones' files; counts are added
up when they are opened. Parts without dead files are read as they are. A refresh that would
leave over ``MOST_PARTS`` parts, or as many dead files as live ones, reads everything anew.

As in ``build_library`` the version is published last: a refresh that dies leaves the last
one in place. Files are told apart by path and time; no file and empty files are no records.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import facets, postings
from citeloom.operators.normalize import normalize
from citeloom.operators.refresh import file_status
from citeloom.plans.build import refuse
from citeloom.session import fits_broadcast
from citeloom.sources import library, store

MOST_PARTS = 16
FILE_DIGITS = 24  # of ``rec``: 8 for the part, 16 for the file
FACETS = {"label": ("labelsNamed", "labels"), "folder": ("foldersNamed", "folders")}


def _hex(number: Column, digits: int) -> Column:
    return F.lpad(F.hex(number), digits, "0")


def _file_of(rec: str = "rec") -> Column:
    return F.left(F.col(rec), F.lit(FILE_DIGITS)).alias("file")


def _listing(spark: SparkSession, source: str) -> DataFrame:
    """path, uri (as readers name the file) and mtime of every input file."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(source)
    return found.select(
        "path", F.col("_metadata.file_path").alias("uri"), F.col("modificationTime").alias("mtime")
    )


def _paths(files: DataFrame) -> list[str]:
    """File names as paths: what a pattern would read as its own sign is escaped."""
    plain = F.regexp_replace("path", r"([\\\[\]{}*?])", r"\\$1")
    return [row["p"] for row in files.select(plain.alias("p")).collect()]


def _meet(rows: DataFrame, files: DataFrame, key: str, how: str) -> DataFrame:
    """Join to a stored table of files, which is broadcast if it is small."""
    return rows.join(F.broadcast(files) if fits_broadcast(files) else files, key, how)


def refresh_library(
    spark: SparkSession, source: str, root: str,
    read: Callable[[SparkSession, str | list[str]], DataFrame] = library.read_lines,
    allow_rejected: bool = False,
) -> int:
    """Bring the tables under ``root`` up to date with the files of ``source``; returns the
    version. ``read`` takes the folder or a list of files and names each row's ``source_file``.

    Pieces that are no record go to the version's ``rejected`` table; if there are any, the
    refresh fails before it publishes, unless ``allow_rejected``.
    """
    last = store.current(spark, root)
    draft = store.begin(spark, root)
    files = store.write_table(_listing(spark, source), draft, "listing")
    whole = True
    if last:
        seen = spark.read.parquet(last.path("manifest"))
        status = store.write_table(file_status(files, seen), draft, "status")
        if status.filter("status <> 'same'").isEmpty():
            return last.version
        kept = seen.join(status.filter("status = 'same'").select("path"), "path", "left_semi")
        same = store.write_table(kept, draft, "kept")
        live = same.select("part").distinct()
        gone = seen.join(same.select("path"), "path", "left_anti").select("file", "part")
        known = spark.read.parquet(last.path("tombstones"))
        buried = known.unionByName(gone).join(live, "part", "left_semi")
        dead = store.write_table(buried, draft, "buried")
        whole = not 0 < live.count() < MOST_PARTS or dead.count() >= same.count()
    if whole:
        fresh, paths = files, source
    else:
        changed = status.filter("status in ('new', 'changed')").select("path")
        fresh = files.join(changed, "path", "left_semi")
        paths = _paths(fresh)
    number = F.concat(_hex(F.lit(draft.version), 8), _hex(F.monotonically_increasing_id(), 16))
    numbered = fresh.repartitionByRange("path").sortWithinPartitions("path").withColumns(
        {"file": number, "part": F.lit(draft.folder)}
    )
    fresh = store.write_table(numbered, draft, "fresh")
    if whole:
        store.write_table(fresh, draft, "manifest")
        store.write_table(fresh.select("file", "part").limit(0), draft, "tombstones")
    else:
        store.write_table(same.unionByName(fresh), draft, "manifest")
        store.write_table(dead, draft, "tombstones")
    if whole or paths:
        _write_part(spark, draft, read(spark, paths), fresh, allow_rejected)
    store.publish(spark, draft)
    return draft.version


def _write_part(
    spark: SparkSession, draft: store.Draft, found: DataFrame, fresh: DataFrame, allow_rejected: bool
) -> None:
    """The tables of the files that were read, each row with its file."""
    bad = store.write_table(library.rejected(found), draft, "rejected")
    refuse(bad, draft.path("rejected"), allow_rejected)
    good = found.filter(F.col(library.CORRUPT).isNull()).drop(library.CORRUPT)
    rows = normalize(good.withColumnRenamed("source_file", "uri"), "uri")
    placed = _meet(rows, fresh.select("uri", "file"), "uri", "inner").drop("uri")
    rec = F.concat("file", _hex(F.monotonically_increasing_id(), 16))
    records = store.write_table(placed.withColumn("rec", rec).drop("file"), draft, "records")
    with_file = records.withColumn("file", _file_of())
    for name, (names, ids) in FACETS.items():
        store.write_table(facets.facet_counts(with_file, names, ids, "file"), draft, f"{name}_counts")
    store.write_table(facets.type_facet(with_file, "file"), draft, "type_counts")
    words = postings.vocabulary(with_file, by=("file",))
    n_rows = postings.write_vocabulary(
        postings.with_scopes(words, with_file, "file"), draft.path("words")
    )
    postings.write_lists(records, draft.path("postings"), n_rows)


def _live_rows(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of all live parts without the rows of dead files."""
    last = store.current(spark, root)
    if last is None:
        raise ValueError(f"nothing published under {root}")
    manifest, dead = (spark.read.parquet(last.path(t)) for t in ("manifest", "tombstones"))
    # At most MOST_PARTS rows.
    parts = [row["part"] for row in manifest.select("part").distinct().orderBy("part").collect()]
    holed = {row["part"] for row in dead.select("part").distinct().collect()}
    if not parts:  # no file is left: the columns are those of any part
        return spark.read.parquet(f"{last.root}/*/{name}").limit(0)
    tables = []
    for part in parts:
        rows = spark.read.parquet(f"{last.root}/{part}/{name}")
        if part in holed:
            own = dead.filter(F.col("part") == part).select("file")
            if "file" in rows.columns:
                rows = _meet(rows, own, "file", "left_anti")
            else:
                rows = _meet(rows.withColumn("file", _file_of()), own, "file", "left_anti").drop("file")
        tables.append(rows)
    return reduce(DataFrame.unionByName, tables)


def open_live(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``records``, ``postings``, ``vocabulary``, ``label_facet``, ``folder_facet`` or
    ``type_facet`` as a full build of today's files would give them, but for ``rec``."""
    if name in ("records", "postings"):
        return _live_rows(spark, root, name)
    if name == "vocabulary":
        return _live_rows(spark, root, "words").groupBy("term").agg(
            F.sum("n_occurrences").alias("n_occurrences"), F.sum("n_records").alias("n_records")
        )
    kind = name.removesuffix("_facet")
    if kind == "type":
        return _live_rows(spark, root, "type_counts").groupBy("type").agg(
            F.sum("total").alias("total"), F.min("first_ord").alias("first_ord")
        )
    if kind not in FACETS:
        raise ValueError(f"no such table: {name!r}")
    counts = _live_rows(spark, root, f"{kind}_counts").drop("file")
    return facets.finish_facet(counts).withColumnsRenamed({"name": kind, "id": f"{kind}_id"})
