"""Incremental ingest: new JSON Lines files join the tables without a rebuild.

Each micro-batch writes one ``batch=N`` folder per table. A batch that is run again
after a failure overwrites its own folders, so no record is counted twice. Facets
keep partial counts per batch, which add up at read time.

A file stream sees new files only; changed or removed files need ``plans.build``.
Lines that are no record go to the batch's ``rejected`` folder and to no other table.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from citeloom.operators import facets
from citeloom.operators.normalize import normalize
from citeloom.operators.postings import (
    keyed, vocabulary, with_scopes, write_lists, write_vocabulary,
)
from citeloom.sources import library

FACETS = {"label_counts": ("labelsNamed", "labels"), "folder_counts": ("foldersNamed", "folders")}


def ingest_new_files(
    spark: SparkSession, source: str, root: str, checkpoint: str,
    files_per_batch: int | None = None,
) -> StreamingQuery:
    """Process every file that has arrived since the last run, then stop."""
    reader = spark.readStream
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    lines = library.parse_lines(reader.text(source))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        def target(name: str) -> str:
            return f"{root}/{name}/batch={batch_id}"

        library.rejected(batch).write.mode("overwrite").parquet(target("rejected"))
        keyed(normalize(library.accepted(batch)), batch_id).write.mode("overwrite").parquet(target("records"))
        records = batch.sparkSession.read.parquet(target("records"))
        for name, (names, ids) in FACETS.items():
            counts = facets.facet_counts(records, names, ids)
            counts.write.mode("overwrite").parquet(target(name))
        facets.type_facet(records).write.mode("overwrite").parquet(target("type_counts"))
        words = with_scopes(vocabulary(records), records)
        n_rows = write_vocabulary(words, target("vocabulary"))
        write_lists(records, target("postings"), n_rows)

    return (
        lines.writeStream.foreachBatch(write_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def open_ingested(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """A table over all batches so far, None before the first one."""
    try:
        return spark.read.parquet(f"{root}/{name}")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def ingested_vocabulary(spark: SparkSession, root: str) -> DataFrame:
    """Words of all batches so far; the counts of batches add up."""
    words = open_ingested(spark, root, "vocabulary")
    if words is None:
        raise ValueError(f"nothing ingested under {root}")
    return words.groupBy("term").agg(
        *[F.sum(n).alias(n) for n in ("n_occurrences", "n_records")]
    )


def ingested_types(spark: SparkSession, root: str) -> DataFrame:
    counts = open_ingested(spark, root, "type_counts")
    if counts is None:
        raise ValueError(f"nothing ingested under {root}")
    return counts.groupBy("type").agg(
        F.sum("total").alias("total"), F.min("first_ord").alias("first_ord")
    )


def ingested_facet(spark: SparkSession, root: str, name: str = "label_counts") -> DataFrame:
    counts = open_ingested(spark, root, name)
    if counts is None:
        raise ValueError(f"nothing ingested under {root}")
    return facets.finish_facet(counts)
