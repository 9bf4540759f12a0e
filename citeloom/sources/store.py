"""Versioned tables: every build writes a new folder, the marker is written last.

Readers see the newest marked version only, so a build that dies half-way leaves
the last good tables in place and is simply run again. Each build has a folder of its
own, named in its marker: two builds at once never touch each other's tables, and the
one published last counts.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Draft(NamedTuple):
    """A version being built: where it belongs, its number and its folder."""

    root: str
    version: int
    folder: str

    def path(self, name: str) -> str:
        return f"{self.root}/{self.folder}/{name}"


def current(spark: SparkSession, root: str) -> Draft | None:
    """The newest published version, None when nothing was published yet."""
    root = root.rstrip("/")
    try:
        marks = spark.read.schema("version long, at double, folder string").json(f"{root}/published")
    except AnalysisException as missing:
        if missing.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    newest = marks.agg(F.max(F.struct("version", "at", "folder")).alias("m")).first()["m"]
    return None if newest is None else Draft(root, newest["version"], newest["folder"])


def current_version(spark: SparkSession, root: str) -> int:
    """The newest published version, 0 when nothing was published yet."""
    found = current(spark, root)
    return found.version if found else 0


def begin(spark: SparkSession, root: str) -> Draft:
    """The next version, in a folder no other build uses."""
    version = current_version(spark, root) + 1
    return Draft(root.rstrip("/"), version, f"v{version:08d}-{uuid.uuid4().hex}")


def write_table(df: DataFrame, draft: Draft, name: str) -> DataFrame:
    """Write one table of a version and read it back, which also cuts the lineage."""
    df.write.parquet(draft.path(name))
    return df.sparkSession.read.parquet(draft.path(name))


def publish(spark: SparkSession, draft: Draft) -> None:
    mark = spark.range(1).select(
        F.lit(draft.version).cast("long").alias("version"),
        F.unix_micros(F.current_timestamp()).cast("double").alias("at"),
        F.lit(draft.folder).alias("folder"),
    )
    mark.coalesce(1).write.mode("append").json(f"{draft.root}/published")


def open_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    found = current(spark, root)
    if found is None:
        raise ValueError(f"nothing published under {root}")
    return spark.read.parquet(found.path(name))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Path, modification time and length of every input file; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(
        "path", F.col("modificationTime").alias("mtime"), "length"
    )
