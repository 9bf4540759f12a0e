"""Which input files differ from the ones the last build saw."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_status(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """path and status: new, changed, same or removed.

    Times are compared in whole seconds, and any difference counts, an earlier time
    too: a restored older file is a change.
    """
    now = files.select("path", F.unix_seconds("mtime").alias("now"))
    seen = manifest.select("path", F.unix_seconds("mtime").alias("seen"))
    status = (
        F.when(F.col("seen").isNull(), "new")
        .when(F.col("now").isNull(), "removed")
        .when(F.col("now") != F.col("seen"), "changed")
        .otherwise("same")
    )
    return now.join(seen, "path", "full_outer").select("path", status.alias("status"))


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    return file_status(files, manifest).filter(F.col("status") != "same")
