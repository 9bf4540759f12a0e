"""Session helpers shared by tests, bench and local use."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def local_session(cpus: int | str = 8, app: str = "citeloom") -> SparkSession:
    """A single-machine session. On a cluster, use the session the cluster gives."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(cpus) if str(cpus).isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder for tables that must be written and read back.

    The folder every executor can reach is the one the cluster names in
    ``spark.checkpoint.dir``. Only a local session may fall back to /tmp.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    return f"{root.rstrip('/')}/citeloom-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Cuts the lineage, survives lost executors and gives the optimizer the real size.
    Without ``folder`` a fresh one under ``spark.checkpoint.dir`` takes it; whoever owns
    that setting removes it, as with checkpoints. A named folder is the caller's to remove.
    """
    path = f"{folder}/{uuid.uuid4().hex}/{name}" if folder else scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give executors this package, once per application, as ``--py-files`` would.

    Python tasks import their functions from it; without this they would find it only where
    the package is installed or in the working folder. The driver serves the archive.
    """
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="run-"), os.path.basename(package))
        archive = shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def in_python(df: DataFrame, function, schema) -> DataFrame:
    """``mapInArrow`` with this package at hand on the executors."""
    ship_package(df.sparkSession)
    return df.mapInArrow(function, schema)


def by_rows(table: DataFrame, key: str, rows_per_task: int) -> DataFrame:
    """Cut a stored table into tasks by row count, for work that multiplies its rows.

    Small tables still use all cores as long as a task gets some hundred rows.
    """
    rows = table.count()
    cores = table.sparkSession.sparkContext.defaultParallelism
    return table.repartition(max(1, min(cores, rows // 500), rows // rows_per_task), key)


BROADCAST_BYTES = 32 * 1024 * 1024


def fits_broadcast(small: DataFrame) -> bool:
    """Whether a stored table, measured row by row, may be broadcast."""
    widths = [F.lit(0), *[_width(field) for field in small.schema.fields]]
    size = small.agg(F.coalesce(F.sum(sum(widths[1:], widths[0])), F.lit(0)).alias("bytes"))
    return size.first()["bytes"] <= BROADCAST_BYTES


def _width(field: T.StructField) -> Column:
    """Bytes of a value: text by its length, numbers as 8, nested ones but lists of numbers as JSON."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.ArrayType) and isinstance(field.dataType.elementType, T.NumericType):
        return F.greatest(F.coalesce(F.size(value), F.lit(0)), F.lit(0)) * 8 + 16
    if isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
        value = F.to_json(F.struct(value))
    elif not isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.lit(8)
    return F.coalesce(F.octet_length(value), F.lit(0)) + 8


def salted_join(
    large: DataFrame, small: DataFrame, keys: list[str], spread_by: str, salts: int
) -> DataFrame:
    """Equi-join a large side with many rows per key to a stored smaller side.

    The smaller side is measured: up to BROADCAST_BYTES it is broadcast and the large
    side stays where it is. Beyond that both sides are shuffled on the keys and a salt
    taken from ``spread_by``, so one hot key becomes ``salts`` tasks.
    """
    if fits_broadcast(small):
        return large.join(F.broadcast(small), keys)
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    copies = small.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return large.withColumn("salt", salt).join(copies, [*keys, "salt"]).drop("salt")


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Use all cores for a table that arrives in fewer pieces than there are cores.

    A table of many files has more splits than the cluster has cores and passes
    through unchanged, without a shuffle. ``scan`` must be a plain file scan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores, key)
