"""Library exports in and out.

JSON Lines is the form that scales: files split, columns prune at parse time. Other
exports are turned into JSON Lines once and every later read runs in parallel:

* an indented JSON array is itself read in parallel, since a record starts on a line
  of its own and JSON strings hold no raw line breaks (``indented_elements``);
* an array without line breaks is a single unsplittable value, one task per file.

Nothing is lost on the way in. Readers keep a piece that is no well-formed record, with
its text in ``_corrupt_record`` and its file in ``source_file``; ``accepted`` and
``rejected`` tell the two apart, and a build fails on rejected pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql import functions as F

from citeloom.sources.schema import LIBRARY

CORRUPT = "_corrupt_record"
_CHECKED = T.StructType([*LIBRARY.fields, T.StructField(CORRUPT, T.StringType())])


def _parsed(pieces: DataFrame, ord_: Column | None = None) -> DataFrame:
    """Records of (source_file, value, ...) rows, each parsed on its own."""
    parsed = F.from_json("value", _CHECKED, {"columnNameOfCorruptRecord": CORRUPT})
    order = F.col("r._id") if ord_ is None else ord_
    return pieces.withColumn("r", parsed).select("r.*", order.alias("ord"), "source_file")


def accepted(read: DataFrame) -> DataFrame:
    """The well-formed records of a reader."""
    return read.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, "source_file")


def rejected(read: DataFrame) -> DataFrame:
    """The pieces a reader could not take as a record: source_file, value."""
    bad = read.filter(F.col(CORRUPT).isNotNull())
    return bad.select("source_file", F.col(CORRUPT).alias("value"))


def _with_file(text: DataFrame) -> DataFrame:
    return text.select(F.col("_metadata.file_path").alias("source_file"), "value")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines records. The order key is the record id, which no file split changes."""
    return parse_lines(spark.read.text(path))


def parse_lines(text: DataFrame) -> DataFrame:
    """The same over a text source, a stream too."""
    return _parsed(_with_file(text).filter(F.trim("value") != ""))


def read_arrays(spark: SparkSession, path: str) -> DataFrame:
    """Files that each hold one JSON array; the order key is (file, position).

    Elements are parsed one by one, so a bad one takes no other along. A file that is no
    array at all is one rejected piece.
    """
    files = _with_file(spark.read.text(path, wholetext=True))
    elements = files.withColumn("elements", F.from_json("value", "array<string>"))
    pieces = elements.filter("elements is null").select(
        "source_file", "value", F.lit(0).alias("pos")
    ).unionByName(
        elements.select("source_file", F.posexplode("elements").alias("pos", "value"))
    )
    whole = pieces.withColumn("value", F.coalesce("value", F.lit("null")))
    return _parsed(whole, F.struct("source_file", "pos"))


def indented_elements(spark: SparkSession, path: str, indent: int) -> DataFrame:
    """Every element of indented array files as JSON text, read in splits."""
    pieces = _with_file(spark.read.text(path, lineSep="\n" + " " * indent + "{"))
    tail = F.regexp_replace("value", r"\}\s*,?\s*\]?\s*\z", "}")
    bodies = pieces.filter(~F.col("value").rlike(r"\A\s*\[\s*\]?\s*\z"))
    return bodies.select("source_file", F.concat(F.lit("{"), tail).alias("value"))


def array_to_lines(spark: SparkSession, path: str, target: str, indent: int | None = None) -> None:
    """One-off conversion: every element of every array file, all keys kept, one per line.

    ``indent`` is the number of spaces before each record of an indented export; without
    it each file is parsed as one value.
    """
    if indent is None:
        elements = spark.read.text(path, wholetext=True).select(
            F.explode(F.from_json("value", "array<string>")).alias("value")
        )
    else:
        # Line breaks in JSON stand between tokens only.
        flat = F.regexp_replace("value", r"\s*[\r\n]+\s*", " ")
        elements = indented_elements(spark, path, indent).select(flat.alias("value"))
    elements.write.mode("overwrite").text(target)


def read_indented(spark: SparkSession, path: str, indent: int) -> DataFrame:
    """Records of indented array files; the order key is the record id."""
    return _parsed(indented_elements(spark, path, indent))


def with_label(records: DataFrame, label: str) -> DataFrame:
    """Records whose label list exists and holds exactly this name."""
    return records.filter(F.array_contains("labelsNamed", label))


def write_lines(records: DataFrame, target: str) -> None:
    records.write.mode("overwrite").json(target)


def export_label(
    spark: SparkSession, source: str, label: str, target: str, rejected_to: str | None = None
) -> None:
    """Copy the matching JSON Lines unchanged, so every original key survives.

    Only the label array is parsed; the line itself is written through as text. Lines that
    are no record may carry the label or not: they go to the folder ``rejected_to``
    (source_file, value, as JSON Lines); without one they fail the export before it writes.
    """
    bad = rejected(read_lines(spark, source))
    if rejected_to:
        bad.write.mode("overwrite").json(rejected_to)
    elif not bad.isEmpty():
        raise ValueError(f"lines of {source} are no record; name a folder for them")
    lines = spark.read.text(source)
    names = F.from_json("value", "labelsNamed array<string>")["labelsNamed"]
    lines.filter(F.array_contains(names, label)).write.mode("overwrite").text(target)
