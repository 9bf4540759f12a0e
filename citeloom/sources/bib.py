"""Simple ``.bib`` exports: one entry per ``@type{key, ...}`` block.

``lineSep`` makes each entry one row and keeps files splittable. Values may be
braced, quoted or bare and may run over several lines; string macros other than
the month names are not expanded.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Month macros and block types that are not entries.
MONTHS = {
    "jan": "January", "feb": "February", "mar": "March", "apr": "April",
    "may": "May", "jun": "June", "jul": "July", "aug": "August",
    "sep": "September", "oct": "October", "nov": "November", "dec": "December",
}
NOT_ENTRIES = ["comment", "string", "preamble"]

_HEAD = r"\A\s*@?\s*([A-Za-z]+)\s*[{(]\s*([^,\s{}]*)\s*(?=,)"


def _braced(depth: int) -> str:
    """Balanced braces up to a depth; runs are possessive, so long values stay cheap."""
    inner = _braced(depth - 1) if depth > 1 else ""
    return r"\{(?:[^{}]++" + (f"|{inner}" if inner else "") + r")*+\}"


#: Braces within a value may nest this deep.
DEPTH = 6
_VALUE = rf"{_braced(DEPTH)}|\"[^\"]*+\"|[^\s,{{}}\"]+"
# name = {value} | "value" | bare, each after a comma (or a line end) and closed by a comma or
# the end of the entry.
_FIELD = rf"(?s)(?<=[,\n])\s*([A-Za-z][\w-]*+)\s*=\s*({_VALUE})\s*(?=,|[}})]?\s*\z)"
# An entry that starts on a line of its own but not in its first column.
_INNER = r"\n[ \t]+(?=@\s*[A-Za-z]+\s*[{(]\s*[^,\s{}]*\s*,)"


def _blocks(spark: SparkSession, path: str) -> DataFrame:
    """Pieces of the files that start like an entry: source_file, value."""
    pieces = spark.read.text(path, lineSep="\n@")
    return pieces.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.explode(F.split("value", _INNER)).alias("value"),
    )


def _headed(blocks: DataFrame) -> DataFrame:
    return blocks.withColumns(
        {
            "entrytype": F.lower(F.regexp_extract("value", _HEAD, 1)),
            "ID": F.regexp_extract("value", _HEAD, 2),
        }
    )


def _is_entry() -> Column:
    return (F.col("entrytype") != "") & ~F.col("entrytype").isin(NOT_ENTRIES)


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry: lower-case type, key and a map of lower-case field to text."""
    entries = _headed(_blocks(spark, path)).filter(_is_entry())
    return entries.select("entrytype", "ID", _field_map(F.col("value")).alias("fields"))


def rejected(spark: SparkSession, path: str) -> DataFrame:
    """What ``read_entries`` leaves unread: source_file, value.

    Blocks that are no entry (but for comments, strings and preambles, and text without any
    ``@word{``), and entries in which text remains beside the head and the fields.
    """
    blocks = _headed(_blocks(spark, path))
    rest = F.regexp_replace(F.regexp_replace("value", _FIELD, ""), _HEAD, "")
    unread = _is_entry() & ~rest.rlike(r"\A[\s,]*[})]?\s*\z")
    other = rf"\A\s*@?\s*(?i:{'|'.join(NOT_ENTRIES)})\s*[{{(]"
    lost = (F.col("entrytype") == "") & ~F.col("value").rlike(other) & (F.trim("value") != "")
    return blocks.filter(unread | lost).select("source_file", "value")


def _field_map(body: Column) -> Column:
    names = F.transform(F.regexp_extract_all(body, F.lit(_FIELD), F.lit(1)), F.lower)
    values = F.regexp_extract_all(body, F.lit(_FIELD), F.lit(2))
    pairs = F.arrays_zip(names.alias("key"), F.transform(values, _field_value).alias("value"))
    # A repeated field keeps its first value; a map with two equal keys would fail.
    kept = F.filter(pairs, lambda p, i: F.array_position(names, p["key"]) == i + 1)
    return F.map_from_entries(kept)


def _field_value(raw: Column) -> Column:
    months = F.create_map(*[F.lit(x) for x in chain.from_iterable(MONTHS.items())])
    enclosed = F.left(raw, F.lit(1)).isin("{", '"')
    inner = F.substr(raw, F.lit(2), F.char_length(raw) - 2)
    return F.when(enclosed, inner).otherwise(F.coalesce(months[F.lower(raw)], raw))


def entry_columns(entries: DataFrame, fields: list[str]) -> DataFrame:
    """Chosen fields as columns; an absent field is NULL."""
    return entries.select(
        "entrytype", "ID", *[F.try_element_at("fields", F.lit(f)).alias(f) for f in fields]
    )


def all_fields(entries: DataFrame) -> list[str]:
    """Every field name that occurs: the columns of a table over all entries."""
    names = entries.select(F.explode(F.map_keys("fields")).alias("field")).distinct()
    return sorted(row["field"] for row in names.toLocalIterator())
