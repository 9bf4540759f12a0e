"""Records whose keys are not known beforehand: union of keys, all values as text.

A line that is no JSON object is kept whole under the key ``_corrupt_record``.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.sources.library import CORRUPT


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines as one text column ``value``; blank lines are none."""
    return spark.read.text(path).filter(F.trim("value") != "")


def is_object(value: str = "value") -> Column:
    """Whether a text is one whole JSON object."""
    return F.json_object_keys(value).isNotNull() & F.try_parse_json(F.col(value)).isNotNull()


def key_census(lines: DataFrame, value: str = "value", ord_col: str | None = None) -> DataFrame:
    """Every top-level key, in how many records it occurs and (if asked) where first.

    The map side keeps one row per key, so records never travel.
    """
    found = F.when(is_object(value), F.array_distinct(F.json_object_keys(value)))
    keys = F.explode(F.coalesce(found, F.array(F.lit(CORRUPT)))).alias("key")
    if ord_col is None:
        return lines.select(keys).groupBy("key").agg(F.count("*").alias("n_records"))
    return (
        lines.select(F.col(ord_col).alias("ord"), keys)
        .groupBy("key")
        .agg(F.count("*").alias("n_records"), F.min("ord").alias("first_ord"))
    )


def as_text_map(lines: DataFrame, value: str = "value") -> DataFrame:
    """Key-to-text map per record, nested values as JSON; the form for unbounded key sets.

    One pass and no key on the driver. Use it where records bring keys of their own;
    ``raw_import`` is for key sets that can be columns of a table.
    """
    broken = F.create_map(F.lit(CORRUPT), F.col(value))
    fields = F.when(is_object(value), F.from_json(value, "map<string,string>")).otherwise(broken)
    return lines.withColumn("fields", fields)


def text_fields(lines: DataFrame, value: str = "value", key: str = "_id") -> DataFrame:
    """One row per record and key it has: the value of ``key``, field, text."""
    return as_text_map(lines, value).select(
        F.try_element_at("fields", F.lit(key)).alias(key), F.explode("fields").alias("field", "text")
    ).filter("text is not null")


def widen(lines: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """One text column per key; an absent key is NULL. Only the listed keys are parsed.
    A line that is no object has its text in the column ``_corrupt_record`` alone, if listed."""
    schema = T.StructType([T.StructField(k, T.StringType()) for k in keys])
    whole = F.when(is_object(value), F.from_json(value, schema)) if CORRUPT in keys else F.from_json(value, schema)
    parsed = lines.select(whole.alias("r"), F.col(value).alias("line"))
    return parsed.select(
        *[
            (F.when(F.col("r").isNull(), F.col("line")) if k == CORRUPT else F.col("r").getField(k)).alias(k)
            for k in keys
        ]
    )


def raw_import(spark: SparkSession, path: str) -> DataFrame:
    """All records of a JSON Lines folder as text columns over the union of keys.

    The column list is part of a table's schema, so it has to be known before the
    read; the census that yields it moves one row per key and task. Broken lines, if there
    are any, come in a column ``_corrupt_record``.
    """
    lines = read_raw(spark, path)
    keys = sorted(row["key"] for row in key_census(lines).select("key").toLocalIterator())
    return widen(lines, keys)


def as_text(column: Column, data_type: T.DataType) -> Column:
    """Scalars cast to text, nested values as JSON, NULL stays NULL."""
    if isinstance(data_type, (T.StructType, T.ArrayType, T.MapType)):
        return F.to_json(column)
    return column.cast("string")


def stringify(df: DataFrame) -> DataFrame:
    return df.select(
        *[as_text(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields]
    )


def union_schema(*batches: DataFrame) -> DataFrame:
    """Batches of unlike schema as one all-text table over the union of their columns."""
    return reduce(
        lambda a, b: a.unionByName(b, allowMissingColumns=True), [stringify(b) for b in batches]
    )


def variant_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines as VARIANT values in ``record``: every key with its own type, none listed anywhere.
    A line that is no object is ``{"_corrupt_record": line}``."""
    broken = F.to_variant_object(F.struct(F.col(value).alias(CORRUPT)))
    return lines.withColumn("record", F.when(is_object(value), F.parse_json(F.col(value))).otherwise(broken))


def variant_fields(lines: DataFrame, key: str = "_id", depth: int = 2, value: str = "value") -> DataFrame:
    """One row per record and field, those of nested objects included, types kept.

    Columns: ``key`` as text, field (nested names joined by dots), type, text (nested values
    as JSON; JSON null is NULL of type VOID) and value (VARIANT). Objects nested deeper than
    ``depth`` stay whole in their field. Narrow: fields come from ``variant_explode``.
    """
    spark = lines.sparkSession
    records = variant_records(lines, value).select(
        F.try_variant_get("record", f"$.{key}", "string").alias(key), "record"
    )
    level = records.select(key, F.lit("").alias("prefix"), F.col("record").alias("inside"))
    found = []
    for _ in range(depth):
        opened = level.lateralJoin(
            spark.tvf.variant_explode(F.col("inside").outer()).select(F.col("key").alias("name"), F.col("value"))
        ).select(key, F.concat("prefix", "name").alias("field"), "value")
        found.append(opened)
        level = opened.filter(F.schema_of_variant("value").startswith("OBJECT")).select(
            key, F.concat("field", F.lit(".")).alias("prefix"), F.col("value").alias("inside")
        )
    every = reduce(DataFrame.unionByName, found)
    kind = F.schema_of_variant("value")
    is_nested = kind.startswith("OBJECT") | kind.startswith("ARRAY")
    text = F.when(is_nested, F.to_json("value")).otherwise(F.try_variant_get("value", "$", "string"))
    return every.select(key, "field", kind.alias("type"), text.alias("text"), "value")


def variant_schema(fields: DataFrame) -> DataFrame:
    """Per field of ``variant_fields``: rows and the type that takes all of its values.

    Numbers widen and objects unite their fields; values of conflicting types are VARIANT.
    Merged on the executors, one row per field and task travels.
    """
    return fields.groupBy("field").agg(
        F.schema_of_variant_agg("value").alias("type"), F.count("*").alias("n_values")
    )


def variant_columns(lines: DataFrame, value: str = "value") -> DataFrame:
    """Records as one typed column per top-level key; a key of conflicting types is VARIANT.

    For key sets that can be columns of a table: their merged schema is one text on the driver.
    """
    records = variant_records(lines, value)
    merged = records.agg(F.schema_of_variant_agg("record").alias("s")).first()["s"]
    kind = re.sub(r"(^|: |<)OBJECT<", r"\1STRUCT<", merged or "")
    kind = re.sub(r"(: |<)VOID\b", r"\1VARIANT", kind)  # never more than JSON null
    if not kind.startswith("STRUCT<") or kind == "STRUCT<>":
        return records.select()
    return records.select(F.try_variant_get("record", "$", kind).alias("r")).select("r.*")
