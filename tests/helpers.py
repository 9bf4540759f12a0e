"""Small libraries for unit tests, typed as the export schema."""

from pyspark.sql import types as T

from citeloom.sources.schema import LIBRARY

WITH_ORDER = T.StructType([*LIBRARY.fields, T.StructField("ord", T.LongType())])


def author(formatted, last=None):
    return {"formatted": formatted, "last": last}


def attachment(source, name=None, drive=None):
    return {"source_filename": source, "filename": name, "gdrive_id": drive}


def record(_id, **fields):
    base = {"_id": _id, "title": "T", "pubtype": "PP_ARTICLE", "author": [], "attachments": []}
    return {**base, **fields}


def library(spark, *rows):
    """A library in list order; ``ord`` is the position."""
    return spark.createDataFrame([{**row, "ord": i} for i, row in enumerate(rows)], WITH_ORDER)


def table(df, *columns):
    return [tuple(row) for row in df.select(*columns).collect()]
