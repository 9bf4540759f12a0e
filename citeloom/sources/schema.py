"""The library export record: the wanted fields and the completeness flag."""

from pyspark.sql import types as T

_TEXT = T.StringType()
_TEXTS = T.ArrayType(_TEXT)

# Field names of the export. Fields not listed are pruned at parse time.
LIBRARY = T.StructType(
    [
        T.StructField("_id", _TEXT),
        T.StructField("incomplete", _TEXT),
        T.StructField("title", _TEXT),
        T.StructField("published", T.StructType([T.StructField("year", _TEXT)])),
        T.StructField("abstract", _TEXT),
        T.StructField(
            "author",
            T.ArrayType(
                T.StructType([T.StructField("formatted", _TEXT), T.StructField("last", _TEXT)])
            ),
        ),
        T.StructField("citekey", _TEXT),
        T.StructField("journal", _TEXT),
        T.StructField("pmid", _TEXT),
        T.StructField("issue", _TEXT),
        T.StructField("pages", _TEXT),
        T.StructField("volume", _TEXT),
        T.StructField("labelsNamed", _TEXTS),
        T.StructField("labels", _TEXTS),
        T.StructField("foldersNamed", _TEXTS),
        T.StructField("folders", _TEXTS),
        T.StructField("subfolders", _TEXTS),
        T.StructField(
            "attachments",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("source_filename", _TEXT),
                        T.StructField("filename", _TEXT),
                        T.StructField("gdrive_id", _TEXT),
                    ]
                )
            ),
        ),
        T.StructField("gdrive_id", _TEXT),
        T.StructField("pubtype", _TEXT),
        T.StructField("kind", _TEXT),
    ]
)
