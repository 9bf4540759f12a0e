"""A library over the driver's tables: ``documents`` left-joined with ``labels``.

The scalar expressions are SQL that Spark and DuckDB both accept, so the checks
in ``plans.oracle`` start from the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.session import spread

BASE = {
    "ord": "d.doc_id",
    "_id": "concat('d', d.doc_id)",
    "incomplete": "case when d.doc_id % 13 = 0 then 1 else 0 end",
    "title": "replace(substr(d.text, 1, 80), chr(10), ' ')",
    "abstract": "d.text",
    "pub_year_src": "case when d.doc_id % 11 = 0 then null"
    " else cast(1990 + d.doc_id % 35 as varchar(10)) end",
    "citekey": "case when d.doc_id % 14 = 0 then null else concat('c', d.doc_id) end",
    "issue": "case when d.doc_id % 9 = 1 then null else cast(d.doc_id % 12 as varchar(10)) end",
    "pages": "case when d.doc_id % 4 = 1 then null"
    " else concat(d.doc_id % 100, '-', d.doc_id % 100 + 9) end",
    "gdrive_id": "case when d.doc_id % 10 = 3 then concat('g', d.doc_id) else null end",
    "pubtype": "case when d.doc_id % 35 = 2 then 'PP_BOOK,PP_REVIEW' else case d.doc_id % 5 when 0 then 'PP_ARTICLE' when 1 then 'PP_JOURNAL_ARTICLE'"
    " when 2 then 'PP_BOOK' when 3 then 'PP_REVIEW' else 'PP_THESIS' end end",
    "kind": "case d.doc_id % 7 when 0 then 'Review' when 1 then 'News' when 2 then 'Other'"
    " when 3 then 'Commentary'"
    " else null end",
    "journal": "case when d.doc_id % 8 = 0 then null else concat('J. ', d.source, '. Res.') end",
    "pmid": "case when d.doc_id % 10 = 0 then null else cast(100000 + d.doc_id as varchar(10)) end",
    "label_csv": "case when d.doc_id % 17 = 0 then null else concat(d.source, ',', d.lang,"
    " case when l.quality = 1 then ',interesting' else '' end,"
    " case when d.doc_id % 23 = 0 then concat(',', d.source) else '' end) end",
    "folder_csv": "case when d.doc_id % 9 = 0 then null"
    " else concat(upper(d.lang), '_', d.source) end",
}

NESTED = {
    "labelsNamed": "split(label_csv, ',')",
    "labels": "transform(split(label_csv, ','), x -> concat('L-', x))",
    "foldersNamed": "split(folder_csv, ',')",
    "folders": "transform(split(folder_csv, ','), x -> concat('F-', x))",
    "published": "named_struct('year', pub_year_src)",
    "author": "case when ord % 4 = 0 then array() else transform(sequence(0L, ord % 4 - 1), i ->"
    " named_struct('formatted', concat('Name', (ord * 7 + i) % 97, ' A'),"
    " 'last', concat('Name', (ord * 7 + i) % 97))) end",
    "attachments": "case when ord % 3 = 0 then array(named_struct('source_filename',"
    " case when ord % 6 = 0 then '[article_pdf].pdf' else 'x.pdf' end,"
    " 'filename', concat(_id, '.pdf'),"
    " 'gdrive_id', case when ord % 12 = 3 then concat('a', ord) end)) else array() end",
}


BIB = {
    "ord": "d.doc_id",
    "ID": "concat('k', d.doc_id)",
    "author": "case d.doc_id % 4 when 0 then null"
    " when 1 then concat('Doe', d.doc_id % 97, ', jane ann')"
    " when 2 then concat('Rand Smith', d.doc_id % 89, ' and Roe, Rick B')"
    " else concat('Doe', d.doc_id % 97, ', J and van Dam, k. l. and ', upper(d.source)) end",
    "title": "concat(case when d.doc_id % 2 = 0 then '{' else '' end,"
    " replace(substr(d.text, 1, 80), chr(10), ' '),"
    " case when d.doc_id % 2 = 0 then '}' else '' end)",
    "journal": "case when d.doc_id % 8 = 0 then null else concat('J. ', d.source, '. Res.') end",
    "year": "cast(1990 + d.doc_id % 35 as varchar(10))",
    "volume": "case when d.doc_id % 5 = 0 then null else cast(d.doc_id % 50 as varchar(10)) end",
    "pages": "case when d.doc_id % 3 = 0 then null"
    " else concat(d.doc_id % 100, '-', d.doc_id % 100 + 9) end",
    "pmid": "case when d.doc_id % 10 = 0 then null else cast(100000 + d.doc_id as varchar(10)) end",
    "annot": "replace(d.text, chr(10), ' ')",
    "file": "concat(d.source, '/', d.doc_id, '.pdf')",
}


# A JSON line per document: ``rank`` is a number, a text or a list, ``size`` is nested.
MIXED = (
    "concat('{\"_id\":\"d', d.doc_id, '\",\"rank\":', case d.doc_id % 4 when 0 then cast(d.doc_id as varchar(20))"
    " when 1 then concat('\"r', d.doc_id, '\"') when 2 then concat('[', d.doc_id, ',true]') else 'null' end,"
    " ',\"size\":{\"chars\":', d.n_chars, case when d.doc_id % 3 = 0 then '' else"
    " concat(',\"lang\":\"', d.lang, '\"') end, '}}')"
)


def mixed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").alias("d").selectExpr(f"{MIXED} as value")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def library(spark: SparkSession, sf_dir: str, labels: bool = True) -> DataFrame:
    """Nested library records. Columns a query does not use are never read.

    Only the label lists come from ``labels``, which has one row per document. A query
    without them passes ``labels=False``: no join, and the label lists are NULL.
    """
    base = dict(BASE)
    rows = spread(table(spark, sf_dir, "documents"), "doc_id").alias("d")
    if labels:
        quality = table(spark, sf_dir, "labels").select("doc_id", "quality").alias("l")
        rows = rows.join(quality, F.col("d.doc_id") == F.col("l.doc_id"), "left")
    else:
        base["label_csv"] = "cast(null as string)"
    flat = rows.selectExpr(*[f"{sql} as {name}" for name, sql in base.items()])
    nested = flat.withColumns({name: F.expr(sql) for name, sql in NESTED.items()})
    return nested.drop("pub_year_src", "label_csv", "folder_csv")


def bib_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"), "doc_id").alias("d")
    return d.selectExpr(*[f"{sql} as {name}" for name, sql in BIB.items()])


def bib_text(entries: DataFrame) -> DataFrame:
    """Entries written the way simple exports do: one field per line, three value styles."""
    field = [
        ("author", "{", "}"), ("title", "{", "}"), ("journal", '"', '"'), ("year", "", ""),
        ("volume", "", ""), ("pages", "{", "}"), ("pmid", "{", "}"), ("annot", "{", "}"),
        ("file", "{", "}"),
    ]
    lines = [
        F.concat(F.lit(f"  {name} = {a}"), F.col(name), F.lit(b)) for name, a, b in field
    ] + [F.lit("  month = mar")]
    head = F.concat(F.lit("@Article{"), F.col("ID"))
    return entries.select(F.concat(F.concat_ws(",\n", head, *lines), F.lit("\n}\n")).alias("value"))
