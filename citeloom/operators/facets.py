"""Label, folder and type facets.

Counts are aggregated per (name, type) first, with the id first seen, then per name.
Each level combines on the map side before its exchange: a label carried by every
record costs one row per map task and type, however many ids it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.functions import record as R


def name_id_pairs(records: DataFrame, names: str, ids: str, *keep: str) -> DataFrame:
    """One row per name on a record, with its id by position. No shuffle.

    A name repeated on one record keeps its first id there, so the first-seen id
    later needs the record order only.
    """
    first_id = F.transform(
        names, lambda n: F.get(F.col(ids), F.array_position(names, n).cast("int") - 1)
    )
    zipped = F.arrays_zip(F.col(names).alias("name"), first_id.alias("id"))
    return records.select(*keep, F.inline(zipped).alias("name", "id")).filter(F.col("name") != "")


def facet_counts(records: DataFrame, names: str, ids: str, *by: str) -> DataFrame:
    """Per (name, type): records, and the first seen id with its order keys. Counts of several
    batches of records may be unioned before ``finish_facet``; ``by`` counts each value of
    these columns on its own.

    Records come in the order of ``ord``, those without it last, and of their key ``rec``
    where they have one; of equal ones the smaller id is first.
    """
    raw_type = F.col("type")
    rec = F.col("rec") if "rec" in records.columns else F.lit(None).cast("string")
    pairs = name_id_pairs(records.withColumn("rec", rec), names, ids, *dict.fromkeys([*by, "ord", "rec", "type"])).select(
        *by, F.struct(F.col("ord").isNull().alias("last"), "ord", "rec", "id").alias("first"),
        "name", F.when(raw_type != "", R.summary_type(raw_type)).alias("kind"),
    )
    return pairs.groupBy(*by, "name", "kind").agg(*_merged(F.count("*")))


def _merged(n: Column) -> list[Column]:
    return [n.alias("n"), F.min("first").alias("first")]


def finish_facet(counts: DataFrame) -> DataFrame:
    """Per name: records that carry it, first-seen id, and counts per type as text.

    Output: name, total, id, summary ("type (n) type (n) ", most used first), first_ord.
    ``counts`` may hold several rows of a (name, type), one per batch.
    """
    per_type = counts.groupBy("name", "kind").agg(*_merged(F.sum("n")))
    ranked = F.sort_array(
        F.collect_list(F.when(F.col("kind").isNotNull(), F.struct((-F.col("n")).alias("k"), "kind")))
    )
    return (
        per_type.groupBy("name")
        .agg(
            F.sum("n").alias("total"),
            F.min("first").alias("first"),
            ranked.alias("kinds"),
        )
        .select(
            "name", "total", F.col("first.id").alias("id"),
            _summary(F.col("kinds")).alias("summary"), F.col("first.ord").alias("first_ord"),
        )
    )


def _summary(kinds: Column) -> Column:
    parts = F.transform(
        kinds, lambda x: F.concat(x["kind"], F.lit(" ("), (-x["k"]).cast("string"), F.lit(") "))
    )
    return F.array_join(parts, "")


def label_facet(records: DataFrame) -> DataFrame:
    return finish_facet(facet_counts(records, "labelsNamed", "labels")).withColumnsRenamed(
        {"name": "label", "id": "label_id"}
    )


def folder_facet(records: DataFrame) -> DataFrame:
    return finish_facet(facet_counts(records, "foldersNamed", "folders")).withColumnsRenamed(
        {"name": "folder", "id": "folder_id"}
    )


def type_facet(records: DataFrame, *by: str) -> DataFrame:
    """Display types with counts; raw types that read the same are merged."""
    kinds = records.select(*by, "ord", F.explode(R.display_types(F.col("type"))).alias("type"))
    return kinds.groupBy(*by, "type").agg(
        F.count("*").alias("total"), F.min("ord").alias("first_ord")
    )


def facet_pivot(
    records: DataFrame, names: str, ids: str, types: list[str] | None = None
) -> DataFrame:
    """Counts of every raw type per name, zeros included. The types are the schema.

    Without ``types`` one job lists those that occur; they are one column each, so only
    their number bounds what it returns.
    """
    pairs = name_id_pairs(records, names, ids, "type")
    if types is None:
        seen = records.filter("type <> ''").select("type").distinct().collect()
        types = sorted(row["type"] for row in seen)
    return pairs.groupBy("name").pivot("type", types).count().na.fill(0)


def most_used_first(facet: DataFrame) -> DataFrame:
    """By count, then first seen (unknown last), then name."""
    return facet.orderBy(F.col("total").desc(), F.asc_nulls_last("first_ord"), facet.columns[0])


def facet_display(facet: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """Title ``name (count)``, the summary as text, and the id for the next search."""
    title = F.concat(F.col(name), F.lit(" ("), F.col("total").cast("string"), F.lit(")"))
    subtitle = F.col("summary") if "summary" in facet.columns else F.lit("")
    return facet.select(
        title.alias("display"), subtitle.alias("subtitle"),
        F.col(key or name).alias("scope_id"), "total", "first_ord",
    )
