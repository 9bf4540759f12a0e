"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm import mixing, packing, quality, secret_scan, simhash
from citeloom.llm.queries import table, vocabulary
from citeloom.session import stored


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps; it learns from those of ``docs``.

    Null texts are scored as empty ones, repeated rows each; see ``quality.kept``.
    """
    return quality.kept(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates (3-word shingles, 3 bits) the one of the smallest doc_id stays.

    Texts without words are one group; ties and null ids as in ``simhash.one_of_each``.
    """
    return simhash.one_of_each(docs, shingle=3, radius=3)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; found secrets are replaced and n_chars follows.

    The findings come from the ledger of this run's blobs, written before it is joined, and
    meet the documents by blob. Only texts with findings are joined on. Null and empty texts
    stay as they are, repeated rows stay each; rows travel as one struct, so their columns
    may have any names.
    """
    ledger = stored(secret_scan.scan_unseen(docs), "ledger")
    rows = docs.select(F.struct("*").alias("row"), secret_scan.blob_id(F.col("text")).alias("blob"))
    joined = rows.join(secret_scan.entries(ledger), "blob", "left")
    found, text = F.col("findings").isNotNull(), F.col("row.text")
    clean = joined.select(
        "row", "findings", F.when(found, secret_scan.redacted(text, F.col("findings"))).otherwise(text).alias("clean")
    )
    chars = F.when(found, F.length("clean").cast("long")).otherwise(F.col("row.n_chars"))
    row = F.col("row").withField("text", F.col("clean")).withField("n_chars", chars)
    return clean.select(row.alias("row")).select("row.*")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it, up to three times.

    A null source is one of its own, a text without words is never taken; see ``mixing.copied``.
    """
    return mixing.copied(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of 2048 tokens.

    Null and empty texts are one token, repeated rows pieces of their own.
    """
    return packing.pack_documents(docs, *vocabulary())


STAGES = [
    ("quality classifier", good_documents),
    ("simhash near-dedup", one_of_each_group),
    ("secret scan", without_secrets),
    ("source mix", mixed),
    ("best-fit packing", packed),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
