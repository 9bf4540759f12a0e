"""One search: match, order by year, limit, and the result text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions import record as R
from citeloom.operators.clauses import Clause, InScope, row_predicate
from citeloom.operators.normalize import RECORD_COLUMNS
from citeloom.operators.postings import RECORD_KEY, keyed, matching_records, year_cuts

DEFAULT_LIMIT = 99  # fixed value: results per search
FETCH_KEYS = 1_000  # limits up to this are fetched by key, without a join


def match_records(records: DataFrame, clause: Clause | None) -> DataFrame:
    """All records that match (scan form). No clause, no result."""
    if clause is None:
        return records.limit(0)
    return records.filter(row_predicate(clause))


def in_label(records: DataFrame, label_id: str) -> DataFrame:
    return records.filter(row_predicate(InScope("label", label_id)))


def in_folder(records: DataFrame, folder_id: str) -> DataFrame:
    return records.filter(row_predicate(InScope("folder", folder_id)))


def in_type(records: DataFrame, display_type: str) -> DataFrame:
    return records.filter(row_predicate(InScope("type", display_type)))


def top_by_year(
    matches: DataFrame, limit: int = DEFAULT_LIMIT, oldest_first: bool = False
) -> DataFrame:
    """Newest first by year text (unknown years last), ties in record order.

    Sort plus limit runs as a top-k per task and one small merge, not a global sort.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    by_year = F.col("year").asc() if oldest_first else F.col("year").desc()
    return matches.orderBy(by_year, *_ties(matches)).limit(limit)


def _ties(records: DataFrame) -> list[str]:
    return ["ord", "rec"] if "rec" in records.columns else ["ord"]


def search(
    records: DataFrame, clause: Clause | None, limit: int = DEFAULT_LIMIT,
    oldest_first: bool = False,
) -> DataFrame:
    """Scan form: one pass over the text columns."""
    return top_by_year(match_records(records, clause), limit, oldest_first)


def search_postings(
    postings: DataFrame, records: DataFrame, clause: Clause | None, limit: int = DEFAULT_LIMIT,
    oldest_first: bool = False, columns: list[str] | None = None,
    vocabulary: DataFrame | None = None, bands: DataFrame | None = None,
) -> DataFrame:
    """Postings form: only the rows of the query's words are read, and the top hits are
    ranked from the postings alone.

    With ``bands`` (``postings.band_counts``) hot words are not read whole: the search takes
    the newest years first and stops as soon as ``limit`` hits are certain. A record's rows
    all bear its year, so a clause holds within the years read or not at all, and what lies
    beyond them ranks after every hit.

    Up to ``FETCH_KEYS`` the search runs when this is called, and the records are filtered
    by the hits' keys as literals: records lie in key order, so only the hits' row groups
    are read. A larger limit meets the records in a join. ``rec`` stays on the rows, so that
    records of equal or no id keep their order in ``result_rows``.
    """
    records = keyed(records)
    wanted = records.select("rec", "ord", *(columns or RECORD_COLUMNS))
    if clause is None:
        return wanted.limit(0)
    def hits_in(rows: DataFrame) -> DataFrame:
        found = matching_records(rows, clause, vocabulary)
        return top_by_year(found, limit, oldest_first).select("rec")

    hits = hits_in(postings)
    if limit <= FETCH_KEYS:
        for year in year_cuts(bands, clause, limit, oldest_first) if bands is not None else []:
            near = F.col("year") <= year if oldest_first else F.col("year") >= year
            certain = hits_in(postings.filter(near)).collect()
            if len(certain) == limit:
                break
        else:
            certain = hits.collect()
        keys = [F.col("rec") == row["rec"] for row in certain]
        chosen = wanted.filter(either(keys)) if keys else wanted.limit(0)
    else:
        chosen = wanted.join(hits, "rec", "left_semi")
    return top_by_year(chosen, limit, oldest_first)


def either(tests: list[Column]) -> Column:
    """Any of the tests. Equalities one by one, since Parquet prunes on each of them,
    where a long IN list prunes on its range only."""
    while len(tests) > 1:
        pairs = [tests[i : i + 2] for i in range(0, len(tests), 2)]
        tests = [p[0] | p[1] if len(p) == 2 else p[0] for p in pairs]
    return tests[0]


def result_rows(top: DataFrame, oldest_first: bool = False, key_prefix: str = "@") -> DataFrame:
    """Result text and action fields of limited hits: ``rank/total``, flag, reference, labels.

    The windows run after the limit, over at most that many rows.
    """
    by_year = F.col("year").asc() if oldest_first else F.col("year").desc()
    ranked = top.withColumns(
        {
            "rank": F.row_number().over(Window.orderBy(by_year, *_ties(top))).cast("long"),
            "total": F.count("*").over(Window.partitionBy()),
        }
    )
    counter = F.concat(F.col("rank").cast("string"), F.lit("/"), F.col("total").cast("string"))
    text = F.concat(counter, F.col("pdfFlag"), F.col("subtitle"), F.lit(R.LABEL_MARK), F.col("label"))
    return ranked.select(
        "rank", "title", text.alias("display"), "fileName", "fullReference",
        R.reference_with_pmid(F.col("subtitle"), F.col("pmid")).alias("shortPMID"),
        "abstract", R.prefixed_key(F.col("citekey"), key_prefix).alias("citekey"),
        "gdrive_id", "_id",
    )


__all__ = [
    "RECORD_KEY", "in_folder", "in_label", "in_type", "match_records", "result_rows", "search",
    "search_postings", "top_by_year",
]
