import pytest
from helpers import attachment, author, library, record, table
from pyspark.sql import functions as F

from citeloom.functions import record as R
from citeloom.operators.normalize import RECORD_COLUMNS, complete_only, normalize


def one(spark, column, **fields):
    return normalize(library(spark, record("x", **fields))).select(column).first()[0]


def test_incomplete_records_are_dropped(spark):
    flags = ["1", "true", "0", None, "false"]
    lib = library(spark, *[record(str(i), incomplete=f) for i, f in enumerate(flags)])
    assert {r[0] for r in table(complete_only(lib), "_id")} == {"2", "3", "4"}


@pytest.mark.parametrize("value,kept", [(1, False), (0, True), (True, False), (False, True), (1.0, False)])
def test_completeness_flag_of_any_type(spark, value, kept):
    df = spark.createDataFrame([(value,)], ["incomplete"])
    assert complete_only(df).count() == int(kept)


def test_columns(spark):
    df = normalize(library(spark, record("x")))
    assert df.columns[: 1 + len(RECORD_COLUMNS)] == ["ord", *RECORD_COLUMNS]


def test_no_author_keeps_own_year(spark):
    row = normalize(library(spark, record("x", published={"year": "2020"}))).first()
    assert (row["first"], row["last"], row["year"]) == ("", "", "2020")
    assert row["fullReference"].startswith(". ")
    assert row["subtitle"] == "-, - 2020"


def test_sole_author_is_first_and_last(spark):
    row = normalize(library(spark, record("x", author=[author("Doe J", "Doe")]))).first()
    assert (row["first"], row["last"]) == ("Doe", "Doe")


def test_repeated_author_keeps_separators(spark):
    names = [author("A"), author("B"), author("A")]
    assert one(spark, "fullReference", author=names).startswith("A, B, A. ")


@pytest.mark.parametrize("published", [None, {"year": None}])
def test_unknown_year(spark, published):
    assert one(spark, "year", published=published) == "-"


@pytest.mark.parametrize(
    "kind,expected",
    [("Review", "Review"), ("News", "News"), ("Commentary", "Commentary"),
     ("Other", "PP_ARTICLE"), (None, "PP_ARTICLE")],
)
def test_kind_overrides_type(spark, kind, expected):
    assert one(spark, "type", kind=kind) == expected


def test_display_and_summary_type(spark):
    df = spark.createDataFrame([("PP_JOURNAL_ARTICLE",), ("Review",), ("PP_REVIEW",)], ["t"])
    rows = table(df, R.display_type(F.col("t")), R.summary_type(F.col("t")))
    assert rows == [("Journal article", "journal_article"), ("Review", "review"), ("Review", "review")]


def test_file_name_forms(spark):
    long_title = "Thirty characters exactly here, and more"
    doe = [author("Doe J", "Doe")]
    stated = [attachment("[article_pdf].pdf", "a b.pdf")]
    assert one(spark, "fileName", attachments=stated) == "a b.pdf"
    other = one(spark, "fileName", attachments=[attachment("x.pdf")], title=long_title, author=doe)
    assert other == "Doe*" + long_title[:30] + "*"
    assert one(spark, "fileName") == ""
    assert one(spark, "fileName", attachments=[attachment("x.pdf")], title="A...  b", author=doe) == "Doe*A... b*"


def test_pdf_flag_and_drive_id(spark):
    assert one(spark, "pdfFlag") == " "
    assert one(spark, "pdfFlag", attachments=[attachment("x.pdf")]) == "📜"
    assert one(spark, "gdrive_id", attachments=[attachment("x", "y", "g1")], gdrive_id="own") == "g1"
    assert one(spark, "gdrive_id", attachments=[attachment("x", "y")], gdrive_id="own") == "own"
    assert one(spark, "gdrive_id") == ""


def test_full_and_short_reference(spark):
    fields = dict(
        author=[author("A B", "A"), author("C D", "C")], title="T", journal="J. X.",
        published={"year": "2020"}, issue="1", pages="2-3", pmid="9",
    )
    assert one(spark, "fullReference", **fields) == "A B, C D. T. J X 2020;1:2-3. PMID: 9"
    assert one(spark, "subtitle", **fields) == "A-C, J X 2020"


def test_labels_and_folders_are_joined(spark):
    row = normalize(
        library(spark, record("x", labelsNamed=["a", "b"], labels=["1", "2"], folders=None))
    ).first()
    assert (row["label"], row["labelID"], row["folder"], row["folderID"]) == ("a,b", "1,2", "", "")
