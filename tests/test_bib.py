import pytest
from helpers import table
from pyspark.sql import functions as F

from citeloom.functions import bibtex as B
from citeloom.operators.normalize import normalize_bib
from citeloom.plans.build import build_bib
from citeloom.sources import bib, store

BIB = '''@comment{made by hand}

@Article{key1,
  author = {Doe, Jane Ann and Roe, Rick B},
  title = {{A {Braced} title}},
  journal = "J. Test. Res.",
  year = 1999,
  month = jan,
  pages = {1--9},
  abstract = {Two lines, year = 3,
   and = more},
  title = {second},
  pmid = {77}
}

@book{key2,
  title = {Plain},
  year = {2001}}
'''


@pytest.fixture()
def entries(spark, tmp_path):
    (tmp_path / "a.bib").write_text(BIB)
    (tmp_path / "b.bib").write_text("@misc{key3,\n Title = {Third},\n YEAR = 2002,\n}\n")
    return bib.read_entries(spark, str(tmp_path))


def test_entries(entries):
    rows = {r["ID"]: (r["entrytype"], r["fields"]) for r in entries.collect()}
    assert set(rows) == {"key1", "key2", "key3"}
    kind, fields = rows["key1"]
    assert kind == "article"
    assert fields["title"] == "{A {Braced} title}"
    assert (fields["journal"], fields["year"], fields["month"]) == ("J. Test. Res.", "1999", "January")
    assert fields["abstract"] == "Two lines, year = 3,\n   and = more"
    assert fields["pmid"] == "77" and fields["pages"] == "1--9"
    assert rows["key2"] == ("book", {"title": "Plain", "year": "2001"})
    assert rows["key3"] == ("misc", {"title": "Third", "year": "2002"})


def test_references(entries):
    flat = bib.entry_columns(
        entries, ["author", "title", "journal", "year", "volume", "pages", "pmid", "annot", "file"]
    )
    done = normalize_bib(flat)
    rows = {r["myID"]: r for r in done.collect()}
    one, two = rows["key1"], rows["key2"]
    assert one["authorBlock"] == "Doe JA, Roe RB"
    assert (one["firstAuthor"], one["lastAuthor"]) == ("Doe", "Roe")
    assert one["title"] == "A {Braced} title"
    assert one["shortRef"] == "Doe-Roe, J Test Res 1999 77"
    assert one["fullRef"] == "Doe JA, Roe RB. A {Braced} title. J Test Res 1999;-:1--9. PMID: 77."
    assert two["fullRef"] == ". Plain.  2001;-"
    assert (two["volume"], two["annot"], two["pmid"]) == ("-", "", "")
    assert "myFile" in done.columns and "file" not in done.columns


def test_build_unites_the_fields(spark, entries, tmp_path):
    root = str(tmp_path / "out")
    assert build_bib(spark, str(tmp_path / "*.bib"), root) == 1
    table_ = store.open_table(spark, root, "entries")
    assert {"myID", "entrytype", "abstract", "month", "shortRef", "authorBlock"} <= set(table_.columns)
    assert table_.count() == 3 and table_.filter("abstract is null").count() == 2


@pytest.mark.parametrize(
    "author,block,first,last",
    [
        ("Rand Smith and Doe, J", "Rand Smith, Doe J", "Rand", "Doe"),
        ("Doe, j. r.", "Doe JR", "Doe", "Doe"),
        ("van Dam, Kees\n  and  Roe, A", "van Dam K, Roe A", "van", "Roe"),
        (None, "", "", ""),
    ],
)
def test_author_names(spark, author, block, first, last):
    df = spark.createDataFrame([(author,)], "a string")
    names = B.author_names(F.col("a"))
    got = table(df, B.name_block(names), B.first_name(names), B.final_name(names))
    assert got == [(block, first, last)]


@pytest.mark.parametrize("raw,clean", [("{A}", "A"), ("{A", "A"), ("A}", "A"), ("{{A}}", "{A}"), ("A", "A")])
def test_title(spark, raw, clean):
    df = spark.createDataFrame([(raw,)], "t string")
    assert table(df, B.title(F.col("t"))) == [(clean,)]


ODD = """  @article{k1,
  title = {First, indented}, year = 2001
}
  @article{k2, author = {A, B}, title = {T {two {deep}}}, year = 2002}
\t@book{k3, title = "Third",
 note = {mail a@b.c
 and {c} @home}}
@misc{k4, title = {Fourth}}
"""


def test_indented_and_one_line_entries(spark, tmp_path):
    (tmp_path / "a.bib").write_text(ODD)
    rows = {r["ID"]: r["fields"] for r in bib.read_entries(spark, str(tmp_path)).collect()}
    assert rows == {
        "k1": {"title": "First, indented", "year": "2001"},
        "k2": {"author": "A, B", "title": "T {two {deep}}", "year": "2002"},
        "k3": {"title": "Third", "note": "mail a@b.c\n and {c} @home"},
        "k4": {"title": "Fourth"},
    }
    assert bib.rejected(spark, str(tmp_path)).count() == 0


def test_unread_text_is_reported(spark, tmp_path):
    (tmp_path / "a.bib").write_text(
        "@string{x = {y}}\n@article{a,\n title = {T},\n note = {cut\n@here},\n year = 2001\n}\n"
        "@article{b,\n title = {open {\n}\n@comment{fine}\n@misc{c,\n year = 1999\n}\n"
    )
    bad = [r["value"][:9] for r in bib.rejected(spark, str(tmp_path)).collect()]
    assert sorted(bad) == ["article{a", "article{b", "here},\n y"]
    with pytest.raises(ValueError):
        build_bib(spark, str(tmp_path / "*.bib"), str(tmp_path / "out"))
    assert build_bib(spark, str(tmp_path / "*.bib"), str(tmp_path / "out"), allow_rejected=True) == 1


def test_references_without_year_or_title(spark):
    entries = spark.createDataFrame([("a", "article", "Doe, J", None)], "ID string, entrytype string, author string, journal string")
    row = normalize_bib(entries).first()
    assert row["shortRef"] == "Doe-Doe,  - " and row["fullRef"] == "Doe J. .  -;-"


def test_a_long_value_is_one_field(spark, tmp_path):
    (tmp_path / "a.bib").write_text("@article{k,\n abstract = {" + "word {x} " * 40000 + "},\n year = 2000\n}\n")
    row = bib.read_entries(spark, str(tmp_path)).first()
    assert row["fields"]["abstract"] == "word {x} " * 40000 and row["fields"]["year"] == "2000"
