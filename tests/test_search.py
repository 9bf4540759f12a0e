"""Scan form = postings form = an independent full-text engine over the same rows."""

import random
import sqlite3

import pytest
from helpers import author, library, record, table

from citeloom.functions.tokens import fold, raw_words, split_words, words
from citeloom.operators import postings, search
from citeloom.operators.batch import batch_search
from citeloom.operators.clauses import (
    And, InScope, Near, Not, Or, Phrase, Term, leaves, required_words, row_predicate, typed_text,
)
from citeloom.operators.normalize import RECORD_COLUMNS, normalize
from citeloom.operators.postings import (
    build_postings, keep_rarest, keyed, matching_records, vocabulary,
)
from citeloom.plans import driver_view, queries
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"

# (full-text query, clause)
PAIRS = [
    ("the", Term("the")),
    ("The And", And(Term("The"), Term("and"))),
    ("than*", Term("than", prefix=True)),
    ("that th*", Term("that") & Term("th", prefix=True)),
    ("title:the", Term("the", "title")),
    ("LABEL:src1 the", Term("src1", "label") & Term("the")),
    ("label:interest*", Term("interest", "label", prefix=True)),
    ('"of the"', Phrase(("of", "the"))),
    ('"of th*"', Phrase(("of", "th"), prefix=True)),
    ('"the the"', Phrase(("the", "the"))),
    ('"j src1 res"', Phrase(("J", "src1", "Res"))),
    ("thanedble OR onwh", Term("thanedble") | Term("onwh")),
    ('"the that th*"', Phrase(("the", "that", "th"), prefix=True)),
    ("the NOT and", Not(Term("the"), Term("and"))),
    ("(der OR que) NOT (die AND und)", Not(Term("der") | Term("que"), Term("die") & Term("und"))),
    ("the NEAR of", Near(Term("the"), Term("of"))),
    ("the NEAR/0 of", Near(Term("the"), Term("of"), 0)),
    ("of NEAR/2 the", Near(Term("of"), Term("the"), 2)),
    ("der NEAR/3 die", Near(Term("der"), Term("die"), 3)),
    ("th* NEAR/1 an*", Near(Term("th", prefix=True), Term("an", prefix=True), 1)),
    ("the NEAR/4 the", Near(Term("the"), Term("the"), 4)),
    ("éoi*", Term("éoi", prefix=True)),
    ("É*", Term("É", prefix=True)),
    ("é*", Term("é", prefix=True)),
    ("year:1999 OR pmid:100012", Term("1999", "year") | Term("100012", "pmid")),
    ("type:pp type:article", Term("pp", "type") & Term("article", "type")),
    ("nosuchwordatall", Term("nosuchwordatall")),
]


@pytest.fixture(scope="module")
def corpus(spark):
    recs = normalize(driver_view.library(spark, SF)).cache()
    rows = table(recs, *RECORD_COLUMNS)
    db = sqlite3.connect(":memory:")
    db.execute(f"create virtual table r using fts3({', '.join(RECORD_COLUMNS)})")
    db.executemany(f"insert into r values ({', '.join('?' * len(RECORD_COLUMNS))})", rows)
    posts = build_postings(recs).cache()
    yield recs, posts, vocabulary(recs).cache(), db
    recs.unpersist()
    posts.unpersist()


@pytest.mark.parametrize("text,clause", PAIRS, ids=[p[0] for p in PAIRS])
def test_three_engines_agree(corpus, text, clause, monkeypatch):
    monkeypatch.setattr(postings, "MIN_HOT_ROWS", 0)
    recs, posts, known_words, db = corpus
    expected = {r[0] for r in db.execute("select _id from r where r match ?", (text,))}
    scan = table(search.match_records(recs, clause), "_id")
    assert len(scan) == len(set(scan))
    assert {r[0] for r in scan} == expected
    for words_table in (None, known_words):
        found = table(matching_records(posts, clause, words_table), "_id")
        assert len(found) == len(set(found))
        assert {r[0] for r in found} == expected


def small(spark, *titles):
    return normalize(library(spark, *[record(f"t{i}", title=t) for i, t in enumerate(titles)]))


def ids(df):
    return {r[0] for r in table(df, "_id")}


def both_forms(recs, clause):
    scan = ids(search.match_records(recs, clause))
    assert scan == ids(matching_records(build_postings(recs), clause))
    return scan


def test_words(spark):
    text = "GWAS_AD, Müller's 2020 MÜLLER 📜x"
    expected = ["gwas", "ad", "müller", "s", "2020", "mÜller", "📜x"]
    df = spark.createDataFrame([(text,)], ["t"])
    row = df.select(words(F.col("t")), F.transform(raw_words(F.col("t")), fold)).first()
    assert row[0] == row[1] == split_words(text) == expected


def test_no_accent_folding(spark):
    assert both_forms(small(spark, "MÜLLER", "Müller"), Term("müller")) == {"t1"}


def test_trailing_space_ends_the_word(spark):
    recs = small(spark, "genes here", "gene here")
    assert both_forms(recs, typed_text("gene")) == {"t0", "t1"}
    assert both_forms(recs, typed_text("gene ")) == {"t1"}


def test_typed_text_without_words_finds_nothing(spark):
    assert typed_text("  -- ") is None
    assert search.search(small(spark, "a"), None).count() == 0


def test_phrase_longer_than_text(spark):
    assert both_forms(small(spark, "one two"), Phrase(("one", "two", "three"))) == set()


def test_phrase_does_not_cross_columns(spark):
    recs = normalize(library(spark, record("x", title="alpha", abstract="beta")))
    assert both_forms(recs, Phrase(("alpha", "beta"))) == set()


def test_repeated_words_in_phrase(spark):
    recs = small(spark, "a b a c", "a b c", "b a b a")
    assert both_forms(recs, Phrase(("a", "b", "a"), "title")) == {"t0", "t2"}


@pytest.mark.parametrize("between,expected", [(9, {"t0"}), (10, {"t0"}), (11, set())])
def test_near_distance(spark, between, expected):
    recs = small(spark, "start " + "w " * between + "finish")
    assert both_forms(recs, Near(Term("finish"), Term("start"), field="title")) == expected


def test_near_needs_two_words(spark):
    assert both_forms(small(spark, "one", "one one"), Near(Term("one"), Term("one"), field="title")) == {"t1"}


def test_more_leaves_than_mask_bits(spark):
    many = [f"w{i}" for i in range(70)]
    recs = small(spark, " ".join(many), " ".join(many[:-1]))
    assert both_forms(recs, And(*[Term(w) for w in many])) == {"t0"}
    assert both_forms(recs, Or(*[Term(w) for w in reversed(many)])) == {"t0", "t1"}


@pytest.mark.parametrize(
    "bad",
    [lambda: Term("two words"), lambda: Term("\uffff"), lambda: Term(""), lambda: Term("x", "nofield"), lambda: Phrase(()),
     lambda: And(), lambda: Or(Term("a"), "b"), lambda: Not(Term("a"), None),
     lambda: Near(Term("a"), Phrase(("b", "c"))), lambda: Near(Term("a"), Term("b"), -1)],
)
def test_bad_clauses_raise_before_any_job(bad):
    with pytest.raises(ValueError):
        bad()


def test_scopes_are_exact(spark):
    recs = normalize(
        library(
            spark,
            record("a", labels=["11aa-22bb"], folders=["f"], pubtype="PP_JOURNAL_ARTICLE"),
            record("b", labels=["11aa"], folders=["f-2"], pubtype="PP_JOURNAL"),
        )
    )
    assert ids(search.in_label(recs, "11aa")) == {"b"}
    assert ids(search.in_folder(recs, "f")) == {"a"}
    assert ids(search.in_type(recs, "Journal article")) == {"a"}


def test_order_limit_and_display(spark):
    rows = [
        record(f"r{i}", title="hit", author=[author("Doe J", "Doe")], pmid=str(i), citekey="k",
               published={"year": str(1900 + i)} if i else None, labelsNamed=["l"], labels=["L"])
        for i in range(150)
    ]
    recs = normalize(library(spark, *rows))
    newest = table(search.search(recs, Term("hit")), "year")
    assert len(newest) == 99 and newest[0] == ("2049",) and newest == sorted(newest, reverse=True)
    oldest = table(search.search(recs, Term("hit"), oldest_first=True), "year")
    assert oldest[0] == ("-",) and oldest[1] == ("1901",)
    assert table(search.search(recs, Term("hit"), limit=200), "year")[-1] == ("-",)
    shown = search.result_rows(search.search(recs, Term("hit"))).orderBy("rank").first()
    assert shown["display"] == "1/99 Doe-Doe, - 2049 🏷l"
    assert (shown["citekey"], shown["shortPMID"]) == ("@k", "Doe-Doe, - 2049 149")
    from_postings = search.search_postings(build_postings(recs), recs, Term("hit"))
    assert table(from_postings, "year") == newest
    with pytest.raises(ValueError):
        search.search(recs, Term("hit"), limit=0)


def test_top_k_is_not_a_global_sort(spark):
    plan = search.search(small(spark, "a", "b"), Term("a"))._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


def test_vocabulary_counts(spark):
    recs = normalize(library(spark, record("x", title="go go stop"), record("y", title="go")))
    got = {r[0]: r[1:] for r in table(vocabulary(recs, ["title"]), "term", "n_occurrences", "n_records")}
    assert got == {"go": (3, 2), "stop": (1, 1)}


def test_rare_word_first_and_its_bound(spark, monkeypatch):
    recs = small(spark, "hot rare", "hot", "hot again")
    posts, known_words = build_postings(recs), vocabulary(recs)
    clause = Term("hot") & Term("rare")
    assert keep_rarest(posts, known_words, clause) is posts
    monkeypatch.setattr(postings, "MIN_HOT_ROWS", 2)
    assert required_words(clause | Term("x")) == []
    assert keep_rarest(posts, known_words, clause).select("ord").distinct().count() == 1
    assert keep_rarest(posts, known_words, Term("hot")) is posts
    assert keep_rarest(posts, known_words, Term("hot") & Term("absent")).count() == 0
    monkeypatch.setattr(postings, "MAX_RARE_ROWS", 0)
    assert keep_rarest(posts, known_words, clause) is posts


def test_leaves_are_distinct():
    assert leaves((Term("a") | Term("b")) & Not(Term("a"), Term("B"))) == [Term("a"), Term("b")]


def test_row_predicate_is_never_null(spark):
    df = spark.createDataFrame([(None,), ("x",)], "t string")
    assert df.filter(~row_predicate(Term("x"), ["t"])).count() == 1


def test_equal_and_missing_ids_are_records_of_their_own(spark):
    rows = [record("x", title="alpha"), record("x", title="beta"), record(None, title="gamma"),
            record(None, title="gamma delta"), record("y", title="alpha beta")]
    recs = normalize(library(spark, *rows))
    posts = build_postings(recs)

    def titles(clause):
        return sorted(r[0] for r in table(search.search_postings(posts, recs, clause), "title"))

    assert titles(Term("alpha") & Term("beta")) == ["alpha beta"]
    assert titles(Term("alpha")) == ["alpha", "alpha beta"]
    assert titles(Term("gamma")) == ["gamma", "gamma delta"]
    assert titles(Not(Term("gamma"), Term("delta"))) == ["gamma"]
    for clause in (Term("alpha") & Term("beta"), Term("gamma"), Phrase(("gamma", "delta"))):
        assert titles(clause) == sorted(r[0] for r in table(search.match_records(recs, clause), "title"))


def test_no_words_no_hits_in_either_form(spark):
    recs = small(spark, "a", "b")
    posts = build_postings(recs)
    assert typed_text("--") is None
    assert search.search(recs, None).count() == 0
    assert matching_records(posts, None).count() == 0
    assert search.search_postings(posts, recs, None, columns=["title"]).count() == 0


def test_top_hits_are_read_by_key(spark, tmp_path):
    path = str(tmp_path / "records")
    rows = [record(f"r{i}", title="hit" if i % 50 == 3 else "miss") for i in range(1000)]
    postings.keyed(normalize(library(spark, *rows)).repartition(4)).write.parquet(path)
    recs = spark.read.parquet(path)
    found = search.search_postings(build_postings(recs), recs, Term("hit"), limit=3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Or(EqualTo(rec," in plan.replace(" ", "") and "Join" not in plan
    expected = [(f"r{i}",) for i in range(3, 1000, 50)][:3]
    assert table(found, "_id") == table(search.search(recs, Term("hit"), limit=3), "_id")
    assert len(expected) == found.count()
    joined = search.search_postings(build_postings(recs), recs, Term("hit"), limit=search.FETCH_KEYS + 1)
    assert joined.count() == 20


def test_files_follow_the_rows(spark, tmp_path):
    recs = small(spark, *["some words of a title"] * 50)
    n = vocabulary(recs).agg({"n_occurrences": "sum"}).first()[0]
    postings.write_postings(build_postings(recs), str(tmp_path / "p"), n, rows_per_file=n // 20)
    assert len(list((tmp_path / "p").glob("*.parquet"))) >= 15
    assert spark.read.parquet(str(tmp_path / "p")).count() == n


def test_scopes_are_exact_in_both_forms(spark):
    rows = [
        record("a", title="hit", labels=["L1", "L1"], labelsNamed=["x", "x"], folders=["F"]),
        record("b", title="hit", labels=["L11", None], labelsNamed=["y", "z"]),
        record("c", title="miss", labels=["L1"], labelsNamed=["x"], pubtype="PP_BOOK,PP_REVIEW"),
        record("d", title="hit", pubtype="PP_REVIEW"),
    ]
    recs = normalize(library(spark, *rows))
    posts = build_postings(recs).unionByName(postings.scope_postings(recs))
    known_words = postings.with_scopes(vocabulary(recs), recs)
    cases = {
        InScope("label", "L1") & Term("hit"): {"a"}, InScope("label", "L"): set(),
        InScope("folder", "F"): {"a"}, InScope("type", "Review"): {"c", "d"},
        Not(Term("hit"), InScope("label", "L1")): {"b", "d"},
        InScope("type", "Book") | InScope("folder", "F"): {"a", "c"},
    }
    for clause, expected in cases.items():
        assert ids(search.match_records(recs, clause)) == expected
        assert ids(matching_records(posts, clause, known_words)) == expected
    asked = [(1, "@label", "L1"), (1, None, "hit"), (2, "@type", "Review"), (3, "@label", "l1")]
    clauses = spark.createDataFrame(
        [(q, i, f, t, False) for i, (q, f, t) in enumerate(asked)],
        "query_id long, clause_no int, field string, term string, is_prefix boolean",
    )
    got = batch_search(clauses, posts, known_words)
    assert set(table(got, "query_id", "_id")) == {(1, "a"), (2, "c"), (2, "d")}
    with pytest.raises(ValueError):
        InScope("author", "x")


def test_result_rows_of_equal_ids_keep_record_order(spark):
    recs = keyed(normalize(library(spark, *[record("same", title=f"word {i}") for i in range(9)])))
    equal = recs.withColumn("ord", F.lit("k")).cache()
    got = search.result_rows(search.search(equal, typed_text("word")))
    assert [r["title"] for r in got.orderBy("rank").collect()] == [f"word {i}" for i in range(9)]
    post = build_postings(equal)
    got = search.result_rows(search.search_postings(post, equal, typed_text("word")))
    assert [r["title"] for r in got.orderBy("rank").collect()] == [f"word {i}" for i in range(9)]


def test_whole_texts_are_searched(spark):
    """A word that stands only late in a document whose doc_id is a multiple of six."""
    sf = "/root/testdata/sf0.001"
    doc = spark.read.parquet(f"{sf}/documents.parquet").filter(
        "doc_id % 6 = 0 and doc_id % 13 <> 0 and length(text) > 300"
    ).orderBy("doc_id").first()
    late = max(split_words(doc["text"][200:]), key=len)
    assert late not in split_words(doc["text"][:80])
    found = search.search(queries.stored_records(spark, sf), Term(late), limit=1000)
    assert f"d{doc['doc_id']}" in [r["_id"] for r in found.collect()]
    found = matching_records(queries.stored_postings(spark, sf), Term(late))
    assert f"d{doc['doc_id']}" in [r["_id"] for r in found.collect()]


def test_position_lists_explode_to_postings(spark):
    recs = keyed(normalize(driver_view.library(spark, SF))).cache()
    lists = postings.position_lists(recs)
    names = ["term", "col", "pos", *postings.RECORD_KEY]
    assert lists.groupBy("term", "col", "rec").count().filter("count > 1").isEmpty()
    one, two = (df.select(*names) for df in (postings.occurrences(lists), build_postings(recs)))
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    none = postings.position_lists(normalize(library(spark, record("x", title="", abstract=None))), ["title", "abstract"])
    assert none.count() == 0


LIST_CLAUSES = [
    Phrase(("of", "the")), Phrase(("a", "a", "b")), Phrase(("a", "b"), prefix=True), Phrase(("a", "a"), prefix=True),
    Near(Term("a"), Term("b"), 1), Near(Term("a"), Term("a"), 0), Near(Term("a", prefix=True), Term("ab"), 2),
    Near(Term("ab"), Term("a", prefix=True), 0), Near(Term("c"), Term("a"), 3),
    Not(Near(Term("a"), Term("b"), 0), Phrase(("b", "a"))) | Term("zz"),
]


@pytest.mark.parametrize("clause", LIST_CLAUSES)
def test_merged_lists_equal_occurrences(spark, clause):
    rng = random.Random(7)
    words_ = ["a", "b", "ab", "abc", "c", "of", "the"]
    recs = keyed(normalize(library(spark, *[
        record(f"r{i}", title=" ".join(rng.choices(words_, k=rng.randint(1, 7))),
               abstract=" ".join(rng.choices(words_, k=rng.randint(0, 6)))) for i in range(150)
    ]))).cache()
    one = matching_records(postings.position_lists(recs), clause)
    two = matching_records(build_postings(recs), clause)
    assert sorted(table(one, "rec")) == sorted(table(two, "rec"))
    assert 0 < one.count() < 150


@pytest.mark.parametrize("oldest_first", [False, True])
def test_bands_stop_early_with_the_same_hits(spark, tmp_path, oldest_first):
    rows = [record(f"r{i:04}", title="hot " + ("cold" if i % 50 == 0 else f"w{i}"),
                   published=None if i % 97 == 0 else {"year": str(1900 + i % 90)}) for i in range(2500)]
    recs = keyed(normalize(library(spark, *rows))).cache()
    path = str(tmp_path / "p")
    postings.write_postings(postings.position_lists(recs), path, 20_000)
    lists = spark.read.parquet(path)
    bands = postings.band_counts(lists, 1000)
    assert {r["term"] for r in bands.select("term").distinct().collect()} >= {"hot"}
    for clause in (Term("hot"), Term("hot") & Term("hot", "title"), Not(Term("hot"), Term("cold")), Term("hot") | Term("cold")):
        want = search.search_postings(lists, recs, clause, 20, oldest_first)
        got = search.search_postings(lists, recs, clause, 20, oldest_first, bands=bands)
        assert table(got, "rec") == table(want, "rec")
    cuts = postings.year_cuts(bands, Term("hot"), 20, oldest_first)
    near = F.col("year") <= cuts[0] if oldest_first else F.col("year") >= cuts[0]
    read = lists.filter((F.col("term") == "hot") & near).count()
    assert 80 <= read < 250  # of 2500 rows, however many there are
    assert postings.year_cuts(bands, Term("hot") & Term("cold"), 20) == []


def test_a_record_lies_in_one_segment(spark, tmp_path):
    rows = [record(f"r{i}", title=f"hot word{i}", labels=["L", "L", None], folders=["F"] if i % 2 else None)
            for i in range(200)]
    path = str(tmp_path / "recs")
    keyed(normalize(library(spark, *rows))).write.parquet(path)
    recs = spark.read.parquet(path)
    want = postings.position_lists(recs).unionByName(postings.scope_lists(recs))
    counts = postings.with_scopes(vocabulary(recs), recs)
    postings.write_lists(recs, str(tmp_path / "p"), 200, rows_per_file=10)
    lists = spark.read.parquet(str(tmp_path / "p"))
    assert lists.schema.names == want.schema.names
    assert lists.exceptAll(want).isEmpty() and want.exceptAll(lists).isEmpty()
    placed = lists.select("rec", F.input_file_name().alias("file")).distinct()
    assert placed.count() == 200 and placed.select("file").distinct().count() > 10
    plan = postings.record_lists(recs.repartition(20, "rec"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    narrow = postings.band_counts(lists, 150, vocabulary=counts)
    assert sorted(table(narrow, "term", "n_rows")) == sorted(table(postings.band_counts(lists, 150), "term", "n_rows"))
