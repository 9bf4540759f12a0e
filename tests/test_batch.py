"""Batch search against one search per query."""

import re

import pytest
from helpers import library, record, table

from citeloom.operators import search
from citeloom.operators.batch import batch_search, typed_queries, rows_of
from citeloom.operators.clauses import And, Term, typed_text
from citeloom.operators.normalize import normalize
from citeloom.operators.postings import build_postings, vocabulary
from citeloom.plans import driver_view
from citeloom import session

SF = "/root/testdata/sf0.001"


def run(spark, recs, clauses, **options):
    got = batch_search(clauses, build_postings(recs), vocabulary(recs), **options)
    result = {}
    for query_id, rank, _id in table(got.orderBy("query_id", "rank"), "query_id", "rank", "_id"):
        result.setdefault(query_id, []).append(_id)
        assert len(result[query_id]) == rank
    return result


def test_typed_texts_equal_single_searches(spark):
    recs = normalize(driver_view.library(spark, SF)).cache()
    texts = ["the of", "the of", "thaned", "and the ", "nosuchword the", "--", "src1 th", "É", "the"]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    got = run(spark, recs, typed_queries(asked, "query_id", "text"))
    for i, text in enumerate(texts):
        clause = typed_text(text)
        expected = [] if clause is None else [r[0] for r in table(search.search(recs, clause), "_id")]
        assert got.get(i, []) == expected, text
    recs.unpersist()


CLAUSES = "query_id long, clause_no int, field string, term string, is_prefix boolean"


def test_fields_prefixes_and_limits(spark):
    recs = normalize(
        library(spark, *[record(f"r{i}", title=t, abstract=a, published={"year": str(2000 + i)})
                         for i, (t, a) in enumerate([("ab cd", "xy"), ("xy", "ab"), ("abc cd", "ab")])])
    )
    clauses = spark.createDataFrame(
        [(1, 0, "TITLE", "ab", False), (2, 0, None, "ab", False), (2, 1, None, "cd", False),
         (3, 0, "title", "a", True), (4, 0, "title", "ab", True), (4, 1, "abstract", "xy", False),
         (5, 0, None, "zz", True), (6, 0, None, "ab", False), (6, 1, None, "ab", False)],
        CLAUSES,
    )
    assert run(spark, recs, clauses) == {
        1: ["r0"], 2: ["r2", "r0"], 3: ["r2", "r0"], 4: ["r0"], 6: ["r2", "r1", "r0"],
    }
    assert run(spark, recs, clauses, limit=1) == {1: ["r0"], 2: ["r2"], 3: ["r2"], 4: ["r0"], 6: ["r2"]}


def test_unknown_field_fails(spark):
    recs = normalize(library(spark, record("a", title="x")))
    clauses = spark.createDataFrame([(1, 0, "nofield", "x", False)], CLAUSES)
    with pytest.raises(Exception, match="unknown field nofield"):
        run(spark, recs, clauses)


def test_salted_path_gives_the_same(spark, monkeypatch):
    recs = normalize(library(spark, *[record(f"r{i}", title=f"hot w{i % 7}") for i in range(60)])).cache()
    texts = ["hot ", "hot w1", "w", "hot hot w2 "]
    asked = spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")
    clauses = typed_queries(asked, "query_id", "text")
    plain = run(spark, recs, clauses)
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    salted = batch_search(clauses, build_postings(recs), vocabulary(recs))
    assert "salt" in salted._jdf.queryExecution().analyzed().toString()
    assert run(spark, recs, clauses, salts=5) == plain
    assert {i: len(v) for i, v in plain.items()} == {0: 60, 1: 9, 2: 60, 3: 9}
    recs.unpersist()


def test_small_batch_does_not_shuffle_the_postings(spark, tmp_path):
    recs = normalize(library(spark, record("a", title="x y")))
    asked = spark.createDataFrame([(1, "x y")], "query_id long, text string")
    large = build_postings(recs).select("term", "ord")
    small = session.stored(typed_queries(asked, "query_id", "text").select("term"), "terms")
    joined = session.salted_join(large, small, ["term"], "ord", 4)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and not re.search(r"Exchange hashpartitioning", plan)


def test_terms_are_folded_and_checked(spark):
    recs = normalize(library(spark, record("a", title="gene therapy"), record("b", title="other")))
    clauses = spark.createDataFrame([(1, 0, None, "Gene", False)], CLAUSES)
    assert run(spark, recs, clauses) == {1: ["a"]}
    for bad in ("gene therapy", "--", None):
        with pytest.raises(Exception, match="not one word"):
            run(spark, recs, spark.createDataFrame([(1, 0, None, bad, False)], CLAUSES))


def test_oldest_first_equal_ids_and_a_named_folder(spark, tmp_path):
    recs = normalize(library(spark, *[
        record("same" if i % 2 else None, title="gene " + ("ex" if i % 3 else "in"), published={"year": str(2000 + i)})
        for i in range(9)
    ]))
    clauses = spark.createDataFrame([(1, 0, None, "gene", False), (1, 1, None, "ex", True), (2, 0, None, "in", False)], CLAUSES)
    got = batch_search(
        clauses, build_postings(recs), vocabulary(recs), oldest_first=True, folder=str(tmp_path / "work")
    )
    years = {}
    for query_id, year in table(got.orderBy("query_id", "rank"), "query_id", "year"):
        years.setdefault(query_id, []).append(int(year) - 2000)
    assert years == {1: [1, 2, 4, 5, 7, 8], 2: [0, 3, 6]}
    assert (tmp_path / "work").exists()


def test_prefixes_meet_the_postings_as_asked(spark):
    rows = [(t, "title", f"r{i}") for i, t in enumerate(["ab", "abc", "b", "", "é1", "abé"])]
    lists = spark.createDataFrame(rows, "term string, col string, rec string")
    atoms = spark.createDataFrame(
        [(1, "ab", False), (2, "ab", True), (3, "a", True), (4, "é", True), (5, "abcd", True), (6, "abé", True)],
        "atom long, word string, is_prefix boolean",
    )
    known = [t for t, _, _ in rows]
    terms = spark.createDataFrame(
        [(a["atom"], t) for a in atoms.collect() for t in known
         if t == a["word"] or a["is_prefix"] and t.startswith(a["word"])], "atom long, term string",
    )
    for most in (0, 1, 2, 300):
        got = sorted((r["atom"], r["term"]) for r in rows_of(lists, atoms, terms, 2, most).collect())
        assert got == [
            (1, "ab"), (2, "ab"), (2, "abc"), (2, "abé"), (3, "ab"), (3, "abc"), (3, "abé"), (4, "é1"), (6, "abé"),
        ]
    narrow = rows_of(lists, atoms, terms, 2, 1)._jdf.queryExecution().analyzed().toString()
    assert "Generate" in narrow
