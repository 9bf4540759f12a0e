"""Batches of condition trees against one search per tree."""

import random

import pytest
from helpers import library, record, table

from citeloom import session
from citeloom.operators import batch_trees as trees_module
from citeloom.operators import search
from citeloom.operators.batch_trees import NODES, batch_trees, tree_rows
from citeloom.operators.clauses import And, InScope, Near, Not, Or, Phrase, Term
from citeloom.operators.normalize import normalize
from citeloom.operators.postings import position_lists, scope_lists, vocabulary, with_scopes
from citeloom.plans import driver_view

SF = "/root/testdata/sf0.001"


def run(spark, recs, nodes, **options):
    lists = position_lists(recs).unionByName(scope_lists(recs))
    got = batch_trees(nodes, lists, with_scopes(vocabulary(recs), recs), **options)
    result = {}
    for query_id, rank, _id in table(got.orderBy("query_id", "rank"), "query_id", "rank", "_id"):
        result.setdefault(query_id, []).append(_id)
        assert len(result[query_id]) == rank
    return result


def asked(spark, clauses):
    rows = [row for i, clause in enumerate(clauses) for row in tree_rows(i, clause)]
    return spark.createDataFrame(rows, NODES)


def check(spark, recs, clauses, **options):
    got = run(spark, recs, asked(spark, clauses), **options)
    for i, clause in enumerate(clauses):
        expected = [] if clause is None else [r[0] for r in table(search.search(recs, clause), "_id")]
        assert got.get(i, []) == expected, clause


MIXED = [
    Phrase(("of", "the")) & Phrase(("and", "th"), prefix=True),
    Term("thanedble") | Phrase(("onwh", "the")),
    Not(Term("that") | Term("der"), Term("the") & Term("of")),
    Near(Term("thanedble"), Term("the"), 3) | Near(Term("der"), Term("die")),
    And(Or(Term("the", "title"), Term("an", "title", True)), Term("src1", "LABEL"), InScope("type", "Journal article")),
    Not(InScope("label", "L-src1"), Near(Term("the"), Term("the"), 2)),
    Phrase(("the", "the")), Term("the"), Term("nosuchword") | Term("the"), Term("nosuchword") & Term("the"),
    Not(Term("the"), Term("nosuchword")), Term("the"), None,
]


def test_mixed_trees_equal_single_searches(spark):
    recs = normalize(driver_view.library(spark, SF)).cache()
    check(spark, recs, MIXED)
    recs.unpersist()


def some_tree(pick, depth):
    words = ["a", "b", "ab", "abc", "hot", "zz"]
    if depth == 0 or pick.random() < 0.2:
        field = pick.choice([None, None, "title", "abstract"])
        kind = pick.random()
        if kind < 0.4:
            return Term(pick.choice(words), field, pick.random() < 0.3)
        if kind < 0.6:
            return Phrase(tuple(pick.choices(words, k=pick.randint(2, 3))), field, pick.random() < 0.3)
        if kind < 0.8:
            return Near(Term(pick.choice(words)), Term(pick.choice(words), prefix=pick.random() < 0.3), pick.randint(0, 2), field)
        return InScope("label", pick.choice(["L0", "L1", "none"]))
    parts = [some_tree(pick, depth - 1) for _ in range(pick.randint(2, 3))]
    return pick.choice([And(*parts), Or(*parts), Not(*parts[:2])])


def some_records(spark, pick):
    words = ["a", "b", "ab", "abc", "hot", "hot"]
    return normalize(library(spark, *[
        record(f"r{i}", title=" ".join(pick.choices(words, k=4)), labels=[f"L{i % 3}"], labelsNamed=[f"l{i % 3}"],
               abstract=None if i % 5 == 0 else " ".join(pick.choices(words, k=pick.randint(0, 9))),
               published={"year": str(2000 + i % 7)})
        for i in range(40)
    ]))


def test_random_trees_equal_single_searches(spark, monkeypatch):
    pick = random.Random(5)
    recs = some_records(spark, pick).cache()
    trees = [some_tree(pick, i % 4) for i in range(36)]
    check(spark, recs, trees)
    monkeypatch.setattr(session, "BROADCAST_BYTES", -1)
    check(spark, recs, trees[:12], salts=3)
    recs.unpersist()


@pytest.mark.parametrize("oldest_first", [False, True])
def test_rounds_of_years_equal_single_searches(spark, monkeypatch, oldest_first):
    monkeypatch.setattr(trees_module, "WHOLE_ROWS", 0)
    monkeypatch.setattr(trees_module, "MOST_TERMS", 0)
    monkeypatch.setattr(trees_module, "NAMED_ROWS", 0)
    pick = random.Random(9)
    recs = some_records(spark, pick).cache()
    trees = [some_tree(pick, i % 4) for i in range(24)] + [Or(Phrase(("a", "zz")), Phrase(("hot", "abc")))]
    got = run(spark, recs, asked(spark, trees), limit=2, oldest_first=oldest_first)
    for i, tree in enumerate(trees):
        single = search.search(recs, tree, limit=2, oldest_first=oldest_first)
        assert got.get(i, []) == [r[0] for r in table(single, "_id")], tree
    recs.unpersist()


def test_a_tree_with_enough_matches_reads_no_more_years(spark, monkeypatch):
    monkeypatch.setattr(trees_module, "WHOLE_ROWS", 0, raising=False)
    recs = normalize(library(spark, *[
        record(f"r{i}", title="gene ex", published={"year": str(1900 + i % 40)}) for i in range(400)
    ]))
    candidates, plain = [], trees_module.stored

    def spy(rows, name, folder=None):
        written = plain(rows, name, folder)
        if name == "candidates":
            candidates.append(written.count())
        return written

    monkeypatch.setattr(trees_module, "stored", spy)
    nodes = asked(spark, [Phrase(("gene", "ex")), Phrase(("gene", "none")) | Phrase(("ex", "gene"))])
    got = run(spark, recs, nodes, limit=2)
    assert got == {0: ["r39", "r79"]}
    # The first tree takes one year of ten records, the other one all 400.
    assert sum(candidates) == 410


def test_limits_order_and_equal_ids(spark):
    recs = normalize(library(spark, *[
        record("same" if i % 2 else None, title="gene ex", published={"year": str(2000 + i)}) for i in range(6)
    ]))
    nodes = asked(spark, [Phrase(("gene", "ex")) | Term("none"), Phrase(("gene", "ex")) | Term("none")])
    lists, words = position_lists(recs), vocabulary(recs)
    got = batch_trees(nodes, lists, words, limit=2, oldest_first=True)
    assert sorted(table(got, "query_id", "rank", "year")) == [
        (0, 1, "2000"), (0, 2, "2001"), (1, 1, "2000"), (1, 2, "2001")
    ]


def test_a_deep_tree_needs_few_bits(spark):
    recs = normalize(library(spark, record("x", title="a b")))
    tree = Term("a")
    for _ in range(100):
        tree = Or(Term("zz"), And(Term("b"), tree))
    check(spark, recs, [tree])


def test_empty_tables_and_missing_values(spark):
    recs = normalize(library(spark, record("x", title="gene therapy")))
    assert run(spark, recs, spark.createDataFrame([], NODES)) == {}
    rows = [(None, 0, "phrase", None, [("gene", False)], None), (2, 0, "PHRASE", None, [("Gene", None)], None),
            (3, 0, "near", "Title", [("therapy", False), ("gene", False)], None)]
    assert run(spark, recs, spark.createDataFrame(rows, NODES)) == {2: ["x"], 3: ["x"]}
    nothing = normalize(library(spark, record("y", title="z", incomplete=1)))
    assert run(spark, nothing, spark.createDataFrame(rows, NODES)) == {}


@pytest.mark.parametrize("rows, message", [
    ([("phrase", None, [("gene therapy", False)], None)], "not one word"),
    ([("phrase", "nofield", [("gene", False)], None)], "unknown field nofield"),
    ([("near", None, [("gene", False)], None)], "malformed leaf"),
    ([("near", None, [("a", False), ("b", False)], -1)], "malformed leaf"),
    ([("phrase", None, None, None)], "malformed leaf"),
    ([("xor", None, [("gene", False)], None)], "malformed leaf"),
    ([("phrase", None, [("gene", False)], None), ("and", None, None, None)], "malformed tree"),
    ([("phrase", None, [("gene", False)], None)] * 2, "malformed tree"),
    ([("phrase", None, [("gene", False)], None)] * 61 + [("or", None, None, None)] * 60, "malformed tree"),
])
def test_malformed_trees_fail(spark, rows, message):
    recs = normalize(library(spark, record("x", title="gene therapy")))
    nodes = spark.createDataFrame([(1, i, *row) for i, row in enumerate(rows)], NODES)
    with pytest.raises(Exception, match=message):
        run(spark, recs, nodes)
