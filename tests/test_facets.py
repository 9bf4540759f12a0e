from helpers import library, record, table

from pyspark.sql import functions as F

from citeloom.operators import facets
from citeloom.operators.clauses import row_predicate, typed_text
from citeloom.operators.normalize import normalize


def records(spark, *rows):
    return normalize(library(spark, *rows))


def labelled(_id, names, ids, pubtype="PP_ARTICLE", **more):
    return record(_id, labelsNamed=names, labels=ids, pubtype=pubtype, **more)


def test_counts_ids_and_summary(spark):
    recs = records(
        spark,
        labelled("a", ["x", "y"], ["1", "2"]),
        labelled("b", ["y", "x"], ["9", "8"], "PP_BOOK"),
        labelled("c", ["x"], ["7"], "PP_BOOK"),
        labelled("d", ["x"], ["7"], "PP_REVIEW"),
        labelled("e", ["x"], ["7"], kind="Review"),
        record("f"),
    )
    got = table(facets.most_used_first(facets.label_facet(recs)), "label", "total", "label_id", "summary")
    assert got == [
        ("x", 5, "1", "book (2) review (2) article (1) "),
        ("y", 2, "2", "article (1) book (1) "),
    ]


def test_label_twice_on_one_record_counts_twice_and_keeps_first_id(spark):
    got = table(facets.label_facet(records(spark, labelled("a", ["x", "x"], ["1", "2"]))), "total", "label_id")
    assert got == [(2, "1")]


def test_label_with_comma_is_one_label(spark):
    got = table(facets.label_facet(records(spark, labelled("a", ["a,b"], ["1"]))), "label")
    assert got == [("a,b",)]


def test_no_folders_anywhere(spark):
    assert facets.folder_facet(records(spark, record("a"), record("b"))).count() == 0


def test_record_without_type_counts_in_the_total_only(spark):
    got = table(facets.label_facet(records(spark, labelled("a", ["x"], ["1"], None))), "total", "summary")
    assert got == [(1, "")]


def test_types_merge_by_display_form(spark):
    recs = records(
        spark, record("a", pubtype="PP_REVIEW"), record("b", kind="Review"),
        record("c", pubtype="PP_JOURNAL_ARTICLE,PP_BOOK"),
    )
    got = table(facets.most_used_first(facets.type_facet(recs)), "type", "total")
    assert got[0] == ("Review", 2)
    assert set(got[1:]) == {("Journal article", 1), ("Book", 1)}


def test_pivot_has_zeros(spark):
    recs = records(spark, labelled("a", ["x"], ["1"]), labelled("b", ["y"], ["2"], "PP_BOOK"))
    got = facets.facet_pivot(recs, "labelsNamed", "labels", ["PP_ARTICLE", "PP_BOOK"])
    assert set(table(got, "name", "PP_ARTICLE", "PP_BOOK")) == {("x", 1, 0), ("y", 0, 1)}


def test_display_and_name_search(spark):
    recs = records(spark, labelled("a", ["GWAS_AD", "other"], ["1", "2"]))
    facet = facets.label_facet(recs)
    hit = facet.filter(row_predicate(typed_text("ad"), ["label"]))
    assert table(facets.facet_display(hit, "label", "label_id"), "display", "subtitle", "scope_id") == [
        ("GWAS_AD (1)", "article (1) ", "1")
    ]


def test_hot_label_travels_as_one_row_per_task_and_type(spark):
    """An aggregate stands before each exchange, and none is keyed by the id."""
    plan = facets.label_facet(records(spark, labelled("a", ["x"], ["1"])))
    lines = plan._jdf.queryExecution().executedPlan().toString().splitlines()
    at = [i for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
    assert len(at) == 2
    assert all("functions=[partial_" in lines[i + 1] for i in at)
    assert not any("id#" in lines[i].split("ENSURE")[0] for i in at)


def test_one_label_of_very_many_ids(spark):
    rows = [labelled(f"r{i}", ["hot"], [f"id{i}"], "PP_BOOK" if i % 4 else "PP_ARTICLE") for i in range(10_000)]
    got = table(facets.label_facet(records(spark, *rows)), "label", "total", "label_id", "summary")
    assert got == [("hot", 10_000, "id0", "book (7500) article (2500) ")]


def test_pivot_counts_every_type_that_occurs(spark):
    recs = records(spark, labelled("a", ["x"], ["1"], kind="Commentary"), labelled("b", ["x"], ["1"]))
    got = facets.facet_pivot(recs, "labelsNamed", "labels")
    assert table(got, "name", "Commentary", "PP_ARTICLE") == [("x", 1, 1)]


def test_ids_and_order_of_records_without_order_key(spark):
    recs = normalize(library(
        spark, labelled(None, ["b", "x"], ["9", "1"]), labelled(None, ["x", "a"], ["1", "8"])
    )).withColumn("ord", F.lit(None).cast("long"))
    facet = facets.most_used_first(facets.label_facet(recs))
    assert table(facet, "label", "total", "label_id", "first_ord") == [
        ("x", 2, "1", None), ("a", 1, "8", None), ("b", 1, "9", None),
    ]


def test_first_id_of_equal_order_keys_is_defined(spark):
    recs = normalize(library(spark, *[labelled("same", ["x"], [str(i)]) for i in (5, 3, 4)]))
    equal = recs.withColumn("ord", F.lit("k"))
    assert facets.label_facet(equal.repartition(3)).first()["label_id"] == "3"
    by_rec = equal.withColumn("rec", F.concat(F.lit("r"), F.expr("10 - cast(labelID as int)")))
    assert facets.label_facet(by_rec.repartition(3)).first()["label_id"] == "5"
