"""A refresh of some files against a full build of all."""

import json
import os

import pytest
from helpers import record, table

from citeloom.operators import search
from citeloom.operators.clauses import Phrase, Term
from citeloom.plans import delta
from citeloom.plans.build import build_library
from citeloom.sources import store

TABLES = {
    "label_facet": ("label", "total", "label_id", "summary", "first_ord"),
    "folder_facet": ("folder", "total", "folder_id", "summary", "first_ord"),
    "type_facet": ("type", "total", "first_ord"),
    "vocabulary": ("term", "n_occurrences", "n_records"),
    "postings": ("term", "col", "positions", "_id", "year"),
    "records": ("_id", "title", "label", "folder", "year"),
}


def put(folder, name, *records, at=1_700_000_000):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(r) + "\n" for r in records))
    os.utime(folder / name, (at, at))


def paper(i, title, *labels):
    return record(f"r{i:02}", title=title, labelsNamed=list(labels), labels=[f"{label}-{i}" for label in labels],
                  foldersNamed=["f"], folders=[f"F{i}"], published={"year": str(2000 + i)})


def content(open_table):
    return {name: sorted(map(str, table(open_table(name), *columns))) for name, columns in TABLES.items()}


def same_as_full_build(spark, source, root, full):
    build_library(spark, str(source), str(full))
    live = content(lambda name: delta.open_live(spark, str(root), name))
    assert live == content(lambda name: store.open_table(spark, str(full), name))
    return live


def test_changed_removed_and_new_files(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "lib"
    put(source, "a.json", paper(1, "gene one", "x", "y"), paper(2, "gene two", "x"))
    put(source, "b [1] {é}*.json", paper(3, "cell", "x"), paper(4, "cell gene", "z"))
    put(source, "c d.json", paper(5, "old", "x"), paper(6, "old gene", "y"))
    for i, name in enumerate(["e.json", "g.json", "h.json"]):
        put(source, name, paper(9 + i, "last gene", "y"))
    assert delta.refresh_library(spark, str(source), str(root)) == 1
    assert delta.refresh_library(spark, str(source), str(root)) == 1

    put(source, "b [1] {é}*.json", paper(3, "cells", "w"), paper(7, "new gene", "x"), at=1_700_000_100)
    (source / "c d.json").unlink()
    put(source, "f.json", paper(8, "more gene words", "x"))
    assert delta.refresh_library(spark, str(source), str(root)) == 2
    same_as_full_build(spark, source, root, tmp_path / "full2")
    # The part holds the files that were read, no others.
    part = spark.read.parquet(store.current(spark, str(root)).path("records"))
    assert sorted(table(part, "_id")) == [("r03",), ("r07",), ("r08",)]
    recs, lists = (delta.open_live(spark, str(root), n) for n in ("records", "postings"))
    words = delta.open_live(spark, str(root), "vocabulary")
    for clause in (Term("gene"), Term("old"), Phrase(("new", "gene")), Term("gene") & Term("x", "label")):
        got = table(search.search_postings(lists, recs, clause, vocabulary=words), "_id")
        assert got == table(search.search(recs, clause), "_id")
    assert table(recs.groupBy("rec").count().filter("count > 1"), "rec") == []

    # The first seen id of a label goes with its file; a removal alone writes no part.
    (source / "a.json").unlink()
    assert delta.refresh_library(spark, str(source), str(root)) == 3
    assert not os.path.exists(store.current(spark, str(root)).path("records"))
    live = same_as_full_build(spark, source, root, tmp_path / "full3")
    assert any("x-7" in row for row in live["label_facet"])


def test_many_parts_are_put_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(delta, "MOST_PARTS", 2)
    source, root = tmp_path / "in", tmp_path / "lib"
    for i in range(3):
        put(source, f"{i}.json", paper(i, f"t{i}", "x"))
        assert delta.refresh_library(spark, str(source), str(root)) == i + 1
    manifest = spark.read.parquet(store.current(spark, str(root)).path("manifest"))
    assert manifest.select("part").distinct().count() == 1
    same_as_full_build(spark, source, root, tmp_path / "full")


def test_broken_lines_and_empty_files(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "lib"
    put(source, "a.json", paper(1, "one", "x"))
    put(source, "empty.json")
    assert delta.refresh_library(spark, str(source), str(root)) == 1
    (source / "b.json").write_text('{"broken\n' + json.dumps(paper(2, "two", "x")) + "\n")
    with pytest.raises(ValueError, match="no record"):
        delta.refresh_library(spark, str(source), str(root))
    assert table(delta.open_live(spark, str(root), "records"), "_id") == [("r01",)]
    assert delta.refresh_library(spark, str(source), str(root), allow_rejected=True) == 2
    assert sorted(table(delta.open_live(spark, str(root), "records"), "_id")) == [("r01",), ("r02",)]
    with pytest.raises(ValueError, match="nothing published"):
        delta.open_live(spark, str(tmp_path / "none"), "records")
