import json
import os

import pytest
from helpers import table

from citeloom.operators.refresh import changed_files, file_status
from citeloom.plans.build import build_library
from citeloom.sources import library, raw, store
from citeloom.streaming.ingest import (
    ingest_new_files, ingested_facet, ingested_types, ingested_vocabulary, open_ingested,
)
from citeloom.operators import facets, search
from citeloom.operators.batch import batch_search, typed_queries
from citeloom.operators.clauses import Term
from citeloom.operators.postings import vocabulary, with_scopes


def rec(i, **more):
    return {"_id": f"r{i}", "incomplete": 0, "title": f"Title {i}", "pubtype": "PP_ARTICLE",
            "labelsNamed": ["x", f"y{i}"], "labels": ["1", f"2{i}"], "attachments": [], **more}


def write_lines(path, *records):
    path.write_text("".join(json.dumps(r) + "\n" for r in records))


@pytest.fixture()
def source(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    write_lines(folder / "a.json", rec(1), rec(2, incomplete=1), rec(3, incomplete=True))
    write_lines(folder / "b.json", rec(4, published={"year": "2001"}, extra={"k": [1]}))
    return folder


def test_build_skips_rebuilds_and_keeps_the_last_good_version(spark, source, tmp_path, monkeypatch):
    root = str(tmp_path / "lib")
    assert store.current_version(spark, root) == 0
    with pytest.raises(ValueError):
        store.open_table(spark, root, "records")
    assert build_library(spark, str(source), root) == 1
    assert set(table(store.open_table(spark, root, "records"), "_id")) == {("r1",), ("r4",)}
    assert build_library(spark, str(source), root) == 1
    write_lines(source / "c.json", rec(5))
    assert build_library(spark, str(source), root) == 2
    facet = facets.most_used_first(store.open_table(spark, root, "label_facet"))
    assert table(facet, "label", "total", "label_id")[0] == ("x", 3, "1")
    postings = store.open_table(spark, root, "postings")
    assert postings.filter("term = 'title' and col = 'title'").count() == 3
    os.utime(source / "a.json", (1, 1))
    with monkeypatch.context() as broken:
        broken.setattr(facets, "type_facet", lambda records: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            build_library(spark, str(source), root)
    assert store.current_version(spark, root) == 2
    assert build_library(spark, str(source), root) == 3
    (source / "c.json").unlink()
    assert build_library(spark, str(source), root) == 4
    assert store.open_table(spark, root, "records").count() == 2


def test_file_status(spark):
    schema = "path string, t long"

    def listing(*rows):
        return spark.createDataFrame(rows, schema).selectExpr("path", "timestamp_seconds(t) as mtime")

    now = listing(("same", 10), ("later", 11), ("earlier", 9), ("new", 1))
    seen = listing(("same", 10), ("later", 10), ("earlier", 10), ("gone", 1))
    assert dict(table(file_status(now, seen), "path", "status")) == {
        "same": "same", "later": "changed", "earlier": "changed", "new": "new", "gone": "removed",
    }
    assert changed_files(now, seen).count() == 4


def test_array_files_keep_position_and_convert_to_lines(spark, tmp_path):
    folder = tmp_path / "arrays"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([rec(2, extra=1), rec(1)], indent=2))
    (folder / "b.json").write_text(json.dumps([rec(0)]))
    read = library.read_arrays(spark, str(folder))
    assert table(read.orderBy("ord"), "_id") == [("r2",), ("r1",), ("r0",)]
    target = str(tmp_path / "lines")
    library.array_to_lines(spark, str(folder), target)
    assert {r[0] for r in table(library.read_lines(spark, target), "_id")} == {"r0", "r1", "r2"}
    assert "extra" in raw.raw_import(spark, target).columns
    version = build_library(spark, str(folder), str(tmp_path / "lib"), read=library.read_arrays)
    facet = store.open_table(spark, str(tmp_path / "lib"), "label_facet")
    assert version == 1 and table(facet.filter("label = 'x'"), "total") == [(3,)]


@pytest.mark.parametrize("indent", [2, 4])
def test_indented_arrays_are_read_in_splits(spark, tmp_path, indent):
    folder = tmp_path / "arrays"
    folder.mkdir()
    records = [rec(i, author=[{"formatted": "A B", "last": "A"}, {"formatted": "}, {"}],
                   abstract="x\n  {\n    { [1],\n]", extra={"deep": [{"a": 1}, []]}) for i in range(60)]
    (folder / "a.json").write_text(json.dumps(records[:59], indent=indent))
    (folder / "b.json").write_text(json.dumps(records[59:], indent=indent) + "\n")
    (folder / "c.json").write_text("[\n]\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        read = library.read_indented(spark, str(folder), indent)
        assert read.rdd.getNumPartitions() > 5
        got = {r["_id"]: r for r in read.collect()}
        target = str(tmp_path / "lines")
        library.array_to_lines(spark, str(folder), target, indent)
        lines = [json.loads(r["value"]) for r in spark.read.text(target).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(got) == 60 and got["r7"]["abstract"] == records[7]["abstract"]
    assert got["r0"]["author"][1]["formatted"] == "}, {"
    assert sorted(lines, key=lambda r: int(r["_id"][1:])) == records


def test_raw_import_and_export_keep_every_key(spark, source, tmp_path):
    wide = raw.raw_import(spark, str(source))
    assert wide.columns == sorted({"extra", "published", *rec(0)})
    row = wide.filter("_id = 'r4'").first()
    assert (row["extra"], row["published"], row["incomplete"]) == ('{"k":[1]}', '{"year":"2001"}', "0")
    assert wide.filter("_id = 'r1'").first()["extra"] is None
    lines = raw.read_raw(spark, str(source)).selectExpr("value", "get_json_object(value, '$._id') as id")
    census = {r["key"]: (r["n_records"], r["first_ord"]) for r in raw.key_census(lines, ord_col="id").collect()}
    assert census["extra"] == (1, "r4") and census["title"] == (4, "r1")
    maps = raw.as_text_map(raw.read_raw(spark, str(source))).filter("fields['_id'] = 'r4'")
    assert maps.first()["fields"]["extra"] == '{"k":[1]}'
    target = str(tmp_path / "out")
    library.export_label(spark, str(source), "y4", target)
    assert [json.loads(r["value"]) for r in spark.read.text(target).collect()] == [
        rec(4, published={"year": "2001"}, extra={"k": [1]})
    ]


def test_union_of_unlike_schemas(spark):
    a = spark.createDataFrame([(1, "x")], "k long, a string")
    b = spark.createDataFrame([(2, [1, 2], {"z": 1.5})], "k long, b array<int>, m map<string,double>")
    rows = {r["k"]: r.asDict() for r in raw.union_schema(a, b).collect()}
    assert rows == {
        "1": {"k": "1", "a": "x", "b": None, "m": None},
        "2": {"k": "2", "a": None, "b": "[1,2]", "m": '{"z":1.5}'},
    }


def test_incremental_ingest_equals_a_full_pass(spark, source, tmp_path):
    root, checkpoint = str(tmp_path / "live"), str(tmp_path / "ck")
    assert open_ingested(spark, root, "records") is None
    with pytest.raises(ValueError):
        ingested_facet(spark, root)
    ingest_new_files(spark, str(source), root, checkpoint, files_per_batch=1).awaitTermination()
    write_lines(source / "c.json", rec(5), rec(6))
    ingest_new_files(spark, str(source), root, checkpoint).awaitTermination()
    ingest_new_files(spark, str(source), root, checkpoint).awaitTermination()
    records = open_ingested(spark, root, "records")
    assert sorted(table(records, "_id")) == [("r1",), ("r4",), ("r5",), ("r6",)]
    assert records.select("batch").distinct().count() == 3
    live = ingested_facet(spark, root)
    full = facets.label_facet(records)
    assert sorted(table(live, "name", "total", "id", "summary")) == sorted(
        table(full, "label", "total", "label_id", "summary")
    )
    assert open_ingested(spark, root, "postings").filter("term = 'title'").count() > 0
    assert sorted(table(ingested_types(spark, root), "type", "total")) == sorted(
        table(facets.type_facet(records), "type", "total")
    )
    words = ingested_vocabulary(spark, root)
    assert sorted(map(tuple, words.collect())) == sorted(
        map(tuple, with_scopes(vocabulary(records), records).collect())
    )
    asked = spark.createDataFrame([(1, "title")], "query_id long, text string")
    hits = batch_search(
        typed_queries(asked, "query_id", "text"), open_ingested(spark, root, "postings"), words
    )
    assert hits.count() == search.match_records(records, Term("title")).count() > 0


def test_bad_lines_fail_the_build_and_are_kept(spark, source, tmp_path):
    root = str(tmp_path / "lib")
    with (source / "a.json").open("a") as lines:
        lines.write('{"_id": "broken", \n\n[1]\n')
    with pytest.raises(ValueError, match="2 pieces"):
        build_library(spark, str(source), root)
    assert store.current_version(spark, root) == 0
    assert build_library(spark, str(source), root, allow_rejected=True) == 1
    assert set(table(store.open_table(spark, root, "records"), "_id")) == {("r1",), ("r4",)}
    bad = store.open_table(spark, root, "rejected").collect()
    assert sorted(r["value"].strip() for r in bad) == ["[1]", '{"_id": "broken",']
    assert all(r["source_file"].endswith("a.json") for r in bad)


def test_an_indented_array_is_refused_by_the_line_reader(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps([rec(1), rec(2)], indent=2))
    with pytest.raises(ValueError):
        build_library(spark, str(tmp_path / "in"), str(tmp_path / "lib"))
    read = lambda s, p: library.read_indented(s, p, 2)
    assert build_library(spark, str(tmp_path / "in"), str(tmp_path / "lib"), read=read) == 1


def test_a_bad_element_takes_no_other_along(spark, tmp_path):
    folder = tmp_path / "arrays"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps([rec(1), "no record", rec(2), {"labels": 7, "_id": "r3"}, None]))
    (folder / "b.json").write_text("[{")
    read = library.read_arrays(spark, str(folder))
    assert sorted(table(library.accepted(read), "_id")) == [("r1",), ("r2",)]
    assert library.rejected(read).count() == 4
    (folder / "c.json").write_text(json.dumps([rec(5), {"labels": 7}], indent=2))
    indented = library.read_indented(spark, str(folder / "c.json"), 2)
    assert table(library.accepted(indented), "_id") == [("r5",)]
    assert library.rejected(indented).count() == 1


def broken_lines(folder):
    folder.mkdir()
    (folder / "a.json").write_text(
        json.dumps({**rec(1), "title": "T"}) + "\n" + '{"_id": "r2", "labelsNamed": ["x"], "ti\n\n[1]\n'
    )
    return str(folder)


def test_ingest_keeps_broken_lines_apart(spark, tmp_path):
    source, root = broken_lines(tmp_path / "in"), str(tmp_path / "out")
    ingest_new_files(spark, source, root, str(tmp_path / "check")).awaitTermination()
    assert table(open_ingested(spark, root, "records"), "_id", "title") == [("r1", "T")]
    bad = open_ingested(spark, root, "rejected")
    assert sorted(r["value"] for r in bad.collect()) == ['[1]', '{"_id": "r2", "labelsNamed": ["x"], "ti']
    assert bad.first()["source_file"].endswith("a.json")


def test_raw_import_keeps_broken_lines(spark, tmp_path):
    source = broken_lines(tmp_path / "in")
    got = raw.raw_import(spark, source)
    assert sorted(map(str, table(got, "_id", "title", "_corrupt_record"))) == sorted(map(str, [
        ("r1", "T", None), (None, None, "[1]"), (None, None, '{"_id": "r2", "labelsNamed": ["x"], "ti'),
    ]))
    fields = raw.text_fields(raw.read_raw(spark, source))
    assert fields.filter("field = '_corrupt_record' and _id is null").count() == 2
    write_lines(tmp_path / "good.json", rec(1))
    assert "_corrupt_record" not in raw.raw_import(spark, str(tmp_path / "good.json")).columns


def test_export_does_not_lose_broken_lines(spark, tmp_path):
    source = broken_lines(tmp_path / "in")
    with pytest.raises(ValueError):
        library.export_label(spark, source, "x", str(tmp_path / "out"))
    library.export_label(spark, source, "x", str(tmp_path / "out"), str(tmp_path / "bad"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    assert spark.read.json(str(tmp_path / "bad")).count() == 2


def test_two_builds_at_once_keep_their_folders(spark, tmp_path):
    root = str(tmp_path)
    one, two = store.begin(spark, root), store.begin(spark, root)
    assert one.version == two.version == 1 and one.folder != two.folder
    store.write_table(spark.range(1), one, "t")
    store.write_table(spark.range(2), two, "t")
    store.publish(spark, two)
    assert store.open_table(spark, root, "t").count() == 2
    store.publish(spark, one)
    assert store.open_table(spark, root, "t").count() == 1 and store.current_version(spark, root) == 1


def test_variant_import_keeps_and_merges_types(spark):
    lines = spark.createDataFrame(
        [('{"_id": "a", "n": 1, "m": 1, "o": {"x": 1, "deep": {"y": [1]}}}',),
         ('{"_id": "b", "n": 2.5, "m": "t", "o": {"z": null}}',), ('{"_id": "c", "n": nope',), ("[1]",), ("{}",)],
        "value string",
    )
    fields = raw.variant_fields(lines)
    got = {(r["_id"], r["field"]): (r["type"], r["text"]) for r in fields.collect()}
    assert got["a", "n"] == ("BIGINT", "1") and got["a", "m"][0] == "BIGINT" and got["b", "m"] == ("STRING", "t")
    assert got["a", "o.x"] == ("BIGINT", "1") and got["a", "o.deep"] == ("OBJECT<y: ARRAY<BIGINT>>", '{"y":[1]}')
    assert got["b", "o.z"] == ("VOID", None) and ("a", "o.deep.y") not in got
    assert sorted(r["text"] for r in fields.filter("field = '_corrupt_record'").collect()) == [
        "[1]", '{"_id": "c", "n": nope'
    ]
    kinds = {r["field"]: (r["type"], r["n_values"]) for r in raw.variant_schema(fields).collect()}
    assert kinds["m"] == ("VARIANT", 2) and kinds["n"][0].startswith("DECIMAL") and kinds["o.x"] == ("BIGINT", 1)
    table_ = raw.variant_columns(lines)
    types = dict(table_.dtypes)
    assert types["m"] == "variant" and types["_id"] == "string" and types["o"].startswith("struct<deep:struct<y:array<bigint>>")
    assert table_.filter("_id = 'a'").select("o.x").first()["x"] == 1 and table_.count() == 5
    assert raw.variant_columns(lines.filter("value = '{}'")).columns == []
    assert raw.variant_fields(lines.limit(0)).count() == 0
