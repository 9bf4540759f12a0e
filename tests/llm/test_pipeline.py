"""Each stage of the pipeline against a direct reading of its rule, on its own input."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from citeloom.llm import packing, quality
from citeloom.llm.queries import vocabulary
from citeloom.session import stored
from test_simhash import plain_fingerprint, plain_groups
from test_small_operators import plain_spans

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "stage")
        found.append(docs.collect())
    return found


def test_stages(spark, steps):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert all(list(rows[0].asDict()) == columns for rows in steps[:-1])
    assert len(corpus_pipeline.STAGES) == 5


def test_quality_stage(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {r["doc_id"] for r in quality.score(docs, model).filter("predicted = 1").collect()}
    assert [r for r in steps[0] if r["doc_id"] in kept] == sorted(steps[1], key=lambda r: r["doc_id"])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(i in kept for i, q in labels.items() if q == 1)


def test_near_duplicate_stage(steps):
    rows = sorted(steps[1], key=lambda r: r["doc_id"])
    roots = plain_groups([plain_fingerprint(r["text"]) for r in rows], 3)
    first = {}
    for r, root in zip(rows, roots):
        first.setdefault(root, r)
    assert sorted(first.values()) == sorted(steps[2])


def test_secret_stage(steps):
    before = {r["doc_id"]: r for r in steps[2]}
    assert before.keys() == {r["doc_id"] for r in steps[3]}
    changed = 0
    for r in steps[3]:
        old = before[r["doc_id"]]
        if plain_spans(old["text"] or ""):
            changed += 1
            assert "[SECRET]" in r["text"] and not plain_spans(r["text"])
            assert r["n_chars"] == len(r["text"])
        else:
            assert r == old
    assert changed


def test_mix_stage(steps):
    before = {r["doc_id"]: r for r in steps[3]}
    times = Counter(r["doc_id"] for r in steps[4])
    assert all(before[r["doc_id"]] == r for r in steps[4]) and max(times.values()) <= 3


def test_packing_stage(steps):
    pieces = [length for r in steps[4] for _, length in packing.cuts(len(packing.encoder(*vocabulary())(r["text"] or "")) + 1)]
    assert Counter(pieces) == Counter(r["length"] for r in steps[5])
    assert len({r["sequence_id"] for r in steps[5]}) <= -(-sum(pieces) // 2048) + 1


def test_run_gives_the_last_stage(spark, steps):
    keys = ["doc_id", "piece", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, SF).select(*keys).collect()
    assert Counter(got) == Counter(tuple(r[k] for k in keys) for r in steps[5])


def test_stages_on_no_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "none")
        assert docs.count() == 0


CLASHES = [
    "mix_size", "mix_copies", "mix_copy", "mix_source", "mix_id", "mix_words", "mix_number", "fewest",
    "more", "row", "blob", "secret_blob", "findings", "secret_findings", "clean", "kept_group", "kept_id",
    "fingerprint", "component_id", "label", "score", "size", "source_key", "copies", "number", "part",
]


@pytest.mark.parametrize("stage", range(4))
def test_extra_columns_of_any_name(spark, steps, stage):
    """Extra columns with the names used inside come out as they went in."""
    columns = spark.read.parquet(f"{SF}/documents.parquet").schema
    docs = spark.createDataFrame(steps[stage], columns)
    named = docs.withColumns({n: F.concat(F.lit(f"{n}-"), "doc_id") for n in CLASHES}).withColumn(
        "a map", F.create_map(F.lit("k"), "doc_id")
    )
    got = corpus_pipeline.STAGES[stage][1](spark, named, SF).collect()
    assert got and list(got[0].asDict()) == named.columns
    for r in got:
        assert all(r[n] == f"{n}-{r['doc_id']}" for n in CLASHES) and r["a map"] == {"k": r["doc_id"]}
    plain = Counter((r["doc_id"], r["text"]) for r in steps[stage + 1])
    assert Counter((r["doc_id"], r["text"]) for r in got) == plain
