"""The classifier on held-out documents and on odd rows."""

import random
import zlib

import numpy as np
import pytest

from citeloom.llm import quality
from citeloom.llm.queries import op8_quality

SF = "/root/testdata/sf0.1"


def test_held_out_documents(spark):
    rows = op8_quality(spark, SF).collect()
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3)
    held = [(r["predicted"], labels[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in labels]
    assert len(held) > 300
    assert np.mean([p == y for p, y in held]) > 0.98
    assert np.mean([p for p, y in held if y == 1]) > 0.99


def test_pairs_order_the_documents():
    rng = np.random.default_rng(1)
    x = np.zeros((400, quality.N_FEATURES))
    x[:, 3] = rng.normal(size=400)
    label = (x[:, 3] + rng.normal(size=400) / 2 > 0.5).astype(int)
    model = quality.fit(x, label)
    scores = model.scores(x)
    assert np.corrcoef(scores, x[:, 3])[0, 1] > 0.8
    # As many are rejected as there are of label 0: the cut is a quantile of the scores.
    assert (scores < quality.KEEP_FROM).sum() == (label == 0).sum()


DOCS = [
    (1, None), (2, ""), (3, "a"), (None, "text without an id"), (5, "word " * 200000), (5, "word"),
    (6, "é" * 3000), (7, " \n\t "),
]


def test_odd_rows(spark):
    rng = random.Random(2)
    good = [(100 + i, " ".join(rng.choices("abcdefghij", k=40))) for i in range(40)]
    bad = [(200 + i, "!! || " * 20) for i in range(40)]
    docs = spark.createDataFrame(
        [(*r, 0.5, 1) for r in DOCS + good + bad], "doc_id long, text string, score double, label int"
    )
    labels = spark.createDataFrame(
        [(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(100, 0), (None, 1), (101, 7), (101, None), (102, 1)],
        "doc_id long, quality int",
    )
    model = quality.train(docs, labels)
    rows = quality.score(docs, model).collect()
    assert len(rows) == len(DOCS) + 80 and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["predicted"] for r in rows if 100 <= (r["doc_id"] or 0) < 200} == {1}
    assert {r["predicted"] for r in rows if 200 <= (r["doc_id"] or 0)} == {0}
    kept = quality.kept(docs, model)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r["predicted"] for r in rows)


@pytest.mark.parametrize("label", [None, 1])
def test_nothing_to_learn(spark, label):
    docs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, label), (2, label)], "doc_id long, quality int")
    rows = quality.score(docs, quality.train(docs, labels)).collect()
    assert [(round(r["score"], 9), r["predicted"]) for r in rows] == [(0.3, 1)] * 2
    assert quality.score(docs.limit(0), quality.train(docs.limit(0), labels.limit(0))).count() == 0


def test_all_pairs_are_fitted():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, quality.N_FEATURES))
    label = (x[:, 3] + rng.normal(size=300) > 0.3).astype(int)
    model = quality.fit(x, label)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    pairs = (z[label == 1][:, None] - z[label == 0][None]).reshape(-1, z.shape[1])
    p = 1 / (1 + np.exp(pairs @ model.weights))
    slope = pairs.T @ p / len(pairs) - 1e-4 * model.weights
    assert np.abs(slope).max() < 5e-4
    parts = quality.learn(lambda fold, merge: merge(fold(x[:111], label[:111]), fold(x[111:], label[111:])))
    np.testing.assert_allclose(parts.weights, model.weights, rtol=1e-9, atol=1e-12)
    assert abs(parts.cut - model.cut) < 1e-9


def test_every_label_teaches(spark):
    ids = [i for i in range(32_000) if zlib.crc32(str(i).encode()) % 5][:25_000]
    texts = ["!! || " * (i % 7 + 1) if i % 3 == 0 else f"some words of length {i % 11} " * (i % 5 + 1) for i in ids]
    docs = spark.createDataFrame(list(zip(ids, texts)), "doc_id long, text string")
    truth = [int(i % 3 > 0 and i % 50 > 0) for i in ids]
    labels = spark.createDataFrame(list(zip(ids, truth)), "doc_id long, quality int")
    model = quality.train(docs, labels)
    x = np.array([quality.features(t.encode()) for t in texts])
    np.testing.assert_allclose(model.mean, x.mean(axis=0), rtol=1e-9)
    np.testing.assert_allclose(model.weights, quality.fit(x, np.array(truth)).weights, rtol=1e-5, atol=1e-7)
