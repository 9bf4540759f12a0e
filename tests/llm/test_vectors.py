"""Both block searches against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from citeloom.llm import ann, vafile
from citeloom.llm.vectors import asked_rows, packed, usable_rows


def vectors(seed=1, n=400, dim=16):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(dim)]) for i in range(n)]
    rows += [(i, rows[3][1]) for i in range(1000, 1060)]  # one very common vector
    rows += [(2000, None), (2020, []), (2040, [None] * dim), (2060, [float("nan")] * dim)]
    rows += [(2080, [float("inf")] * dim), (2100, [0.0] * dim), (None, rows[5][1]), (20, rows[20][1])]
    rows += [(2120, [1.0, 2.0]), (2121, [2.0, 1.0]), (2140, [1e-30] * dim), (2160, [1e30] * dim)]
    return rows


def expected(rows, k, score, zero):
    def good(v):
        return v and all(x is not None and math.isfinite(x) for x in v) and (zero or any(v))

    usable = [(i, np.float32(v)) for i, v in rows if i is not None and good(v)]
    found = {}
    for i, q in {i: v for i, v in usable if i % 20 == 0}.items():
        near = sorted((-score(q, v), j) for j, v in usable if j != i and len(v) == len(q))
        for rank, (s, j) in enumerate(near[:k], 1):
            found[i, rank] = (j, -s)
    return found


SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "s", "r") for r in rows], SCHEMA)


def by_rank(df):
    return {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in df.collect()}


@pytest.mark.parametrize("blocks", [(1024, 8192), (7, 50)])
@pytest.mark.parametrize("k", [1, 20])
def test_nearest(spark, blocks, k):
    rows = vectors()
    got = by_rank(ann.nearest(table(spark, rows), F.col("vec_id") % 20 == 0, k, *blocks))
    want = expected(rows, k, lambda a, b: float((a.astype(float) * b.astype(float)).sum()), False)
    assert got.keys() == want.keys()
    for key, (other, score) in got.items():
        assert score == pytest.approx(want[key][1], rel=1e-12)
        assert other == want[key][0]


@pytest.mark.parametrize("blocks", [(1024, 8192), (7, 50)])
def test_top_k(spark, blocks):
    rows = [r for r in vectors() if r[0] != 2160]
    got = by_rank(vafile.top_k(table(spark, rows), F.col("vec_id") % 20 == 0, 20, 64, 5, *blocks))

    def score(a, b):
        return sum(int(math.floor(64 * float(x))) * int(math.floor(64 * float(y))) for x, y in zip(a, b))

    assert got == expected(rows, 20, score, True)


@pytest.mark.parametrize("own", ["different", "equal"])
@pytest.mark.parametrize("blocks", [(1024, 8192), (7, 50)])
def test_many_rows_of_the_query_id(spark, own, blocks):
    rng = random.Random(4)
    rows = [(i, [rng.uniform(1, 2) for _ in range(4)]) for i in range(1, 60)]
    if own == "different":  # all ahead of the others
        rows += [(0, [50.0 + i, 60.0, 70.0, 80.0]) for i in range(25)]
    else:  # larger ids share the vector
        rows += [(0, [9.0] * 4)] * 25 + [(i, [9.0] * 4) for i in range(100, 130)] + [(100, [9.0] * 4)] * 3
    asks = F.col("vec_id") % 20 == 0
    got = by_rank(ann.nearest(table(spark, rows), asks, 20, *blocks))
    want = expected(
        sorted(rows, key=lambda r: r[1], reverse=True), 20,
        lambda a, b: float((a.astype(float) * b.astype(float)).sum()), False,
    )
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    got = by_rank(vafile.top_k(table(spark, rows), asks, 20, 64, 5, *blocks))

    def score(a, b):
        return sum(int(math.floor(64 * float(x))) * int(math.floor(64 * float(y))) for x, y in zip(a, b))

    assert got == expected(sorted(rows, key=lambda r: r[1], reverse=True), 20, score, True)


def test_huge_components(spark):
    rows = [(0, [1e12, -3e11]), (1, [2e12, 5e11]), (2, [2e12, 4e11]), (3, [1e30, 0.0]), (4, [1.0, 1.0])]
    got = by_rank(vafile.top_k(table(spark, rows), F.col("vec_id") == 4, 3))
    assert [got[4, r][0] for r in (1, 2, 3)] == [3, 1, 2]
    assert by_rank(ann.nearest(table(spark, rows), F.col("vec_id") == 4, 3))[4, 1][0] == 3


@pytest.mark.parametrize("search", [ann.nearest, vafile.top_k])
def test_few_or_no_rows(spark, search):
    assert search(table(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert search(table(spark, [(0, [1.0, 2.0])]), F.col("vec_id") % 20 == 0).count() == 0
    assert search(table(spark, [(0, [1.0]), (1, [2.0]), (2, [2.0])]), F.col("vec_id") % 20 == 0).count() == 2


def test_bounds_hold():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(30, 40)), rng.normal(size=(50, 40)) * np.exp(rng.normal(size=(50, 1)) * 3)
    low, high = ann.bounds(a, b)
    assert (low <= a @ b.T).all() and (a @ b.T <= high).all()


def test_few_exact_vectors_are_read(spark):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    asks, k = F.col("vec_id") % 20 == 0, 20
    good = usable_rows(rows, True)
    asking = asked_rows(good, asks)
    n = asking.count()
    left = ann.surviving(good, asking, k, 1024, 500).count()
    assert n * k <= left < n * k * 3  # of 2000 candidates a query
    left = vafile.scanned(good, asking, k, 64, vafile.CELL_BITS, 1024, 500).count()
    assert n * k <= left < n * k * 3


def test_packs_take_a_byte_a_component(spark):
    good = usable_rows(spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet"), True)
    packs = packed(good, ann.quantise, 600).collect()
    assert sum(p["n"] for p in packs) == 2000 and max(p["n"] for p in packs) <= 600
    assert sum(len(p["codes"]) for p in packs) == 2000 * 64
