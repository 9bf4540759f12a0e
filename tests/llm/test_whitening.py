"""Whitening against a direct covariance in exact fractions."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from citeloom.llm import whitening as W


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, 3, "x") for r in rows], "vec_id long, embedding array<float>, dim int, x string"
    )


def vectors(n, dim, seed=1):
    rng = random.Random(seed)
    scale = [3.0 / (1 + i) for i in range(dim)]
    rows = []
    for i in range(n):
        shared = rng.gauss(0, 1)
        rows.append((i, [s * rng.gauss(0, 1) + shared for s in scale]))
    return rows


ODD = [(900, None), (901, []), (902, [1.0, None]), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [1e30] * 6)]


def whole(rows, dim):
    return [
        (i, [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v]) for i, v in rows
        if v is not None and len(v) == dim and all(c is not None and abs(c) < 2**19 for c in v)
    ]


def check(got, rows, dim, top):
    x = whole(rows, dim)
    n = len(x)
    sums = [sum(column) for column in zip(*(v for _, v in x))]
    off = [[Fraction(a) - Fraction(s, n) for a, s in zip(v, sums)] for _, v in x]
    cov = np.array([[float(sum(o[i] * o[j] for o in off) / n) for j in range(dim)] for i in range(dim)])
    values, components = np.linalg.eigh(cov)
    order = np.argsort(-values)
    values, components = values[order], components[:, order]
    exact = {i: sum((n * a - s) ** 2 for a, s in zip(v, sums)) for i, v in x}
    centred = np.array([[float(c) for c in o] for o in off])
    z = centred @ components / np.sqrt(values)
    signs = {}
    assert len(got) == n * min(top, dim)
    place = {i: k for k, (i, _) in enumerate(x)}
    for r in got:
        want = z[place[r["vec_id"]], r["component"] - 1]
        if abs(want) > 1e-6:
            signs.setdefault(r["component"], np.sign(want) * np.sign(r["whitened"]))
        assert r["whitened"] * signs.get(r["component"], 1) == pytest.approx(want, abs=1e-8)
        assert (r["n"], r["deviation"]) == (n, exact[r["vec_id"]])
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / np.trace(cov), rel=1e-9)
        assert r["identity_error"] < 1e-4  # eigenvalues may differ by ten powers of ten


@pytest.mark.parametrize("top", [3, 32])
def test_equals_direct_covariance(spark, top):
    rows = vectors(200, 6) + ODD
    check(W.whiten(frame(spark, rows).repartition(5), top).collect(), rows, 6, top)


def test_many_copies_and_large_entries(spark):
    rows = vectors(60, 4) + [(i, [400_000.0, -400_000.0, 7.0, 0.5]) for i in range(100, 130)]
    check(W.whiten(frame(spark, rows).repartition(4)).collect(), rows, 4, 32)


def test_lengths_are_fits_of_their_own(spark):
    rows = vectors(40, 5) + [(i + 1000, v) for i, v in vectors(30, 3, seed=2)]
    got = W.whiten(frame(spark, rows)).collect()
    check([r for r in got if r["vec_id"] < 1000], rows[:40], 5, 32)
    check([r for r in got if r["vec_id"] >= 1000], rows[40:], 3, 32)


def test_components_without_variance_are_zero(spark):
    rows = [(i, [float(i), 2.0 * i, 5.0]) for i in range(9)] + [(None, [4.0, 8.0, 5.0])]
    got = W.whiten(frame(spark, rows)).collect()
    assert len(got) == 30
    assert all(r["whitened"] == 0 for r in got if r["component"] > 1)
    assert got[0]["identity_error"] < 1e-9
    alone = W.whiten(frame(spark, [(1, [2.0, 3.0])])).collect()
    assert [(r["whitened"], r["explained"], r["deviation"]) for r in alone] == [(0.0, 0.0, 0)] * 2


def test_no_vectors(spark):
    assert W.whiten(frame(spark, [])).count() == 0
    assert W.whiten(frame(spark, ODD)).count() == 0


def test_covariance_comes_from_squares_only():
    rng = np.random.default_rng(5)
    r = rng.integers(-500, 500, (300, 7))
    squares = dict(enumerate(W.pair_squares(r).tolist()))
    got = W.covariance(300, r.sum(0).tolist(), squares)
    assert np.allclose(got, np.cov(r.T, bias=True), rtol=1e-12)


def test_deviations_beyond_a_long_are_cut():
    fit = W.Fit(10**10, [10**16], np.array([10**6]), np.zeros(1), np.eye(1), np.ones(1), 1.0)
    assert W.deviations(np.array([[10**6], [10**6 + 1], [10**6 + 40]]), fit)[:2] == [0, 2**63 - 1]
