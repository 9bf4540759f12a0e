"""Centroid clustering against plain rounds over all vectors in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from citeloom.llm import clustering as C


def expected(rows, k, rounds, dim, prefix="2:"):
    kept = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows
        if v is not None and len(v) == dim and all(x is not None and abs(x) < 2**19 for x in v)
    ]
    start = sorted(
        ((i is None, hashlib.sha256(f"{prefix}{i}".encode()).hexdigest() if i is not None else "", x) for i, x in kept)
    )
    centroids = [x for _, _, x in start[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(x)[1] for _, x in kept]
        for j in range(len(centroids)):
            members = [x for (_, x), o in zip(kept, own) if o == j]
            if members:
                centroids[j] = [sum(column) // len(members) for column in zip(*members)]
    last = [(i, *nearest(x)) for i, x in kept]
    total = sum(d for _, d, _ in last)
    return sorted(
        (str(i), j, d, sum(e for _, e, o in last if o == j), total,
         hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest())
        for i, d, j in last
    )


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, 1.0, "p") for r in rows],
        "vec_id long, embedding array<float>, upper double, point string",
    )


def vectors(seed, n, dim, spread=0.2):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    return [(i, [x + rng.gauss(0, spread) for x in rng.choice(middles)]) for i in range(n)]


ODD = [
    (900, None), (901, []), (902, [None] * 8), (903, [float("nan")] + [0.0] * 7), (904, [1.0] * 7),
    (905, [float("-inf")] * 8), (906, [3e5] * 8), (907, [1e30] * 8), (None, [0.5] * 8), (None, [0.5] * 8),
    (3, [0.25] * 8), (3, [0.25] * 8), *[(1000 + i, [0.1] * 8) for i in range(120)],
]


@pytest.mark.parametrize("rows,k,rounds", [
    (vectors(1, 300, 8), 12, 5), (vectors(2, 200, 8) + ODD, 40, 5), (vectors(3, 5, 8), 9, 3),
    (vectors(4, 60, 8), 1, 4), ([(i, [1.0] * 8) for i in range(30)], 4, 2), (vectors(5, 80, 8, 3.0), 7, 0),
])
def test_equals_plain_rounds(spark, rows, k, rounds):
    got = C.cluster_vectors(frame(spark, rows).repartition(3), k, rounds, dim=8)
    assert sorted((str(r[0]), *r[1:]) for r in map(tuple, got.collect())) == expected(rows, k, rounds, 8)


def test_bounds_save_scans(spark):
    rows = vectors(6, 2000, 8, 0.05)
    points = C.kept(frame(spark, rows), 8, 256)
    found = C.cluster(points, C.seeds(points, 12, "2:"), 5)
    assert found.scanned[0] == 2000 and found.scanned[-1] < 400


def test_nothing_kept(spark):
    got = C.cluster_vectors(frame(spark, [(1, None), (2, [1.0])]), dim=8)
    assert got.count() == 0 and len(got.columns) == 6
    assert C.cluster_vectors(frame(spark, []), dim=8).count() == 0


def test_spheres_hold_and_beat_the_drift():
    rng = np.random.default_rng(1)
    for _ in range(30):
        dim = int(rng.integers(1, 5))
        old = rng.integers(-300, 300, (5, dim))
        new = old + rng.integers(-80, 80, (5, dim))
        radius = rng.uniform(0, 200, 5)
        by = C.nearer_by(old, new, radius)
        drift = np.sqrt(((new - old) ** 2).sum(1))
        assert (by <= drift + 1e-9).all()
        for i in range(5):
            way = rng.normal(size=(400, dim))
            way /= np.sqrt((way**2).sum(1))[:, None]
            x = old[i] + way * (radius[i] * rng.uniform(0, 1, 400) ** (1 / dim))[:, None]
            came = np.sqrt(((x[:, None] - old) ** 2).sum(2)) - np.sqrt(((x[:, None] - new) ** 2).sum(2))
            assert (came.max(0) <= by[i] + 1e-6).all()
    far = C.nearer_by(np.array([[0, 0], [1000, 0]]), np.array([[0, 0], [1000, 90]]), np.array([10.0, 10.0]))
    assert far[0, 1] < 5  # moved sideways by 90


def test_large_integers_are_exact():
    rng = np.random.default_rng(2)
    x, c = rng.integers(-(2**27), 2**27, (20, 64)), rng.integers(-(2**27), 2**27, (5, 64))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(p, q)) for q in c] for p in x]
    assert C.squared(x, c).tolist() == want
