"""Centroid clustering with bounds that follow the geometry of the moved centroids.

Every vector keeps an upper bound of the distance to its centroid and a lower bound of the
distance to all others. After an update the members of a cluster lie in a sphere around its
old centroid; in the plane through this centroid and the move of another one, the sphere
limits by how much any member can have come nearer to that other centroid. This limit is
smaller than the full drift, often negative, and the lower bound is loosened by it only.
Vectors whose bounds still part keep their cluster unread; the others are scanned exactly.

All values are integers: sums, means and distances are exact, bounds carry a margin.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.vectors import usable
from citeloom.session import in_python, scratch_dir

#: Components below this size, times the factor of 256, keep all distances in a long.
LIMIT = 2.0**19
#: Integers up to here have exact squared distances in doubles.
_DOUBLE = 2**21
MARGIN = 1e-9
SLICES = 64
ROWS_AT_ONCE = 4096

STATE = "vec_id long, point array<double>, cluster int, upper double, lower double," \
    " pos int, value decimal(38,0), total boolean"
_SCHEMA = pa.schema([
    ("vec_id", pa.int64()), ("point", pa.list_(pa.float64())), ("cluster", pa.int32()),
    ("upper", pa.float64()), ("lower", pa.float64()), ("pos", pa.int32()),
    ("value", pa.decimal128(38, 0)), ("total", pa.bool_()),
])
_COUNT, _RADIUS, _SCANNED = -1, -2, -3  # places of a cluster's totals before its components


class Clustering(NamedTuple):
    """The last assignment (vec_id, point, cluster), its centroids, and rows scanned a round."""

    state: DataFrame
    centroids: np.ndarray
    scanned: list[int]


def kept(vectors: DataFrame, dim: int, factor: int) -> DataFrame:
    """vec_id and ``point``: floor(factor * x) of vectors with ``dim`` usable components."""
    small = F.forall("embedding", lambda x: F.abs(x) < LIMIT)
    good = usable(F.col("embedding"), True) & (F.size("embedding") == dim) & small
    point = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(factor)).cast("double"))
    return vectors.filter(F.coalesce(good, F.lit(False))).select(
        F.col("vec_id").cast("long").alias("vec_id"), point.alias("point")
    )


def seeds(points: DataFrame, k: int, prefix: str) -> np.ndarray:
    """The k points of smallest sha256(prefix + vec_id), in that order; ties by point."""
    hashed = F.sha2(F.concat(F.lit(prefix), F.col("vec_id").cast("string")), 256)
    first = points.select(hashed.alias("h"), "point").orderBy(F.asc_nulls_last("h"), "point").limit(k)
    return np.array([r["point"] for r in first.collect()], np.int64)


def squared(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """All squared distances, exact, as int64."""
    if not len(points):
        return np.empty((0, len(centroids)), np.int64)
    if max(np.abs(points).max(), np.abs(centroids).max()) <= _DOUBLE:
        x, c = points.astype(float), centroids.astype(float)
        found = (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)
        return found.astype(np.int64)
    return np.stack([((points - c) ** 2).sum(1) for c in centroids], axis=1)


def nearer_by(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """[i, j]: at most so much nearer did centroid j come to any point of cluster i's sphere.

    In the plane of old i and the move of j, with the move along the first axis and its middle
    as origin, d(x, old j) - d(x, new j) grows along the first axis, and falls with the
    distance from it where positive, grows where negative. The sphere is cut into slices along
    the axis; the value at the far end of a slice, at its best distance from the axis, bounds
    the slice.
    """
    old, new = old.astype(float), new.astype(float)
    k = len(old)
    move = new - old
    drift = np.sqrt((move**2).sum(1))
    found = np.zeros((k, k))
    edges = np.linspace(-1.0, 1.0, SLICES + 1)
    # The widest part of a slice, as a share of the radius.
    widest = np.sqrt(1 - np.where(edges[:-1] * edges[1:] <= 0, 0, np.minimum(abs(edges[:-1]), abs(edges[1:]))) ** 2)
    for j in np.flatnonzero(drift):
        h = drift[j] / 2
        rel = old - (old[j] + new[j]) / 2
        along = rel @ (move[j] / drift[j])
        off = np.sqrt(np.maximum((rel**2).sum(1) - along**2, 0))
        slack = MARGIN * (1 + np.abs(rel).max(1) + drift[j] + radius)
        u = along[:, None] + radius[:, None] * edges[1:] + slack[:, None]
        reach = radius[:, None] * widest + slack[:, None]
        v = np.where(u >= 0, np.maximum(off[:, None] - reach, 0), off[:, None] + reach)
        value = np.sqrt((u + h) ** 2 + v**2) - np.sqrt((u - h) ** 2 + v**2)
        found[:, j] = np.minimum(value.max(1) + slack, drift[j])
    return found


class Step(NamedTuple):
    """What a task needs to assign its vectors: the centroids, and how bounds move."""

    centroids: np.ndarray
    drift: np.ndarray
    nearer: np.ndarray  # per cluster, the most that any other centroid came nearer
    gap: np.ndarray  # per cluster, half the distance to the closest other centroid


def step_to(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> Step:
    k = len(new)
    by = nearer_by(old, new, radius)
    between = np.sqrt(np.array([((new.astype(float) - c) ** 2).sum(1) for c in new]))
    np.fill_diagonal(by, -np.inf)
    np.fill_diagonal(between, np.inf)
    drift = np.sqrt(((new - old).astype(float) ** 2).sum(1))
    none = np.full(k, np.inf)
    return Step(new, drift, by.max(1) if k > 1 else -none, between.min(1) / 2 if k > 1 else none)


def moved(points, cluster, upper, lower, step: Step) -> tuple:
    """Clusters and bounds after the move, and how many vectors were scanned."""
    upper = upper + step.drift[cluster]
    lower = np.maximum(lower - step.nearer[cluster], 0)

    def open_ones(among: np.ndarray) -> np.ndarray:
        far = np.maximum(lower[among], step.gap[cluster[among]])
        return among[upper[among] * (1 + MARGIN) + MARGIN >= far * (1 - MARGIN) - MARGIN]

    left = open_ones(np.arange(len(points)))
    for c in np.unique(cluster[left]):  # the own distance first, exactly
        own = left[cluster[left] == c]
        upper[own] = np.sqrt(squared(points[own], step.centroids[c : c + 1])[:, 0].astype(float))
    left = open_ones(left)
    cluster[left], upper[left], lower[left] = scanned(points[left], step.centroids)
    return cluster, upper, lower, len(left)


def scanned(points: np.ndarray, centroids: np.ndarray) -> tuple:
    """Nearest centroid (ties: smaller number), and the distances to it and the second."""
    all_of = squared(points, centroids)
    nearest = all_of.argmin(axis=1) if len(points) else np.empty(0, np.int64)
    own = all_of[np.arange(len(points)), nearest]
    if len(centroids) > 1:
        second = np.partition(all_of, 1, axis=1)[:, 1]
    else:
        second = np.full(len(points), np.iinfo(np.int64).max)
    return nearest.astype(np.int32), np.sqrt(own.astype(float)), np.sqrt(second.astype(float))


def assigned(state: DataFrame, centroids: np.ndarray, step: Step | None) -> DataFrame:
    """The vectors with clusters and bounds, and each task's totals of its clusters as rows."""
    k = len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, radius = [0] * k, np.zeros(k)
        totals = np.zeros((k, centroids.shape[1]), object)
        n_scanned = 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                batch = whole.slice(at, ROWS_AT_ONCE)
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
                points = flat.reshape(batch.num_rows, -1).astype(np.int64)
                if step is None:
                    cluster, upper, lower = scanned(points, centroids)
                    n = len(points)
                else:
                    before = (batch.column(i).to_numpy(zero_copy_only=False).copy() for i in (2, 3, 4))
                    cluster, upper, lower, n = moved(points, *before, step)
                n_scanned += n
                for c in np.unique(cluster):
                    own = cluster == c
                    count[c] += int(own.sum())
                    totals[c] += points[own].sum(axis=0).astype(object)
                    radius[c] = max(radius[c], float(upper[own].max()))
                none = pa.nulls(len(points))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0), batch.column(1), pa.array(cluster, pa.int32()), pa.array(upper),
                    pa.array(lower), none.cast(pa.int32()), none.cast(pa.decimal128(38, 0)),
                    pa.array(np.zeros(len(points), bool)),
                ], schema=_SCHEMA)
        rows = []
        for c in range(k):
            if count[c]:
                rows += [(c, _COUNT, None, count[c]), (c, _RADIUS, radius[c], None)]
                rows += [(c, i, None, int(x)) for i, x in enumerate(totals[c])]
        rows.append((0, _SCANNED, None, n_scanned))
        yield pa.RecordBatch.from_arrays([
            pa.nulls(len(rows), pa.int64()), pa.nulls(len(rows), pa.list_(pa.float64())),
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64()),
            pa.nulls(len(rows), pa.float64()), pa.array([r[1] for r in rows], pa.int32()),
            pa.array([None if r[3] is None else Decimal(r[3]) for r in rows], pa.decimal128(38, 0)),
            pa.array(np.ones(len(rows), bool)),
        ], schema=_SCHEMA)

    columns = ["vec_id", "point", *([] if step is None else ["cluster", "upper", "lower"])]
    return in_python(state.select(*columns), run, STATE)


def updated(totals: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Centroids moved to the floor of their means, sphere radii, and vectors scanned."""
    sums = totals.groupBy("cluster", "pos").agg(F.sum("value").alias("value"), F.max("upper").alias("upper"))
    found = {(r["cluster"], r["pos"]): r for r in sums.collect()}
    new, radius = centroids.copy(), np.zeros(len(centroids))
    for c in range(len(centroids)):
        if (c, _COUNT) in found:
            n = int(found[c, _COUNT]["value"])
            radius[c] = found[c, _RADIUS]["upper"]
            new[c] = [int(found[c, i]["value"]) // n for i in range(centroids.shape[1])]
    return new, radius, int(found[0, _SCANNED]["value"])


def cluster(points: DataFrame, centroids: np.ndarray, rounds: int = 5) -> Clustering:
    """Assign and update ``rounds`` times, then assign once more.

    Each round writes its vectors with their bounds to the shared folder, and beside them the
    totals of its tasks, so a round reads the vectors once and a lost executor costs no earlier
    round. To the driver come one row per centroid and component.
    """
    spark = points.sparkSession
    state, step, history = points, None, []
    for at in range(rounds + 1):
        path = scratch_dir(spark, f"clusters-{at}")
        assigned(state, centroids, step).write.partitionBy("total").parquet(path)
        written = spark.read.schema(STATE).parquet(path)
        state = written.filter("not total")
        new, radius, n = updated(written.filter("total"), centroids)
        history.append(n)
        if at < rounds:
            step, centroids = step_to(centroids, new, radius), new
    return Clustering(state.select("vec_id", "point", "cluster"), centroids, history)


def with_distances(found: Clustering) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    centroids = found.centroids
    spark = found.state.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            points = flat.reshape(batch.num_rows, -1).astype(np.int64)
            own = centroids[batch.column(2).to_numpy(zero_copy_only=False)]
            distance = ((points - own) ** 2).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(distance, pa.int64())],
                names=["vec_id", "cluster", "distance"],
            )

    rows = in_python(found.state, run, "vec_id long, cluster int, distance long")
    sums = {r["cluster"]: r["s"] for r in rows.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    whole = sum(sums.values())
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    per_cluster = spark.createDataFrame(
        [(c, s, whole, digest[c]) for c, s in sums.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(per_cluster), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )


def cluster_vectors(
    vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, factor: int = 256, prefix: str = "2:"
) -> DataFrame:
    """Cluster ``embedding`` vectors of ``dim`` components; see ``with_distances``.

    Kept are vectors of that many components, none null, non-finite or of LIMIT or more in
    size (their distances would fit no long). Fewer vectors than k: each starts a centroid.
    Null and repeated vec_ids are rows of their own; a null id starts a centroid only when
    ids run out. Equal centroids: the smaller number takes the vectors, the other stays.
    No vector kept: no rows. Other columns are ignored.
    """
    points = kept(vectors, dim, factor)
    start = seeds(points, k, prefix)
    if not len(start):
        return vectors.sparkSession.createDataFrame(
            [], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long,"
            " centroid_sha256 string",
        )
    return with_distances(cluster(points, start, rounds))
