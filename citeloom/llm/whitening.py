"""Embedding whitening from a polarisation covariance.

The variance of a sum holds the covariance: var(a + b) = var(a) + var(b) + 2 cov(a, b). So
only squares are added up: of every centred dimension and of every sum of two centred
dimensions, all exact integers. The differences of these variances give the whole matrix,
whose eigenvectors and eigenvalues give the whitened projection.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.vectors import usable
from citeloom.session import in_python

#: Components below this size keep the square of a sum of two, and sums of many, in 64 bits.
LIMIT = 2.0**19
FACTOR = 64
SHIFT = 1_000_000
ROWS_AT_ONCE = 512
#: An eigenvalue below this share of the trace is none: its component is zero for all rows.
NO_VARIANCE = 1e-13

_PART = pa.schema([("dim", pa.int32()), ("pos", pa.int64()), ("value", pa.decimal128(38, 0))])


class Fit(NamedTuple):
    """Of the vectors of one length: how many, their exact sums, and the components."""

    n: int
    sums: list[int]
    mean: np.ndarray  # whole part of the mean, int64
    rest: np.ndarray  # mean less its whole part, double
    components: np.ndarray  # unit eigenvectors as columns, by falling eigenvalue
    values: np.ndarray
    trace: float

    def scale(self) -> np.ndarray:
        """One over the root of each eigenvalue; zero for those that are none."""
        some = self.values > NO_VARIANCE * max(self.trace, 0.0)
        return np.where(some, 1 / np.sqrt(np.where(some, self.values, 1.0)), 0.0)


def integers(vectors: DataFrame) -> DataFrame:
    """vec_id and ``x`` = floor(64 * c) + 1,000,000 of all vectors that take part."""
    small = F.forall("embedding", lambda c: F.abs(c) < LIMIT)
    good = F.coalesce(usable(F.col("embedding"), True) & small, F.lit(False))
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * float(FACTOR)) + F.lit(SHIFT))
    return vectors.filter(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _blocks(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and int64 matrix of the vectors of each length, a bounded number at once."""
    lists = batch.column(batch.num_columns - 1)
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        for at in range(0, len(rows), ROWS_AT_ONCE):
            part = rows[at : at + ROWS_AT_ONCE]
            flat = lists.take(pa.array(part)).flatten().to_numpy(zero_copy_only=False)
            yield part, flat.reshape(len(part), dim)


def _added_up(vectors: DataFrame, terms) -> dict[int, dict[int, int]]:
    """Per length and place the sum of what ``terms`` (int64 matrix to int64 sums) gives.

    Every task adds its blocks up without rounding and leaves one row per length and place;
    these are added as 38-digit decimals, so the result is exact whatever the order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _blocks(batch):
                part = terms(x).astype(object)
                totals[x.shape[1]] = totals.get(x.shape[1], 0) + part
        for dim, sums in totals.items():
            values = pa.array([Decimal(int(s)) for s in sums], pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(sums), dim), pa.int32()), pa.array(np.arange(len(sums))), values],
                schema=_PART,
            )

    parts = in_python(vectors.select("x"), run, "dim int, pos long, value decimal(38,0)")
    found: dict[int, dict[int, int]] = {}
    for row in parts.groupBy("dim", "pos").agg(F.sum("value").alias("value")).collect():
        found.setdefault(row["dim"], {})[row["pos"]] = int(row["value"])
    return found


def pair_squares(r: np.ndarray) -> np.ndarray:
    """Sums over all rows of r_i squared, then of (r_i + r_j) squared for i < j, by i and j."""
    found = [(r * r).sum(axis=0)]
    for i in range(r.shape[1] - 1):
        both = r[:, i : i + 1] + r[:, i + 1 :]
        found.append((both * both).sum(axis=0))
    return np.concatenate(found)


def covariance(n: int, rests: list[int], squares: dict[int, int]) -> np.ndarray:
    """The covariance matrix (divisor n), each entry rounded once.

    ``squares`` are sums over values less the whole part of their mean; ``rests`` the sums of
    these values. n * square - rest^2 is the sum of squares around the mean itself, times n.
    """
    dim = len(rests)
    var = [n * squares[i] - rests[i] ** 2 for i in range(dim)]
    found, at = np.zeros((dim, dim)), dim
    for i in range(dim):
        found[i, i] = float(Fraction(var[i], n * n))
        for j in range(i + 1, dim):
            both = n * squares[at] - (rests[i] + rests[j]) ** 2
            found[i, j] = found[j, i] = float(Fraction(both - var[i] - var[j], 2 * n * n))
            at += 1
    return found


def fit(vectors: DataFrame) -> dict[int, Fit]:
    """The fit of each vector length. Two passes over the vectors, no row leaves its task; the
    driver gets one sum per dimension and per pair of dimensions."""
    with_count = _added_up(vectors, lambda x: np.append(x.sum(axis=0), len(x)))
    if not with_count:
        return {}
    n = {dim: sums[dim] for dim, sums in with_count.items()}
    sums = {dim: [s[i] for i in range(dim)] for dim, s in with_count.items()}
    mean = {dim: np.array([s // n[dim] for s in sums[dim]], np.int64) for dim in sums}
    squares = _added_up(vectors, lambda x: pair_squares(x - mean[x.shape[1]]))
    found = {}
    for dim, s in sums.items():
        rests = [a - n[dim] * int(m) for a, m in zip(s, mean[dim])]
        cov = covariance(n[dim], rests, squares[dim])
        values, components = np.linalg.eigh(cov)
        order = np.argsort(-values, kind="stable")
        found[dim] = Fit(
            n[dim], s, mean[dim], np.array([float(Fraction(r, n[dim])) for r in rests]),
            components[:, order], np.maximum(values[order], 0.0), float(np.trace(cov)),
        )
    return found


def projected(x: np.ndarray, fit: Fit, top: int) -> np.ndarray:
    """Whitened rows: x less the mean, on the first components, each to variance one."""
    centred = (x - fit.mean) - fit.rest
    return centred @ fit.components[:, :top] * fit.scale()[:top]


def deviations(x: np.ndarray, fit: Fit) -> list[int]:
    """Of each row the sum of (n * x - S) squared, exact; cut to the largest long."""
    r = x - fit.mean
    rest = [s - fit.n * int(m) for s, m in zip(fit.sums, fit.mean)]
    if fit.n * (float(np.abs(r).max()) + 1) * np.sqrt(x.shape[1]) < 2.0**31:
        y = r * fit.n - np.array(rest, np.int64)
        return (y * y).sum(axis=1).tolist()
    y = r.astype(object) * fit.n - np.array(rest, object)
    return [min(2**63 - 1, int(s)) for s in (y * y).sum(axis=1)]


def identity_error(vectors: DataFrame, fits: dict[int, Fit], top: int) -> float:
    """Largest absolute entry of the whitened rows' covariance less the identity.

    Measured on the rows: every task takes the mean and the centred products of its rows;
    two such results add up by the difference of their means. Tasks are joined in groups
    first, so the last step sees few rows. Components without variance are left out.
    """

    def moments(z: np.ndarray) -> tuple:
        mean = z.mean(axis=0)
        return len(z), mean, (z - mean).T @ (z - mean)

    def joined(a: tuple, b: tuple) -> tuple:
        n, gap = a[0] + b[0], b[1] - a[1]
        return n, a[1] + gap * (b[0] / n), a[2] + b[2] + np.outer(gap, gap) * (a[0] * b[0] / n)

    def row(dim: int, part: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([dim], pa.int32()), pa.array([part[0]], pa.int64()),
             pa.array([part[1].tolist()], pa.list_(pa.float64())),
             pa.array([part[2].ravel().tolist()], pa.list_(pa.float64()))],
            names=["dim", "n", "mean", "products"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple] = {}
        for batch in batches:
            for _, x in _blocks(batch):
                dim = x.shape[1]
                part = moments(projected(x, fits[dim], top))
                totals[dim] = joined(totals[dim], part) if dim in totals else part
        for dim, part in totals.items():
            yield row(dim, part)

    def join_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, tuple] = {}
        for batch in batches:
            for r in batch.to_pylist():
                mean = np.array(r["mean"])
                part = r["n"], mean, np.array(r["products"]).reshape(len(mean), len(mean))
                totals[r["dim"]] = joined(totals[r["dim"]], part) if r["dim"] in totals else part
        for dim, part in totals.items():
            yield row(dim, part)

    kind = "dim int, n long, mean array<double>, products array<double>"
    parts = in_python(vectors.select("x"), run, kind)
    groups = max(1, int(parts.rdd.getNumPartitions() ** 0.5))
    if groups > 1:
        parts = in_python(parts.coalesce(groups), join_rows, kind)
    worst = 0.0
    totals: dict[int, tuple] = {}
    for r in parts.collect():
        mean = np.array(r["mean"])
        part = r["n"], mean, np.array(r["products"]).reshape(len(mean), len(mean))
        totals[r["dim"]] = joined(totals[r["dim"]], part) if r["dim"] in totals else part
    for dim, (n, _, products) in totals.items():
        some = np.flatnonzero(fits[dim].scale()[:top])
        if len(some):
            cov = products[np.ix_(some, some)] / n
            worst = max(worst, float(np.abs(cov - np.eye(len(some))).max()))
    return worst


def whiten(vectors: DataFrame, top: int = 32) -> DataFrame:
    """Per vector and component up to ``top``: vec_id, component, n, deviation, whitened,
    explained, identity_error.

    Vectors that are null, empty, or hold null or non-finite entries, or entries of LIMIT or
    more in size (their squares would fit no long), take no part. Vectors of each length are
    a fit of their own; ``identity_error`` is the largest of all. A component without
    variance (one row, equal rows, fewer rows than dimensions) is zero in every row and
    explains nothing. Null and repeated vec_ids and repeated vectors are rows of their own.
    No vector: no rows. Other columns are ignored.
    """
    read = integers(vectors)
    fits = fit(read)
    error = identity_error(read, fits, top) if fits else 0.0
    fields = "vec_id long, component int, n long, deviation long, whitened double," \
        " explained double, identity_error double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, x in _blocks(batch):
                own = fits[x.shape[1]]
                z = projected(x, own, top)
                m, k = z.shape
                share = own.values[:k] / own.trace if own.trace > 0 else np.zeros(k)
                ids = pa.array(np.repeat(rows, k))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(ids), pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()),
                    pa.array(np.full(m * k, own.n), pa.int64()),
                    pa.array(np.repeat(np.array(deviations(x, own), np.int64), k), pa.int64()),
                    pa.array(z.ravel()), pa.array(np.tile(share, m)), pa.array(np.full(m * k, error)),
                ], names=[f.split()[0] for f in fields.split(", ")])

    return in_python(read, run, fields)
