"""Nearest neighbours by inner product: int8 block products, bounds, exact recomputation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame

from citeloom.llm.vectors import (
    CANDIDATES_PER_BLOCK, QUERIES_PER_BLOCK, Pack, asked_rows, cut, exact, heaped, left_of_tile,
    packed, survivors, usable_rows,
)
from citeloom.session import stored

# Sums of this many products of two int8 are exact in single precision.
EXACT_WIDTH = 1024


def norms(rows: np.ndarray) -> np.ndarray:
    """Lengths of rows, without overflow of their squares."""
    most = np.abs(rows).max(axis=1)
    most[most == 0] = 1.0
    return most * np.sqrt(((rows / most[:, None]) ** 2).sum(axis=1))


def layer(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows as integers in -127..127 and the step of each row."""
    step = np.abs(rows).max(axis=1) / 127.0
    step[step == 0] = 1.0
    return np.rint(rows / step[:, None]).astype(np.int8), step


def quantise(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates: int8 codes; per row the step, the length of what is lost, its own length."""
    codes, step = layer(rows)
    lost = norms(rows - codes * step[:, None])
    return codes, np.stack([step, lost, norms(rows)], axis=1)


def quantise_queries(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Queries, which are few: a second layer of int8 for what the first loses."""
    first, step = layer(rows)
    rest = rows - first * step[:, None]
    second, fine = layer(rest)
    lost = norms(rest - second * fine[:, None])
    return np.concatenate([first, second], axis=1), np.stack([step, fine, lost, norms(rows)], axis=1)


def int8_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two int8 tiles, exact."""
    total = np.zeros((len(a), len(b)))
    for at in range(0, a.shape[1], EXACT_WIDTH):
        part = slice(at, at + EXACT_WIDTH)
        total += a[:, part].astype(np.float32) @ b[:, part].astype(np.float32).T
    return total


def bounds_of(q8: np.ndarray, q_grid: np.ndarray, c8: np.ndarray, c_grid: np.ndarray) -> tuple:
    """Lower and upper bounds of all inner products, from the int8 tiles alone.

    With q = q' + dq and c = c' + dc, the product differs from q'c' by q dc + dq c', at most
    |q| |dc| + |dq| (|c| + |dc|), and a little for rounding in doubles.
    """
    dim = c8.shape[1]
    step, fine, q_lost, q_norm = q_grid.T
    c_step, c_lost, c_norm = c_grid.T
    middle = int8_products(q8[:, :dim], c8) * step[:, None] + int8_products(q8[:, dim:], c8) * fine[:, None]
    middle *= c_step[None, :]
    c_most = c_norm + c_lost
    error = q_norm[:, None] * c_lost[None, :] + q_lost[:, None] * c_most[None, :]
    error = error * (1 + 1e-9) + 1e-14 * dim * q_norm[:, None] * c_most[None, :]
    return middle - error, middle + error


def bounds(queries: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from the rows themselves."""
    return bounds_of(*quantise_queries(queries), *quantise(rows))


def search_tile(k: int):
    def tile(q: Pack, c: Pack, best: np.ndarray | None) -> tuple:
        q_grid, c_grid = q.grid.reshape(len(q.ids), -1), c.grid.reshape(len(c.ids), -1)

        def bounded(part: slice, first: np.ndarray) -> tuple:
            return bounds_of(q.codes[part], q_grid[part], c.codes[first], c_grid[first])

        return left_of_tile(q.ids, c, k, bounded, best)

    return tile


def surviving(
    good: DataFrame, asking: DataFrame, k: int, queries_per_block: int, candidates_per_block: int
) -> DataFrame:
    """Stored pairs (query_id, vec_id, h) that the int8 bounds leave, over all tiles."""
    q = stored(packed(asking, quantise_queries, queries_per_block), "query-packs")
    c = stored(packed(good, quantise, candidates_per_block), "packs")
    types = (np.int8, np.float64, np.int8, np.float64)
    found = stored(survivors(q, c, search_tile(k), types), "survivors")
    return stored(cut(found, k).select("query_id", "vec_id", "h").distinct(), "pairs")


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    queries_per_block: int = QUERIES_PER_BLOCK,
    candidates_per_block: int = CANDIDATES_PER_BLOCK,
) -> DataFrame:
    """The k rows of largest inner product for each query: query_id, rank, vec_id, score.

    Tiles of queries and candidates are multiplied as int8; the error bound of each product
    leaves the pairs that can still be among the best, and these are recomputed in double
    precision on the original vectors and merged by heaps. So the answer is exact. Ties go
    to smaller vec_ids.

    Null vec_ids and vectors that are null, empty, zero or hold null or non-finite
    components take no part. Repeated rows are candidates of their own; rows of the query's
    own id never are. No query or no candidate: no rows. Other columns are ignored. Packs,
    bounds and exact vectors of survivors are written to the shared folder.
    """
    good = usable_rows(vectors, False)
    asking = asked_rows(good, is_query)
    pairs = surviving(good, asking, k, queries_per_block, candidates_per_block)
    scored = exact(pairs, good, asking, lambda a, b: (a * b).sum(axis=1), "double")
    return heaped(scored, k, "double")
