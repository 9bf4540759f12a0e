"""Exact top-k by integer inner product with vector-approximation files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.llm.vectors import (
    CANDIDATES_PER_BLOCK, QUERIES_PER_BLOCK, Pack, asked_rows, cut, exact, heaped, left_of_tile,
    packed, survivors, usable_rows,
)
from citeloom.session import stored

CELL_BITS = 6
#: Below this, sums of products are exact in doubles and in longs.
_EXACT = 2.0**52


def approximate(rows: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cells (uint8) of integer rows, and each dimension's lowest value and cell width."""
    lowest = rows.min(axis=0)
    width = np.ceil((rows.max(axis=0) - lowest + 1) / (1 << bits))
    return ((rows - lowest) // width).astype(np.uint8), lowest, width


def encoder(factor: int, bits: int):
    """Rows to cells and, as their grid, the lowest values and the cell widths."""

    def encode(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cells, lowest, width = approximate(np.floor(rows * factor), bits)
        return cells, np.concatenate([lowest, width])

    return encode


def search_tile(k: int):
    """Bounds from cells: the score of the query with the low corner of a cell is off by at
    most its positive (negative) components times the cell's width."""

    def tile(q: Pack, c: Pack, best: np.ndarray | None) -> tuple:
        lowest, width = np.split(c.grid, 2)
        corner = lowest + c.codes * width
        largest = np.abs(q.codes).max() * (np.abs(corner).max() + width.max())
        # A unit in the last place of each step bounds rounding when values are large.
        slack = 0.0 if largest * len(lowest) < _EXACT else float(largest) * len(lowest) ** 2 * 2.0**-50

        def bounded(part: slice, first: np.ndarray) -> tuple:
            asked = q.codes[part]
            base = asked @ corner[first].T
            up = np.maximum(asked, 0) @ (width - 1) + slack
            down = np.minimum(asked, 0) @ (width - 1) - slack
            return base + down[:, None], base + up[:, None]

        return left_of_tile(q.ids, c, k, bounded, best)

    return tile


def products(factor: int):
    """Integer inner products of rows with rows, cut to longs."""

    def score(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a, b = np.floor(a * factor), np.floor(b * factor)
        if not len(a) or np.abs(a).max() * np.abs(b).max() * a.shape[1] < _EXACT:
            return (a * b).sum(axis=1).astype(np.int64)
        top = 2**63 - 1
        exact_sums = (sum(int(x) * int(y) for x, y in zip(*pair)) for pair in zip(a.tolist(), b.tolist()))
        return np.array([max(-top, min(top, s)) for s in exact_sums], np.int64)

    return score


def scanned(
    good: DataFrame, asking: DataFrame, k: int, factor: int, bits: int,
    queries_per_block: int, candidates_per_block: int,
) -> DataFrame:
    """Stored (query_id, vec_id, h, high) that the files of cells leave, over all files."""
    def integers(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.floor(rows * factor), np.empty(0)

    q = stored(packed(asking, integers, queries_per_block), "query-packs")
    c = stored(packed(good, encoder(factor, bits), candidates_per_block), "cells")
    types = (np.float64, np.float64, np.uint8, np.float64)
    found = stored(survivors(q, c, search_tile(k), types), "survivors")
    left = cut(found, k).groupBy("query_id", "vec_id", "h").agg(F.max("high").alias("high"))
    return stored(left, "pairs")


def top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    factor: int = 64,
    bits: int = CELL_BITS,
    queries_per_block: int = QUERIES_PER_BLOCK,
    candidates_per_block: int = CANDIDATES_PER_BLOCK,
) -> DataFrame:
    """The k highest integer inner products per query: query_id, rank, vec_id, score.

    Components become floor(factor * x). The candidates lie as files of cells, ``bits`` bits
    per dimension, made where the rows are; scanning these alone bounds every score. The
    exact vectors are then read in the order of the upper bound: first each query's k
    highest, and of the others those whose bound still reaches the kth score found, after
    which the answer is certain. Ties go to smaller vec_ids.

    Null vec_ids and vectors that are null, empty or hold null or non-finite components take
    no part; zero vectors do. Repeated rows are candidates of their own; rows of the query's
    own id never are. Scores beyond 64 bits are cut to the largest long. No query or no
    candidate: no rows. Other columns are ignored.
    """
    good = usable_rows(vectors, True)
    asking = asked_rows(good, is_query)
    pairs = scanned(good, asking, k, factor, bits, queries_per_block, candidates_per_block)
    order = Window.partitionBy("query_id").orderBy(F.col("high").desc(), "vec_id", "h")
    first = pairs.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    first = stored(first.drop("place"), "first")
    score = products(factor)
    known = stored(exact(first, good, asking, score, "long"), "known")
    kth = heaped(known, k, "long").filter(F.col("rank") == k)
    floors = kth.select("query_id", F.col("score").cast("double").alias("floor"))
    open_pairs = pairs.join(first, ["query_id", "vec_id", "h"], "left_anti").join(
        floors, "query_id", "left"
    )
    # A double next below the score, should the score have no double of its own.
    reach = F.col("floor") - F.abs("floor") * F.lit(2.0**-50)
    later = stored(open_pairs.filter(F.col("floor").isNull() | (F.col("high") >= reach)).drop("floor"), "later")
    return heaped(known.unionByName(exact(later, good, asking, score, "long")), k, "long")
