"""Shared parts of the block searches: usable vectors, packs, survivors, exact merge.

Vectors travel as packs: some thousand rows of one length as one row of codes, a byte per
component. Every pack of queries meets every pack of candidates, and a tile yields the pairs
whose bounds leave them among the best. The bounds of all tiles are merged per query, and
only for what is left the exact vectors are fetched, by id and hash.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import BROADCAST_BYTES, in_python, salted_join, stored

QUERIES_PER_BLOCK = 4096
CANDIDATES_PER_BLOCK = 8192
#: Queries of a tile that are bounded at once.
ROWS_AT_ONCE = 256

PACK = "dim int, n int, ids binary, hashes binary, codes binary, grid binary"
SURVIVOR = "query_id long, vec_id long, h long, low double, high double"


class Pack(NamedTuple):
    """Rows of one length: ids, hashes of the vectors, their codes, what the codes mean."""

    ids: np.ndarray
    hashes: np.ndarray
    codes: np.ndarray
    grid: np.ndarray


def usable(embedding: Column, zero_counts: bool) -> Column:
    """Not null, not empty, without null or non-finite components; not zero unless allowed."""
    finite = F.forall(
        embedding,
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")),
    )
    good = embedding.isNotNull() & (F.size(embedding) > 0) & finite
    if not zero_counts:
        good = good & F.exists(embedding, lambda x: x != 0)
    return F.coalesce(good, F.lit(False))


def matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and matrix (double) of the vectors of each length."""
    lengths = lists.value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(lengths):
        rows = np.flatnonzero(lengths == dim)
        flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False)
        yield rows, flat.reshape(len(rows), dim).astype(np.float64)


Encode = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]


def packed(vectors: DataFrame, encode: Encode, rows_per_pack: int) -> DataFrame:
    """Packs of (vec_id, h, embedding) rows, made where the rows lie.

    ``encode`` maps a matrix to its codes and their grid. A task holds at most a few packs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}

        def pack(dim: int, n: int) -> pa.RecordBatch:
            ids, hashes, rows = (np.concatenate(part) for part in zip(*held[dim]))
            held[dim] = [(ids[n:], hashes[n:], rows[n:])] if len(ids) > n else []
            codes, grid = encode(rows[:n])
            values = [dim, min(n, len(ids)), *(x.tobytes() for x in (ids[:n], hashes[:n], codes, grid))]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(values, [pa.int32(), pa.int32(), *[pa.binary()] * 4])],
                names=[f.split()[0] for f in PACK.split(", ")],
            )

        for batch in batches:
            ids, hashes = (batch.column(i).to_numpy() for i in range(2))
            for rows, matrix in matrices(batch.column(2)):
                dim = matrix.shape[1]
                held.setdefault(dim, []).append((ids[rows], hashes[rows], matrix))
                while sum(len(part[0]) for part in held[dim]) >= rows_per_pack:
                    yield pack(dim, rows_per_pack)
            while sum(len(part[0]) for parts in held.values() for part in parts) > 2 * rows_per_pack:
                fullest = max(held, key=lambda d: sum(len(part[0]) for part in held[d]))
                yield pack(fullest, rows_per_pack)
        for dim, parts in held.items():
            if parts:
                yield pack(dim, rows_per_pack)

    return in_python(vectors.select("vec_id", "h", "embedding"), run, PACK)


def survivors(
    queries: DataFrame, candidates: DataFrame, tile: Callable[[Pack, Pack], tuple], decode: tuple
) -> DataFrame:
    """(query_id, vec_id, h, low, high) of the pairs that a tile leaves, from stored packs.

    ``decode`` has the types of query codes, query grid, candidate codes and candidate grid.
    Up to BROADCAST_BYTES the packs of queries go to the packs of candidates, which stay in
    place; beyond that both are dealt over a square of tasks, each pack of queries to all
    columns of its row, each pack of candidates to all rows of its column. A task carries the
    best lower bounds of its queries from tile to tile, so later tiles leave little.
    """
    names = ["dim", "n", "ids", "hashes", "codes", "grid"]
    q = queries.select("dim", F.struct(*names).alias("q"))
    c = candidates.select("dim", F.struct(*names).alias("c"))
    size = queries.agg(F.coalesce(F.sum(sum((F.octet_length(n) for n in names[2:]), F.lit(0))), F.lit(0)))
    if size.first()[0] <= BROADCAST_BYTES:
        met = c.join(F.broadcast(q), "dim")
    else:
        rows, columns = (max(1, round(t.count() ** 0.5)) for t in (queries, candidates))
        by = F.pmod(F.xxhash64("q.ids"), F.lit(rows)).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("column")
        q = q.select("*", *by)
        by = F.pmod(F.xxhash64("c.ids"), F.lit(columns)).alias("column"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("row")
        met = c.select("*", *by).join(q, ["dim", "row", "column"])

    def unpacked(struct: dict, codes, grid) -> Pack:
        n = struct["n"]
        return Pack(
            np.frombuffer(struct["ids"], np.int64), np.frombuffer(struct["hashes"], np.int64),
            np.frombuffer(struct["codes"], codes).reshape(n, -1), np.frombuffer(struct["grid"], grid),
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[bytes, np.ndarray] = {}  # of each pack of queries, the best lower bounds so far
        for batch in batches:
            for i in range(batch.num_rows):  # one tile at a time
                a, b = (batch.column(j)[i].as_py() for j in range(2))
                found, best[a["ids"]] = tile(
                    unpacked(a, *decode[:2]), unpacked(b, *decode[2:]), best.get(a["ids"])
                )
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in found], names=[f.split()[0] for f in SURVIVOR.split(", ")]
                )

    return in_python(met.select("q", "c"), run, SURVIVOR)


def left_of_tile(query_ids: np.ndarray, c: Pack, k: int, bounds: Callable, best: np.ndarray | None) -> tuple:
    """Survivors of a tile, and the k best lower bounds of each query so far.

    ``bounds`` gives lower and upper bounds of some queries (by a slice) against some
    candidates (by number), ``best`` holds the k best lower bounds of earlier tiles.
    """
    best = np.full((len(query_ids), k), -np.inf) if best is None else best
    raw = np.concatenate([c.codes.view(np.uint8).reshape(len(c.ids), -1), c.hashes.view(np.uint8).reshape(-1, 8)], axis=1)
    first, owners, smallest, shared = distinct_rows(c.ids, raw, k)
    found: list[tuple] = []
    for at in range(0, len(query_ids), ROWS_AT_ONCE):
        part = slice(at, at + ROWS_AT_ONCE)
        low, high = bounds(part, first)
        own = only_own(query_ids[part], smallest, shared)
        # Every vector that counts for the floor has a row that may be an answer.
        all_low = np.concatenate([np.where(own, -np.inf, low), best[part]], axis=1)
        best[part] = -np.partition(-all_low, k - 1, axis=1)[:, :k]
        floor = best[part].min(axis=1)
        n, j = np.nonzero((high >= floor[:, None]) & ~own)
        times = np.fromiter((len(owners[x]) for x in j), np.int64, len(j))
        ids = np.concatenate([np.empty(0, np.int64), *(owners[x] for x in j)])
        n, j = np.repeat(n, times), np.repeat(j, times)
        other = ids != query_ids[part][n]
        n, j, ids = n[other], j[other], ids[other]
        found.append((query_ids[part][n], ids, c.hashes[first[j]], low[n, j], high[n, j]))
    return tuple(np.concatenate(x) for x in zip(*found)), best


def cut(found: DataFrame, k: int, bound: str = "low") -> DataFrame:
    """Survivors whose upper bound reaches the kth best ``bound`` of their query, over all tiles."""
    order = Window.partitionBy("query_id").orderBy(F.col(bound).desc())
    best = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= k)
    floors = best.groupBy("query_id").agg(
        F.when(F.count("*") == k, F.min(bound)).otherwise(float("-inf")).alias("floor")
    )
    return found.join(floors, "query_id").filter(F.col("high") >= F.col("floor")).drop("floor")


def exact(
    pairs: DataFrame, good: DataFrame, asking: DataFrame, score: Callable, score_type: str
) -> DataFrame:
    """(query_id, vec_id, score, copies) of stored pairs, from the exact vectors.

    Only vectors of a pair are read on; equal rows of an id are one vector with its copies.
    Each side that is small enough goes to the other, see ``salted_join``.
    """
    wanted = stored(pairs.select("vec_id", "h").distinct(), "wanted")
    read = salted_join(good, wanted, ["vec_id", "h"], "h", 1)
    vectors = stored(
        read.groupBy("vec_id", "h", "embedding").agg(F.count("*").alias("copies")), "vectors"
    )
    with_rows = salted_join(pairs.select("query_id", "vec_id", "h"), vectors, ["vec_id", "h"], "query_id", 1)
    both = salted_join(
        with_rows.select("query_id", "vec_id", "embedding", "copies"),
        asking.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("asked")),
        ["query_id"], "vec_id", 1,
    ).filter(F.size("asked") == F.size("embedding"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (rows, a), (_, b) in zip(matrices(batch.column(4)), matrices(batch.column(2))):
                at = pa.array(rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(at), batch.column(1).take(at), pa.array(score(a, b)), batch.column(3).take(at)],
                    names=["query_id", "vec_id", "score", "copies"],
                )

    chosen = both.select("query_id", "vec_id", "embedding", "copies", "asked")
    return in_python(chosen, run, f"query_id long, vec_id long, score {score_type}, copies long")


def heaped(scored: DataFrame, k: int, score_type: str) -> DataFrame:
    """The k best rows per query, ranked; ties to smaller ids. A query's rows pass one heap of k."""
    kind = {"long": pa.int64(), "double": pa.float64()}[score_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heap: list[tuple] = []
        asked = None

        def done() -> pa.RecordBatch:
            best = sorted(heap, reverse=True)
            return pa.RecordBatch.from_arrays(
                [pa.array([asked] * len(best), pa.int64()), pa.array(range(1, len(best) + 1), pa.int32()),
                 pa.array([-i for _, i in best], pa.int64()), pa.array([s for s, _ in best], kind)],
                names=["query_id", "rank", "vec_id", "score"],
            )

        for batch in batches:
            for query_id, vec_id, score, copies in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if query_id != asked:
                    if heap:
                        yield done()
                    heap, asked = [], query_id
                for _ in range(min(copies, k)):
                    if len(heap) < k:
                        heapq.heappush(heap, (score, -vec_id))
                    elif (score, -vec_id) > heap[0]:
                        heapq.heapreplace(heap, (score, -vec_id))
                    else:
                        break
        if heap:
            yield done()

    dealt = scored.repartition("query_id").sortWithinPartitions("query_id")
    return in_python(dealt, run, f"query_id long, rank int, vec_id long, score {score_type}")


def usable_rows(vectors: DataFrame, zero_counts: bool) -> DataFrame:
    """vec_id, h (hash of the vector) and embedding of the rows that take part."""
    read = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    good = read.filter(F.col("vec_id").isNotNull() & usable(F.col("embedding"), zero_counts))
    return good.select("vec_id", F.xxhash64("embedding").alias("h"), "embedding")


def asked_rows(good: DataFrame, is_query: Column) -> DataFrame:
    """Queries are one per vec_id; if an id is repeated, its smallest vector asks. Stored."""
    asking = good.filter(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    return stored(asking.withColumn("h", F.xxhash64("embedding")), "asking")


def distinct_rows(
    ids: np.ndarray, rows: np.ndarray, k: int
) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
    """The first row of each different vector (given as bytes), the ids of each in order and
    once, its smallest id and whether it has others.

    Of one id at most k rows count and of a vector at most 2 k: whichever id asks, its own
    rows are k of these at most, so the k smallest of the others are there. With ties going
    to smaller ids, no answer needs more.
    """
    raw = np.ascontiguousarray(rows).view(np.dtype((np.void, rows.shape[1]))).ravel()
    _, first, inverse = np.unique(raw, return_index=True, return_inverse=True)
    by_vector = np.lexsort((ids, inverse))
    starts = np.searchsorted(inverse[by_vector], np.arange(len(first)))
    ends = np.append(starts[1:], len(ids))
    held = ids[by_vector]
    owners = []
    for a, b in zip(starts, ends):
        own = held[a:b]
        if b - a > 1:
            own = own[np.arange(len(own)) - np.searchsorted(own, own) < k][: 2 * k]
            own = np.unique(own)
        owners.append(own)
    return first, owners, held[starts], held[starts] != held[ends - 1]


def only_own(query_ids: np.ndarray, smallest: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For every query and different vector: whether all its rows are of the query's id."""
    return (query_ids[:, None] == smallest[None, :]) & ~shared[None, :]
