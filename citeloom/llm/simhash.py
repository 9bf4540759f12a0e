"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at distance r or less share a variant that lies within half the radius of
each. For an odd radius 2k + 1 the half is rounded by parity: an even fingerprint (even
number of ones) emits the variants at distance k, k - 2, ... and an odd one those at
k + 1, k - 1, ... Pairs of unlike parity are at an odd distance and meet at most k from the
even one; pairs of like parity are at an even distance, 2k or less, and meet as well. For an
even radius 2k all emit the whole ball of radius k.

Fingerprints meet by variant in two steps. The shuffle goes by the first bits of the variant
only (a fingerprint has few such prefixes); the remaining bits are flipped where the prefix
is worked on, so the many variants never cross the network. Of the fingerprints at one
variant, every one links to a member at most k away from the variant; this is the whole set
of links up to the transitive closure, without forming all pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import in_python, scratch_dir, stored

SEED = 42
#: Variants expanded at once by a task; a prefix with more is cut by further bits.
VARIANTS_AT_ONCE = 1_000_000
#: Fingerprints a prefix should hold before its neighbours' are added.
PER_PREFIX = 512


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text over XXH64 of its word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    spans = zip(*(words[i:] for i in range(shingle))) if n > 1 or len(words) == shingle else [words]
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, spans)), np.uint64, n
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << bit for bit in range(64) if 2 * int(ones[bit]) > n)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, text_key and fingerprint (as a signed long) of every row; A-Z is folded, words are
    runs of other than white space, a text without words has fingerprint zero."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            found = np.fromiter(
                (fingerprint(t.as_py() or b"", shingle) for t in texts), np.uint64, len(texts)
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array(found.view(np.int64))],
                ["doc_id", "text_key", "fingerprint"],
            )

    read = docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary"), text_key(F.col("text"))
    )
    return in_python(read, run, "doc_id long, text_key long, fingerprint long")


def text_key(text):
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(F.coalesce(text, F.lit(""))).alias("text_key")


def reach(values: np.ndarray, radius: int) -> np.ndarray:
    """The most bits each fingerprint flips."""
    half = radius // 2
    if radius % 2 == 0:
        return np.full(len(values), half)
    return half + (np.bitwise_count(values) & 1).astype(np.int64)


@lru_cache(maxsize=1024)
def _masks(width: int, flips: int) -> np.ndarray:
    """All masks of ``flips`` ones among the lowest ``width`` bits."""
    return np.array([sum(1 << b for b in c) for c in combinations(range(width), flips)], np.uint64)


def expand(
    values: np.ndarray, left: np.ndarray, width: int, step: int, limit: int, parts=()
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (variant, index of its fingerprint, flips still unused) of all variants whose
    bits above ``width`` are fixed; a variant's rows are all in one block.

    Fingerprints flip ``left``, ``left - step``, ... of their lowest ``width`` bits. If that
    makes too many variants, the next four bits are fixed, each value in turn.
    """
    index = parts if len(parts) else np.arange(len(values))
    per_left = [sum(math.comb(width, f) for f in range(n, -1, -step)) for n in range(left.max() + 1)]
    if sum(per_left[n] for n in left.tolist()) > limit and width >= 8:
        width -= 4
        own = (values >> np.uint64(width)) & np.uint64(15)
        for fixed in range(16):
            rest = left - np.bitwise_count(own ^ np.uint64(fixed)).astype(np.int64)
            keep = rest >= 0
            if keep.sum() > 1:
                yield from expand(values[keep], rest[keep], width, step, limit, index[keep])
        return
    low = np.uint64((1 << width) - 1)
    variants, who, unused = [], [], []
    for n in range(left.max() + 1):
        mine = np.flatnonzero(left == n)
        for flips in range(n, -1, -step) if len(mine) else ():
            masks = _masks(width, flips)
            variants.append(((values[mine] & low)[:, None] ^ masks[None, :]).ravel())
            who.append(np.repeat(index[mine], len(masks)))
            unused.append(np.full(len(mine) * len(masks), n - flips))
    yield np.concatenate(variants), np.concatenate(who), np.concatenate(unused)


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component label (smallest index) of n vertices joined by the edges a-b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        high = np.maximum(label[a], label[b])
        if (low == high).all():
            return label
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]


def links_of_prefix(values: np.ndarray, prefix: int, bits: int, radius: int) -> np.ndarray:
    """Index pairs that link the fingerprints meeting at variants with this prefix."""
    step = 2 if radius % 2 else 1
    most = reach(values, radius)
    width = 64 - bits
    spent = np.bitwise_count((values >> np.uint64(width)) ^ np.uint64(prefix)).astype(np.int64)
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for variant, who, unused in expand(values, most - spent, width, step, VARIANTS_AT_ONCE):
        # A member may stand for its variant if it lies at most half the radius away.
        far = (most[who] - unused) > radius // 2
        order = np.lexsort((who, far, variant))
        variant, who, far = variant[order], who[order], far[order]
        fresh = np.append(True, variant[1:] != variant[:-1])
        centre = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        link = ~fresh & ~far[centre]
        pairs = np.unique(who[centre[link]] * len(values) + who[link])
        a.append(pairs // len(values))
        b.append(pairs % len(values))
    left, right = np.concatenate(a), np.concatenate(b)
    apart = np.bitwise_count(values[left] ^ values[right])
    left, right = left[apart <= radius], right[apart <= radius]
    label = spanning(len(values), left, right)
    joined = np.flatnonzero(label != np.arange(len(values)))
    return np.stack([label[joined], joined])


def links(prints: DataFrame, radius: int, count: int) -> DataFrame:
    """Links (a, b) whose closure is that of all pairs at most ``radius`` bits apart.

    ``prints`` holds the distinct fingerprints, ``count`` how many. Pairs within a variant
    are checked by their bit distance; those of one prefix are reduced to a spanning forest,
    so a prefix returns fewer links than it holds fingerprints.
    """
    bits = min(24, max(8, math.ceil(math.log2(max(2, count) / PER_PREFIX)) + 3))
    shifted = F.shiftrightunsigned("fingerprint", 64 - bits)
    half = radius // 2
    odd = F.bit_count("fingerprint") % 2 if radius % 2 else F.lit(0)
    flips = [
        [sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(bits), n)]
        for most in (half, half + 1)
    ]
    masks = F.when(odd == 0, F.array(*[F.lit(m) for m in flips[0]]))
    masks = masks.otherwise(F.array(*[F.lit(m) for m in flips[1]])) if radius % 2 else masks
    reached = prints.select("fingerprint", F.explode(masks).alias("mask"), shifted.alias("own"))
    by_prefix = reached.select("fingerprint", F.col("own").bitwiseXOR(F.col("mask")).alias("prefix"))
    per_print = (len(flips[0]) + len(flips[-1])) / 2
    least = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, math.ceil(count * per_print / 1_000_000))
    grouped = by_prefix.repartition(tasks, "prefix").sortWithinPartitions("prefix")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(prefix: int, found: list[np.ndarray]) -> pa.RecordBatch:
            values = np.sort(np.concatenate(found)).view(np.uint64)
            a, b = links_of_prefix(values, prefix, bits, radius)
            pair = [pa.array(values[x].view(np.int64)) for x in (a, b)]
            return pa.RecordBatch.from_arrays(pair, ["a", "b"])

        at, held = None, []
        for batch in batches:
            prints, prefixes = (c.to_numpy() for c in batch.columns)
            cuts = np.flatnonzero(prefixes[1:] != prefixes[:-1]) + 1
            for part, which in zip(np.split(prints, cuts), np.split(prefixes, cuts)):
                if at is not None and len(which) and which[0] != at:
                    yield made(at, held)
                    held = []
                if len(which):
                    at = int(which[0])
                    held.append(part)
        if held:
            yield made(at, held)

    return in_python(grouped, run, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable vertex of each vertex of ``edges`` (a, b): vertex, root.

    Alternates linking each vertex's larger neighbours, then all its smaller ones, to its
    smallest neighbour, until the edges stay the same; each round is written to the shared
    folder. A vertex of very many edges is only joined on, never gathered.
    """
    spark = edges.sparkSession
    base = scratch_dir(spark, "components")
    edges.filter("a <> b").select("a", "b").write.parquet(f"{base}/0")
    now, seen = spark.read.parquet(f"{base}/0"), None
    for n in range(1, 100):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(lowest, "a").filter("b > a").select(F.col("b").alias("u"), F.col("m").alias("v"))
        down = large.filter("u <> v").select(
            F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")
        ).distinct()
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(
            F.struct(F.col("a").alias("u"), F.col("m").alias("v")),
            F.struct(F.col("b").alias("u"), F.col("m").alias("v")),
        )).alias("e")).select("e.u", "e.v")
        small.filter("u <> v").select(F.col("u").alias("a"), F.col("v").alias("b")).distinct().write.parquet(f"{base}/{n}")
        now = spark.read.parquet(f"{base}/{n}")
        state = now.agg(
            F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")), F.lit(0))
        ).first()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    rooted = now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return rooted.union(rooted.select(F.col("root").alias("vertex"), "root")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """Every row with its fingerprint and its group of near-duplicates.

    Columns: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by
    links of at most ``radius`` differing bits), component_print (smallest fingerprint of the
    group, which names it also where doc_ids are null).

    Null and empty texts have fingerprint zero and are linked like others; fewer words than
    ``shingle`` form one shingle. Null doc_ids take part but are never a component_id unless
    the whole group has none (then null); repeated rows stay. An empty table gives no rows;
    other columns are ignored. Equal fingerprints are one vertex, so copies cost nothing
    beyond their own row.
    """
    printed, groups = _groups(docs, shingle, radius)
    return printed.join(groups, "fingerprint").select(
        "doc_id", hexed(F.col("fingerprint")).alias("fingerprint"), "component_id",
        hexed(F.col("component_print")).alias("component_print"),
    )


def _groups(docs: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame]:
    """The printed rows (stored), and of each fingerprint component_id and component_print."""
    printed = stored(fingerprints(docs, shingle), "fingerprints")
    vertices = printed.groupBy("fingerprint").agg(F.min("doc_id").alias("least"))
    vertices = stored(vertices, "vertices")
    edges = links(vertices.select("fingerprint"), radius, vertices.count())
    roots = components(edges)
    rooted = vertices.join(roots, vertices["fingerprint"] == roots["vertex"], "left").select(
        "fingerprint", "least", F.coalesce("root", "fingerprint").alias("root")
    )
    named = rooted.groupBy("root").agg(
        F.min("least").alias("component_id"),
        F.min_by("fingerprint", hexed(F.col("fingerprint"))).alias("component_print"),
    )
    return printed, rooted.select("fingerprint", "root").join(named, "root").drop("root")


def hexed(value):
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def one_of_each(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """The documents with one row of each near-duplicate group: that of the smallest doc_id.

    Where that id is repeated, or a group has no ids, one of its rows stays (of equal ids
    that of the smallest text key; equal rows are alike). Null and empty texts are one group.
    No rows: no rows. Rows travel as one struct, so their columns may have any names.
    """
    printed, groups = _groups(docs, shingle, radius)
    own = printed.join(groups, "fingerprint").filter(F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = own.groupBy("component_print").agg(F.min(F.struct("doc_id", "text_key")).alias("c"))
    keys = chosen.select(
        F.col("c.doc_id").alias("kept_id"), F.col("c.text_key").alias("kept_key"),
        F.col("component_print").alias("kept_group"),
    )
    here = F.col("d.doc_id").eqNullSafe(F.col("k.kept_id")) & (
        text_key(F.col("d.text")) == F.col("k.kept_key")
    )
    rows = docs.select(F.struct("*").alias("row"), "doc_id", "text")
    met = rows.alias("d").join(keys.alias("k"), here).select("d.row", "k.kept_group")
    return met.dropDuplicates(["kept_group"]).select("row.*")
