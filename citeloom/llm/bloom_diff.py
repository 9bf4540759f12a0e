"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A text is cut into paragraphs (lines and sentences, long ones further by their content) and
each becomes a 64-bit digest. A sketch deals every digest to one cell in each of three parts
and keeps, per cell, the number of digests, their exclusive or, and that of their check
values. Two sketches subtract cell by cell: what both versions share vanishes, and a cell left
with one digest gives it away, which empties it from its other cells, and so on (peeling).
Where peeling gets stuck both versions are sketched again with more cells, dealt anew.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import in_python

PARTS = 3
#: Cells of each part of a fingerprint; a stuck subtraction takes GROWTH times as many.
WIDTH = 8
GROWTH = 4
#: A paragraph of more bytes is cut after words picked by their own hash.
LONG = 256
#: Digests that a sketch of one cell may be expected to give back.
LOAD = 0.75
ROWS_AT_ONCE = 1000
#: A range of documents holds about this many at most; small tables have a range a partition.
ROWS_PER_RANGE = 100_000

_BREAK = re.compile(rb"[.!?]+\s+|[\r\n]+\s*")
_WORD = re.compile(rb"\S+\s*")
_MIX = np.uint64(0xBF58476D1CE4E5B9)

_ROWS = np.arange(PARTS)[:, None]
_PLACES = (np.arange(PARTS, dtype=np.uint64) * np.uint64(21))[:, None]


def paragraphs(text: bytes) -> list[bytes]:
    """The whole text in pieces, in order; their concatenation is the text."""
    ends = [m.end() for m in _BREAK.finditer(text)]
    if not ends or ends[-1] < len(text):
        ends.append(len(text))
    found, at = [], 0
    for end in ends:
        if end - at > LONG:
            for word in _WORD.finditer(text, at, end):
                if xxhash.xxh32_intdigest(word.group()) % 12 == 0 and word.end() < end:
                    found.append(text[at : word.end()])
                    at = word.end()
        if end > at:
            found.append(text[at:end])
            at = end
    return found


def digests(text: bytes) -> np.ndarray:
    """Different 64-bit digests of the paragraphs; the nth occurrence of one counts as another."""
    seen: dict[bytes, int] = {}
    found = []
    for piece in paragraphs(text):
        n = seen.get(piece, 0)
        seen[piece] = n + 1
        found.append(xxhash.xxh64_intdigest(piece, n))
    return np.unique(np.array(found, np.uint64))


def mixed(keys: np.ndarray, salt: int) -> np.ndarray:
    """Another value for each digest, which is evenly spread already."""
    x = (keys ^ np.uint64(salt * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) * _MIX
    return x ^ (x >> np.uint64(32))


class Sketch:
    """Cells of PARTS parts of ``width`` each: counts, digests and check values, combined."""

    def __init__(self, width: int, keys: np.ndarray | None = None):
        self.width = width
        self.count = np.zeros(PARTS * width, np.int64)
        self.key = np.zeros(PARTS * width, np.uint64)
        self.check = np.zeros(PARTS * width, np.uint64)
        if keys is not None and len(keys):
            self.add(keys, np.ones(len(keys), np.int64))

    def cells(self, keys: np.ndarray) -> np.ndarray:
        """The cell of each key (by column) in each part (by row); another width deals anew."""
        if self.width < 1 << 20:  # three places from one mixed value
            places = mixed(keys, self.width) >> _PLACES
        else:
            places = np.stack([mixed(keys, self.width + part) for part in range(PARTS)])
        # The width is a power of two.
        return (places & np.uint64(self.width - 1)).astype(np.int64) + _ROWS * self.width

    def add(self, keys: np.ndarray, signs: np.ndarray) -> None:
        check = mixed(keys, 1)
        for at in self.cells(keys):  # one part at a time: ufunc.at misreads broadcast values
            np.add.at(self.count, at, signs)
            np.bitwise_xor.at(self.key, at, keys)
            np.bitwise_xor.at(self.check, at, check)

    def minus(self, other: Sketch) -> Sketch:
        left = Sketch(self.width)
        left.count = self.count - other.count
        left.key = self.key ^ other.key
        left.check = self.check ^ other.check
        return left

    def peel(self) -> tuple[np.ndarray, np.ndarray] | None:
        """Digests only in the first and only in the second version; None if stuck. Empties self."""
        found: tuple[list, list] = ([], [])
        while True:
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[mixed(self.key[pure], 1) == self.check[pure]]
            if not len(pure):
                break
            keys, first = np.unique(self.key[pure], return_index=True)  # pure in several parts
            signs = self.count[pure[first]]
            found[0].append(keys[signs > 0])
            found[1].append(keys[signs < 0])
            self.add(keys, -signs)
        if self.count.any() or self.key.any() or self.check.any():
            return None
        none = np.empty(0, np.uint64)
        return tuple(np.concatenate([none, *side]) for side in found)


class Version:
    """A text with its digests and its sketches so far."""

    def __init__(self, text: str):
        self.text = text
        self.raw = text.encode()
        self.keys = digests(self.raw)
        self._sketches: dict[int, Sketch] = {}

    def sketch(self, width: int) -> Sketch:
        if width not in self._sketches:
            self._sketches[width] = Sketch(width, self.keys)
        return self._sketches[width]

    def fingerprint(self) -> str:
        """Number of digests, hash of the whole text (for the order), and the smallest sketch."""
        cells = self.sketch(WIDTH)
        packed = b"".join(
            part.tobytes()
            for part in (cells.count.astype("<i4"), cells.key.astype("<u8"), cells.check.astype("<u8"))
        )
        head = f"{len(self.keys):08x}{xxhash.xxh64_hexdigest(self.raw)}"
        return f"{head}:{base64.b64encode(packed).decode()}"


def difference(old: Version, new: Version) -> tuple[np.ndarray, np.ndarray, int]:
    """Digests only in ``old``, only in ``new``, and the width that gave them.

    Starts at the width that can hold the difference of the digest counts, which is there at
    least, and takes a larger one as long as peeling gets stuck.
    """
    width, least = WIDTH, abs(len(old.keys) - len(new.keys))
    while PARTS * width * LOAD < least:
        width *= 2
    while True:
        found = old.sketch(width).minus(new.sketch(width)).peel()
        if found is not None:
            return *found, width
        width *= GROWTH


def likeness(old: Version, new: Version) -> tuple[float, int, int]:
    """Share of the paragraphs of both versions that are in both, and how many differ by side."""
    if old.raw == new.raw:
        return 1.0, 0, 0
    gone, come, _ = difference(old, new)
    kept = len(old.keys) - len(gone)
    return kept / max(1, kept + len(gone) + len(come)), len(gone), len(come)


def _batches(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema
        )

    for row in rows:
        held.append(row)
        if len(held) >= ROWS_AT_ONCE:
            yield batch()
            held = []
    if held:
        yield batch()


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_paragraphs and fingerprint of every row. Null text: empty; other columns ignored."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_paragraphs", pa.int64()), ("fingerprint", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                version = Version(text or "")
                yield doc_id, len(version.keys), version.fingerprint()

    read = docs.select(F.col("doc_id").cast("long"), "text")
    return in_python(
        read, lambda b: _batches(rows(b), schema), "doc_id long, n_paragraphs long, fingerprint string"
    )


def compare(pairs: DataFrame, old: str, new: str) -> DataFrame:
    """Every row of ``pairs`` with its own columns as the struct ``pair`` and, of its two texts:
    likeness, and the digests only in the old (``removed``) and only in the new (``added``).

    Null text: empty. Repeated rows are compared each. No rows: no rows.
    """
    kind = pairs.schema.simpleString()
    read = pairs.select(F.struct("*").alias("pair"))
    longs = pa.list_(pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pair = batch.column(0)
            names = [f.name for f in pair.type]
            texts = (pair.field(names.index(name)).to_pylist() for name in (old, new))
            found = []
            for a, b in zip(*texts):
                a, b = Version(a or ""), Version(b or "")
                gone, come, _ = difference(a, b)
                found.append((likeness(a, b)[0], gone.astype(np.int64), come.astype(np.int64)))
            score, gone, come = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pair, pa.array(score, pa.float64()), pa.array(gone, longs), pa.array(come, longs)],
                names=["pair", "likeness", "removed", "added"],
            )

    return in_python(
        read, run, f"pair {kind}, likeness double, removed array<long>, added array<long>"
    )


def dealt_in_order(docs: DataFrame) -> DataFrame:
    """doc_id, text and ``ahead``, dealt to tasks by ranges of doc_id, largest first in each.

    Each task first gets a row marked ``ahead``: the text that follows its last document. The
    ranges come from quantiles of doc_id; an id on so many rows that it fills several ranges
    is dealt to all of them. Nothing but one id a range reaches the driver.
    """
    spark = docs.sparkSession
    read = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    slots = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read.count() // ROWS_PER_RANGE))
    shares = [i / slots for i in range(1, slots)] or [0.5]
    seen = read.agg(
        F.min("doc_id").alias("first"),
        F.percentile_approx("doc_id", shares, max(10_000, 10 * slots)).alias("cuts"),
        F.count("*").alias("n"), F.count("doc_id").alias("n_ids"),
    ).first()
    first, cuts = seen["first"], sorted(seen["cuts"] or [])[: slots - 1]
    bare = -(-slots * (seen["n"] - seen["n_ids"]) // max(1, seen["n"]))  # for rows without an id
    starts = sorted(set(cuts) | ({first} if first is not None else set()))
    copies = [max(1, cuts.count(s)) for s in starts]
    begin = [sum(copies[:i]) for i in range(len(starts))]
    total = sum(copies)

    at, key = F.lit(0), F.col("doc_id")
    if starts:  # binary search for the range of an id
        step = 1 << (len(starts).bit_length() - 1)
        steps = [step >> i for i in range(step.bit_length())]
        known = F.lit(starts)
        at = F.aggregate(
            F.lit(steps), F.lit(0),
            lambda found, s: F.when(
                F.coalesce(F.try_element_at(known, found + s) <= key, F.lit(False)), found + s
            ).otherwise(found),
        )
        at = F.greatest(at - 1, F.lit(0))
    start, share = F.get(F.lit(starts or [0]), at), F.get(F.lit(copies or [1]), at)
    spread = F.when(key == start, F.pmod(F.xxhash64("text"), share)).otherwise(share - 1)
    slot = F.when(
        key.isNull(), total + F.pmod(F.xxhash64("text"), F.lit(max(1, bare)))
    ).otherwise(F.get(F.lit(begin or [0]), at) + spread).cast("int")

    # The id that follows each slot: of the slots that hold one id only, the next larger one.
    after: dict[int, int | None] = {}
    if max(copies, default=1) > 1:
        larger = {
            r["at"]: r["id"]
            for r in read.filter(key > start).groupBy(at.alias("at")).agg(F.min("doc_id").alias("id")).collect()
        }
    for i, n in enumerate(copies):
        follows = starts[i + 1] if i + 1 < len(starts) else first
        for k in range(n):
            own = larger.get(i) if k < n - 1 else None
            after[begin[i] + k] = follows if own is None else own
    after |= {total + i: first for i in range(bare) if first is not None}
    ids = spark.createDataFrame(list(after.items()) or [], "slot int, doc_id long")
    ahead = (
        read.join(F.broadcast(ids), "doc_id").groupBy("slot").agg(F.min("text").alias("text"))
        .select("slot", F.lit(None).cast("long").alias("doc_id"), "text", F.lit(True).alias("ahead"))
    )
    rows = read.select(slot.alias("slot"), "doc_id", "text", F.lit(False).alias("ahead"))
    dealt = rows.unionByName(ahead).repartitionById(max(1, total + bare), "slot")
    return dealt.sortWithinPartitions(F.desc("ahead"), F.desc("doc_id")).select("doc_id", "text", "ahead")


def _followed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Version, Version]]:
    """Each document with the one that follows its id, from rows with the largest id first."""
    follows, lowest, current = Version(""), None, object()
    for batch in batches:
        columns = (batch.column(i).to_pylist() for i in range(3))
        for doc_id, text, ahead in zip(*columns):
            version = Version(text)
            if ahead:
                follows = version
                continue
            if doc_id != current:
                follows, lowest, current = lowest or follows, None, doc_id
            yield doc_id, version, follows
            if lowest is None or text < lowest.text:
                lowest = version


def compare_with_next(docs: DataFrame, share: int = 4) -> DataFrame:
    """Fingerprints every text and its edited text, and compares it with both neighbours.

    The edited text has its last floor(n_chars / share) code points replaced by the first as
    many (or all) of the next document. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and the numbers of paragraphs that only the
    text (``removed``) and only the edited text has (``added``).

    The next document is the one of the next larger doc_id, after the last the first; of
    several rows with one id, the smallest text. Rows without doc_id are followed by the
    first document, and by an empty text if no row has an id. Null text: empty; two empty
    texts are alike to 1. Repeated rows are returned each. Other columns are ignored.
    """
    fields = "doc_id long, n_chars long, edited_sha256 string, fingerprint string," \
        " edited_fingerprint string, near_edited double, near_next double, removed long, added long"
    kinds = {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}
    schema = pa.schema([(n, kinds[k]) for n, k in (f.split() for f in fields.split(","))])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for doc_id, version, follows in _followed(batches):
            n = len(version.text)
            taken = n // share
            edited = Version(version.text[: n - taken] + follows.text[:taken])
            near, removed, added = likeness(version, edited)
            yield (
                doc_id, n, hashlib.sha256(edited.raw).hexdigest(), version.fingerprint(),
                edited.fingerprint(), near, likeness(version, follows)[0], removed, added,
            )

    return in_python(dealt_in_order(docs), lambda b: _batches(rows(b), schema), fields)
