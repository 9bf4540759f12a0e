"""Language-model scores: a Katz back-off bigram model, counted and evaluated by word buckets.

Model. Tokens are words (A-Z folded) and one end per text. A bigram seen r times in training
after a context seen c times has probability d(r) * r / c; d is the Good-Turing discount for
r up to ``LARGEST``, and above it leaves a hundredth of a count, so that every context keeps
mass for what it has not seen. An unseen bigram backs off to alpha(context) * P(word) with
P(word) = (count + 1) / (N + V + 1); alpha makes each context's probabilities sum to one
exactly. A context never seen uses P(word) itself.

Work. Every text is cut into (word, context, document) counts, and these meet by word in
buckets: there the training counts of a bigram are complete and are applied at once to all
documents that hold it. Each bucket leaves tables, partitioned by kind: the bigram counts
themselves, sums per document, the seen followers of each context (all that its alpha needs),
the unseen bigrams. From the stored counts ``score_texts`` scores any other texts, token by
token: the discounted count, or the back-off weight and the word's own probability. The
discounts follow from counts of counts over all buckets; only then is anything scored, so the
sums keep r = 1..LARGEST apart. Words so frequent that one would fill a bucket are counted
first and spread over all buckets by their context.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.session import in_python, scratch_dir

LARGEST = 5
LEAST_MASS = 0.01
#: Neither can be a word.
END, START = (xxhash.xxh64_intdigest(s) for s in (b"", b" "))
TOKENS_PER_CHUNK = 1_000_000
DOCS_PER_CHUNK = 1 << 20
TOKENS_PER_BUCKET = 3_000_000
GRAMS_AT_ONCE = 500_000
ROWS_AT_ONCE = 100_000
WORDS_HELD = 200_000
LOOK_FOR = 8  # a word with 1 / (8 * buckets) of a task's tokens may be frequent


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _read(docs: DataFrame, training: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"),
        F.coalesce(training, F.lit(False)).alias("training"),
    )


def token_total(read: DataFrame) -> int:
    """Tokens of all texts, ends included."""
    n = F.regexp_count(F.coalesce(F.col("text").cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    return read.agg(F.coalesce(F.sum(n + 1), F.lit(0))).first()[0]


def frequent_words(read: DataFrame, buckets: int, total: int) -> dict[int, int]:
    """Training counts of all words that make up over half a bucket; fewer than 2 * buckets.

    First every task names its candidates (at most 8 * buckets), then the few that are
    frequent in sum are counted exactly.
    """

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, met, most = Counter(), 0, WORDS_HELD
        for batch in batches:
            for text in batch.column("text"):
                words = words_of(text.as_py())
                found.update(words)
                found[b""] += 1
                met += len(words) + 1
                if len(found) > most:
                    # Lossy counting: what is rare so far starts again from nothing.
                    rare = max(2, met / (4 * LOOK_FOR * buckets))
                    found = Counter({w: n for w, n in found.items() if n >= rare})
                    most = max(WORDS_HELD, 2 * len(found))
        least = met / (LOOK_FOR * buckets)
        rows = [(w, n) for w, n in found.items() if n >= least]
        columns = zip(*rows) if rows else [[]] * 2
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["word", "n"])
        del found, rows, columns, arrays
        give_back()

    named = in_python(read.select("text"), candidates, "word binary, n long")
    likely = named.groupBy("word").agg(F.sum("n").alias("n")).filter(
        F.col("n") >= total / (4 * buckets)
    )
    wanted = frozenset(bytes(r["word"]) for r in likely.collect())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {True: Counter(), False: Counter()}
        for batch in batches:
            for text, training in zip(batch.column("text"), batch.column("training")):
                own = found[training.as_py()]
                own.update([w for w in words_of(text.as_py()) if w in wanted])
                own[b""] += b"" in wanted
        rows = [(w, n, n if t else 0) for t, own in found.items() for w, n in own.items()]
        columns = zip(*rows) if rows else [[]] * 3
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(arrays, ["word", "n", "trained"])

    if not wanted:
        return {}
    exact = in_python(read, counted, "word binary, n long, trained long").groupBy("word").agg(
        F.sum("n").alias("n"), F.sum("trained").alias("trained")
    )
    rows = exact.filter(F.col("n") >= total / (2 * buckets)).collect()
    return {xxhash.xxh64_intdigest(bytes(r["word"])): r["trained"] for r in rows}


# Payloads: arrays of one chunk and bucket, compressed


def packed(*arrays: np.ndarray) -> bytes:
    parts = []
    for a in arrays:
        # Whole numbers in the fewest bytes, most significant bytes together.
        kind = np.min_scalar_type(int(a.max()) if len(a) else 0) if a.dtype.kind == "u" else a.dtype
        a = np.ascontiguousarray(a.astype(kind))
        raw = a.view(np.uint8).reshape(len(a), kind.itemsize).T.tobytes()
        squeezed = pa.compress(raw, codec="zstd", asbytes=True) if raw else b""
        head = np.array([kind.itemsize, len(a), len(squeezed)], np.int64).tobytes()
        parts += [head, squeezed]
    return b"".join(parts)


def unpacked(payload: bytes) -> list[np.ndarray]:
    arrays, at = [], 0
    while at < len(payload):
        size, n, length = np.frombuffer(payload, np.int64, 3, at).tolist()
        at += 24
        raw = pa.decompress(payload[at : at + length], size * n, "zstd", asbytes=True) if n else b""
        at += length
        planes = np.frombuffer(raw, np.uint8).reshape(size, n) if n else np.zeros((size, 0), np.uint8)
        arrays.append(np.ascontiguousarray(planes.T).view(f"<u{size}").ravel())
    return arrays


GRAMS = "bucket int, payload binary, doc long, doc_id long, training boolean, n_tokens long"
_GRAMS = pa.schema([
    ("bucket", pa.int32()), ("payload", pa.binary()), ("doc", pa.int64()), ("doc_id", pa.int64()),
    ("training", pa.bool_()), ("n_tokens", pa.int64()),
])


def give_back() -> None:
    """Return freed memory to the system: a task's worker lives on beside the next one."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)


class Chunk:
    """Documents of one task until there are enough, then their grams by bucket."""

    def __init__(self, base: int, home: int, buckets: int, frequent: dict[int, int]):
        # ``home`` is the bucket that takes the documents' own rows.
        self.base, self.home, self.buckets, self.frequent = base, home, buckets, frequent
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.number[b""], self.number[b" "]  # the end is 0, the start 1
        self.tokens, self.rows, self.size = [], [], 0

    def add(self, doc_id: int | None, text: bytes | None, training: bool) -> None:
        words = words_of(text)
        own = np.zeros(len(words) + 1, np.int32)
        own[:-1] = np.fromiter(map(self.number.__getitem__, words), np.int32, len(words))
        self.tokens.append(own)
        self.rows.append((doc_id, training, len(own)))
        self.size += len(own)

    def full(self) -> bool:
        return self.size >= TOKENS_PER_CHUNK or len(self.rows) >= DOCS_PER_CHUNK

    def grams(self) -> Iterator[pa.RecordBatch]:
        if not self.rows:
            return
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, self.number), np.uint64, len(self.number))
        token = np.concatenate(self.tokens)
        context = np.roll(token, 1)
        sizes = np.array([n for _, _, n in self.rows])
        context[np.cumsum(sizes) - sizes] = 1
        doc = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)

        # A frequent word becomes one word per bucket, told apart by the context.
        bucket = (hashes % np.uint64(self.buckets)).astype(np.int64)
        mine = [i for i, h in enumerate(hashes.tolist()) if h in self.frequent] if self.frequent else []
        word, place = hashes, bucket
        if mine:
            at = np.full(len(hashes), -1, np.int64)
            at[mine] = np.arange(len(mine))
            spread = np.flatnonzero(at[token] >= 0)
            sub = (hashes[context[spread]] >> np.uint64(20)) % np.uint64(self.buckets)
            alias = at[token[spread]] * self.buckets + sub.astype(np.int64)
            used, alias = np.unique(alias, return_inverse=True)
            token = token.astype(np.int64)
            token[spread] = len(hashes) + alias
            word = np.concatenate([hashes, hashes[np.array(mine)][used // self.buckets]])
            place = np.concatenate([bucket, used % self.buckets])
        order = np.lexsort((word, place))
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.arange(len(order), dtype=np.uint64)
        context_order = np.argsort(hashes)
        context_rank = np.empty(len(hashes), np.uint64)
        context_rank[context_order] = np.arange(len(hashes), dtype=np.uint64)
        bits = [int(len(order)).bit_length(), int(len(hashes)).bit_length(), int(len(sizes)).bit_length()]
        assert sum(bits) <= 64
        key = rank[token] << np.uint64(bits[1] + bits[2])
        key |= context_rank[context] << np.uint64(bits[2])
        key |= doc
        key, count = np.unique(key, return_counts=True)
        doc = key & np.uint64((1 << bits[2]) - 1)
        context = (key >> np.uint64(bits[2])) & np.uint64((1 << bits[1]) - 1)
        token = (key >> np.uint64(bits[1] + bits[2])).astype(np.int64)
        words, places, contexts = word[order], place[order], hashes[context_order]
        training = np.array([t for _, t, _ in self.rows], bool)

        edges = np.searchsorted(places[token], np.arange(self.buckets + 1))
        for b in np.flatnonzero(np.diff(edges)).tolist():
            part = slice(edges[b], edges[b + 1])
            own, n = np.unique(token[part], return_counts=True)
            near, which = np.unique(context[part], return_inverse=True)
            payload = packed(
                words[own], n.astype(np.uint64), contexts[near.astype(np.int64)], which.astype(np.uint64),
                doc[part] * np.uint64(2) + training[doc[part].astype(np.int64)], count[part].astype(np.uint64),
            )
            row = {"bucket": b, "payload": payload, "doc": self.base}
            yield pa.RecordBatch.from_pylist([row], schema=_GRAMS)
        rows = [
            {"bucket": self.home % self.buckets, "doc": self.base + i, "doc_id": d, "training": t, "n_tokens": n}
            for i, (d, t, n) in enumerate(self.rows)
        ]
        yield pa.RecordBatch.from_pylist(rows, schema=_GRAMS)


def grams(read: DataFrame, buckets: int, frequent: dict[int, int]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, number = TaskContext.get().partitionId(), 0

        def fresh() -> Chunk:
            return Chunk(((task << 12) + number) * DOCS_PER_CHUNK, task + number, buckets, frequent)

        chunk = fresh()
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(3))):
                chunk.add(*(x.as_py() for x in row))
                if chunk.full():
                    yield from chunk.grams()
                    number += 1
                    chunk = fresh()
                    give_back()
        yield from chunk.grams()
        del chunk
        give_back()

    return in_python(read, run, GRAMS)


# What a bucket leaves, by kind

SEEN = [f"n{r}" for r in range(1, LARGEST + 2)]
TABLES = (
    "kind string, key long, doc long, doc_id long, training boolean, n_tokens long, n_known long,"
    f" n_unseen long, {', '.join(f'{n} long' for n in SEEN)}, mass long, base double, score double,"
    " bucket int, place int, payload binary"
)
_TABLES = pa.schema(
    [("kind", pa.string()), ("key", pa.int64()), ("doc", pa.int64()), ("doc_id", pa.int64()), ("training", pa.bool_())]
    + [(n, pa.int64()) for n in ("n_tokens", "n_known", "n_unseen", *SEEN, "mass")]
    + [("base", pa.float64()), ("score", pa.float64())]
    + [("bucket", pa.int32()), ("place", pa.int32()), ("payload", pa.binary())]
)


def _rows(kind: str, n: int, **columns: np.ndarray) -> pa.RecordBatch:
    arrays = [
        pa.array([kind] * n) if f.name == "kind"
        else pa.array(columns[f.name].astype(f.type.to_pandas_dtype())) if f.name in columns
        else pa.nulls(n, f.type)
        for f in _TABLES
    ]
    return pa.RecordBatch.from_arrays(arrays, schema=_TABLES)


class Part:
    """One payload, its words in order of their hash."""

    def __init__(self, base: int, payload: bytes):
        words, self.n, contexts, self.which, self.docs, self.times = unpacked(payload)
        self.base, self.words = base, words.astype(np.uint64)
        self.contexts = contexts.astype(np.uint64)
        self.ends = np.cumsum(self.n.astype(np.int64))

    def of_words(self, low: int, high: int) -> tuple[slice, slice]:
        """The words with low <= hash <= high, and their grams."""
        a = int(np.searchsorted(self.words, np.uint64(low)))
        b = int(np.searchsorted(self.words, np.uint64(high), "right"))
        first = int(self.ends[a - 1]) if a else 0
        return slice(a, b), slice(first, int(self.ends[b - 1]) if b > a else first)


class Sums:
    """What a bucket adds up per document and per context, while its words pass by."""

    def __init__(self, parts: list[Part]):
        self.contexts = np.unique(np.concatenate([p.contexts for p in parts]))
        self.docs = np.unique(np.concatenate([p.base + np.unique(p.docs >> 1).astype(np.int64) for p in parts]))
        for part in parts:  # from now on contexts are places in the bucket's list
            part.contexts = np.searchsorted(self.contexts, part.contexts).astype(np.int32)
        self.seen = {name: np.zeros(len(self.contexts), np.int64) for name in (*SEEN, "mass")}
        self.doc = {name: np.zeros(len(self.docs)) for name in ("n_known", "n_unseen", *SEEN[:-1], "base", "score")}
        self.sizes, self.known = np.zeros(LARGEST + 3, np.int64), 0


def _counts_row(bucket: int, words: np.ndarray, word: np.ndarray, place: np.ndarray, r: np.ndarray) -> pa.RecordBatch:
    """Bigram counts as one stored row: words, bigrams of each, steps between the places of
    their contexts in the bucket's list, counts. The bigrams come by word and place."""
    own, n = np.unique(word, return_counts=True)
    step = np.diff(place, prepend=0)
    first = np.cumsum(n) - n
    step[first] = place[first]
    payload = packed(*(a.astype(np.uint64) for a in (words[own], n, step, r)))
    row = {"kind": "bigrams", "bucket": bucket, "payload": payload}
    return pa.RecordBatch.from_pylist([row], schema=_TABLES)


def evaluate(
    payloads: list[tuple[int, bytes]], frequent: dict[int, int], bucket: int = 0
) -> Iterator[pa.RecordBatch]:
    """All tables of one bucket, from its payloads of all chunks.

    The words pass by in ranges of their hash, so that only the compact payloads and the sums
    are held whole.
    """
    parts = []
    while payloads:
        parts.append(Part(*payloads.pop()))
    sums = Sums(parts)
    total = sum(len(p.docs) for p in parts)
    step = (1 << 64) // max(1, math.ceil(total / GRAMS_AT_ONCE)) + 1
    for low in range(0, 1 << 64, step):
        yield from _words_between(parts, sums, low, min(low + step, 1 << 64) - 1, frequent, bucket)

    yield _rows(
        "stats", 1, n_known=np.array([sums.known]),
        **{name: sums.sizes[r : r + 1] for r, name in enumerate(SEEN, 1)},
    )
    some = np.flatnonzero(sums.seen["mass"])
    for at in range(0, len(some), ROWS_AT_ONCE):
        own = some[at : at + ROWS_AT_ONCE]
        yield _rows(
            "contexts", len(own), key=sums.contexts[own].view(np.int64), place=own,
            bucket=np.full(len(own), bucket),
            **{name: values[own] for name, values in sums.seen.items()},
        )
    for at in range(0, len(sums.docs), ROWS_AT_ONCE):
        own = slice(at, at + ROWS_AT_ONCE)
        yield _rows(
            "sums", len(sums.docs[own]), doc=sums.docs[own],
            **{name: values[own] for name, values in sums.doc.items()},
        )


def _words_between(
    parts: list[Part], sums: Sums, low: int, high: int, frequent: dict[int, int], bucket: int
) -> Iterator[pa.RecordBatch]:
    cut = [(p, *p.of_words(low, high)) for p in parts]
    cut = [(p, words, grams) for p, words, grams in cut if grams.stop > grams.start]
    if not cut:
        return
    words = np.unique(np.concatenate([p.words[w] for p, w, _ in cut]))
    word = np.concatenate([np.repeat(np.searchsorted(words, p.words[w]), p.n[w]) for p, w, _ in cut])
    context = np.concatenate([p.contexts[p.which[g]] for p, _, g in cut]).astype(np.int64)
    to = np.concatenate([
        np.searchsorted(sums.docs, p.base + (p.docs[g] >> 1).astype(np.int64)) for p, _, g in cut
    ])
    count = np.concatenate([p.times[g].astype(np.int64) for p, _, g in cut])
    learnt = np.concatenate([np.where(p.docs[g] & 1, p.times[g], 0).astype(np.int64) for p, _, g in cut])
    order = np.argsort(word * len(sums.contexts) + context, kind="stable")
    word, context, to, count, learnt = (a[order] for a in (word, context, to, count, learnt))
    word_count = np.bincount(word, learnt, len(words)).astype(np.int64)
    is_frequent = np.array([w in frequent for w in words.tolist()], bool)
    for i in np.flatnonzero(is_frequent):
        word_count[i] = frequent[int(words[i])]
    starts = np.flatnonzero(np.append(True, (word[1:] != word[:-1]) | (context[1:] != context[:-1])))
    pair_count = np.add.reduceat(learnt, starts)
    pair_word, pair_context = word[starts], context[starts]

    # Counts of counts, and the words known (a frequent word is counted by the caller).
    sums.sizes += np.bincount(np.minimum(pair_count, LARGEST + 2), minlength=LARGEST + 3)
    sums.known += int(((word_count > 0) & ~is_frequent).sum())
    seen = pair_count > 0
    at, r = pair_context[seen], pair_count[seen]
    if len(at):
        yield _counts_row(bucket, words, pair_word[seen], at, r)
    for i, name in enumerate(SEEN, 1):
        np.add.at(sums.seen[name], at[r == i] if i <= LARGEST else at[r > LARGEST], 1)
    np.add.at(sums.seen["mass"], at, word_count[pair_word[seen]] + 1)

    r = np.repeat(pair_count, np.diff(np.append(starts, len(word))))
    times = word_count[word]
    missed = np.flatnonzero(r == 0)
    missed = missed[np.lexsort((to[missed], context[missed]))]
    if len(missed):
        key, of = context[missed], to[missed]
        first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (of[1:] != of[:-1])))
        yield _rows(
            "unseen", len(first), key=sums.contexts[key[first]].view(np.int64), doc=sums.docs[of[first]],
            n_unseen=np.add.reduceat(count[missed], first),
        )

    def add(name: str, values: np.ndarray) -> None:
        sums.doc[name] += np.bincount(to, values, len(sums.docs))

    log_pair = np.log10(np.where(r > LARGEST, r - LEAST_MASS, np.maximum(r, 1)))
    # As a context of the next token a known word divides by its count.
    divide = np.where((words == np.uint64(END))[word], 0.0, np.log10(np.maximum(times, 1)))
    log_word = np.log10(times + 1)
    add("n_known", count * (times > 0))
    add("n_unseen", count * (r == 0))
    add("base", count * log_word)
    add("score", count * (log_pair - divide + np.where(r == 0, log_word, 0.0)))
    for i, name in enumerate(SEEN[:-1], 1):
        add(name, count * (r == i))


def bucket_tables(shuffled: DataFrame, frequent: dict[int, int]) -> DataFrame:
    """The tables of every bucket; a partition of ``shuffled`` is one bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[int, bytes]] = []
        for batch in batches:
            is_doc = np.array(batch.column("payload").is_null())
            docs = batch.filter(pa.array(is_doc))
            if len(docs):
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(["docs"] * len(docs)) if f.name == "kind"
                        else docs.column(f.name) if f.name in ("doc", "doc_id", "training", "n_tokens")
                        else pa.nulls(len(docs), f.type)
                        for f in _TABLES
                    ],
                    schema=_TABLES,
                )
            for i in np.flatnonzero(~is_doc).tolist():
                parts.append((batch.column("doc")[i].as_py(), batch.column("payload")[i].as_py()))
        if parts:
            yield from evaluate(parts, frequent, TaskContext.get().partitionId())
        give_back()

    return in_python(shuffled, run, TABLES)


def discounts(sizes: list[int]) -> list[float]:
    """Good-Turing discounts of r = 1..LARGEST from the numbers of bigrams seen r times
    (r = 1..LARGEST + 1). Where the estimate is not between 0 and 1, half a count goes."""
    n = dict(enumerate(sizes, 1))
    found = []
    for r in range(1, LARGEST + 1):
        d = None
        if n[1] and n[r]:
            common = (LARGEST + 1) * n[LARGEST + 1] / n[1]
            if common < 1:
                d = ((r + 1) * n[r + 1] / (r * n[r]) - common) / (1 - common)
        found.append(d if d is not None and 0 < d < 1 else (r - 0.5) / r)
    return found


class Model(NamedTuple):
    """Stored tables by kind, training tokens and words, training texts, discounts."""

    tables: DataFrame
    n: int
    v: int
    texts: int
    d: list[float]

    def kind(self, name: str) -> DataFrame:
        return self.tables.filter(F.col("kind") == name).drop("kind")


def score(docs: DataFrame, training: Column) -> DataFrame:
    """Learn from the rows that ``training`` marks and score all rows.

    Columns: doc_id, training, n_tokens (words and the end), n_known (tokens met in training),
    train_tokens, base_score (add-one unigram) and score (Katz), log10 probabilities of the
    whole text. Null and empty texts are one end token. Null and repeated doc_ids are texts of
    their own; a null training mark is false. Without training rows every probability is one
    (a single unknown word). An empty table gives no rows; other columns are ignored.
    """
    return _scored(fit(docs, training))


def fit(docs: DataFrame, training: Column) -> Model:
    """The model of the rows that ``training`` marks, and the sums of all rows under it."""
    spark = docs.sparkSession
    read = _read(docs, training)
    total = token_total(read)
    buckets = max(4, math.ceil(total / TOKENS_PER_BUCKET))
    frequent = frequent_words(read, buckets, total)
    # One bucket a task, by its number: no two meet by the chance of a hash.
    shuffled = grams(read, buckets, frequent).repartitionById(buckets, "bucket")
    path = scratch_dir(spark, "katz")
    bucket_tables(shuffled, frequent).write.partitionBy("kind").parquet(path)
    model = Model(spark.read.schema(TABLES).parquet(path), 0, 0, 0, [])
    kind = model.kind
    seen = kind("stats").agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in ("n_known", *SEEN)]).first()
    trained = kind("docs").filter("training").agg(
        F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens"), F.count("*").alias("texts")
    ).first()
    n, v = trained["tokens"], seen["n_known"] + sum(c > 0 for c in frequent.values())
    d = discounts([seen[name] for name in SEEN])
    return model._replace(n=n, v=v, texts=trained["texts"], d=d)


def backoff_weights(contexts: DataFrame, n: int, v: int, d: list[float]) -> DataFrame:
    """Of every context its count times alpha: the mass left over the unseen words' share."""
    left = sum(
        (F.col(name) * float((1 - d[r - 1]) * r) for r, name in enumerate(SEEN[:-1], 1)),
        F.col(SEEN[-1]) * LEAST_MASS,
    )
    sums = contexts.groupBy("key").agg(*[F.sum(c).alias(c) for c in (*SEEN, "mass")])
    return sums.select("key", (left / (1 - F.col("mass") / float(n + v + 1))).alias("weight"))


def bigrams(model: Model) -> DataFrame:
    """The stored counts: context, word (hashes) and r, the times seen in training."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, payload in zip(batch.column(0).to_pylist(), batch.column(1)):
                words, n, step, r = unpacked(payload.as_py())
                n = n.astype(np.int64)
                place = np.cumsum(step.astype(np.int64))
                first = np.cumsum(n) - n
                place -= np.repeat(place[first] - step[first].astype(np.int64), n)
                word = np.repeat(words.astype(np.uint64).view(np.int64), n)
                for at in range(0, len(r), ROWS_AT_ONCE):
                    own = slice(at, at + ROWS_AT_ONCE)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(r[own]), bucket), pa.int32()), pa.array(place[own].astype(np.int32)),
                         pa.array(word[own]), pa.array(r[own].astype(np.int64))],
                        names=["bucket", "place", "word", "r"],
                    )

    read = model.kind("bigrams").select("bucket", "payload")
    counts = in_python(read, run, "bucket int, place int, word long, r long")
    places = model.kind("contexts").select("bucket", "place", F.col("key").alias("context"))
    return counts.join(places, ["bucket", "place"]).select("context", "word", "r")


def _tokens(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` its doc_id and size, and per (context, word) of it a row; written."""
    kind = "kind string, doc long, doc_id long, context long, word long, n long"
    schema = pa.schema([("kind", pa.string()), *[(n, pa.int64()) for n in ("doc", "doc_id", "context", "word", "n")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc = TaskContext.get().partitionId() << 40
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                hashes = [START, *map(xxhash.xxh64_intdigest, words_of(text.as_py())), END]
                signed = np.array(hashes, np.uint64).view(np.int64).tolist()
                found = Counter(zip(signed, signed[1:]))
                rows = [("doc", doc, doc_id, None, None, len(signed) - 1)]
                rows += [("gram", doc, None, c, w, n) for (c, w), n in found.items()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema
                )
                doc += 1

    path = scratch_dir(docs.sparkSession, "katz-texts")
    read = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary"))
    in_python(read, run, kind).write.partitionBy("kind").parquet(path)
    return docs.sparkSession.read.schema(kind).parquet(path)


def score_texts(model: Model, docs: DataFrame) -> DataFrame:
    """Score texts the model need not have seen, from its stored tables: doc_id, n_tokens, score.

    Each token takes its bigram's discounted count over the context's count, where that was
    seen; else the context's back-off weight times the word's probability; in a context never
    seen the word's probability alone. Rows are handled as in ``score``.
    """
    tokens = _tokens(docs)
    grams = tokens.filter("kind = 'gram'").select("doc", "context", "word", "n")
    counts = bigrams(model)
    words = counts.groupBy("word").agg(F.sum("r").alias("times"))
    followed = counts.groupBy("context").agg(F.sum("r").alias("after"))
    weights = backoff_weights(model.kind("contexts"), model.n, model.v, model.d)
    contexts = followed.join(weights, F.col("context") == F.col("key")).drop("key")
    met = grams.join(counts, ["context", "word"], "left").join(words, "word", "left").join(contexts, "context", "left")
    r, after = F.col("r"), F.col("after")
    kept = F.when(r > LARGEST, r - LEAST_MASS)
    for i, d in enumerate(model.d, 1):
        kept = kept.when(r == i, F.lit(i * d))
    own = (F.coalesce("times", F.lit(0)) + 1) / F.lit(float(model.n + model.v + 1))
    p = F.when(r.isNotNull(), kept / after).when(after.isNotNull(), F.col("weight") / after * own).otherwise(own)
    sums = met.groupBy("doc").agg(F.sum(F.col("n") * F.log10(p)).alias("score"))
    every = tokens.filter("kind = 'doc'").select("doc", "doc_id", F.col("n").alias("n_tokens"))
    return every.join(sums, "doc").select("doc_id", "n_tokens", "score")


def _scored(model: Model) -> DataFrame:
    kind, n, v, texts, d = model.kind, model.n, model.v, model.texts, model.d
    weights = backoff_weights(kind("contexts"), n, v, d)
    backed = kind("unseen").select("key", "doc", "n_unseen").join(weights, "key").select(
        "doc", (F.col("n_unseen") * F.log10("weight")).alias("score")
    )
    by_r = sum(F.col(name) * math.log10(d[r]) for r, name in enumerate(SEEN[:-1]))
    log_all = math.log10(n + v + 1)
    sums = kind("sums").select(
        "doc", "n_known", "base", (F.col("score") + by_r - F.col("n_unseen") * log_all).alias("score")
    )
    every = kind("docs").select("doc", "doc_id", "training", "n_tokens")
    parts = every.unionByName(sums, allowMissingColumns=True).unionByName(backed, allowMissingColumns=True)
    met = parts.groupBy("doc").agg(
        F.max("doc_id").alias("doc_id"), F.max("training").alias("training"),
        F.sum("n_tokens").alias("n_tokens"), F.coalesce(F.sum("n_known"), F.lit(0)).alias("n_known"),
        F.sum("base").alias("base"), F.sum("score").alias("score"),
    )
    start = math.log10(texts) if texts else 0.0
    return met.select(
        "doc_id", "training", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * log_all).alias("base_score"),
        (F.col("score") - start).alias("score"),
    )
