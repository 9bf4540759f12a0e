"""Pack documents into sequences of at most 2048 tokens, as few as possible.

Lengths are small integers, so the packing problem is a histogram of at most ``capacity``
numbers whatever the size of the corpus. Its configuration linear program (how often to use
which multiset of lengths that fits a sequence, so that every length is covered) is solved on
the driver by multiplicative weights: prices fall for the lengths covered so far, and a
knapsack by dynamic programming finds the best-paid configurations at these prices. The
fractions are rounded down, the rest is solved again while that takes much of it, and what is
left at last goes best-fit into open sequences. Placing the pieces is Spark work: each gets its number among those of its
length and looks up its slot in the plan.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import in_python, stored

CAPACITY = 2048
ROUNDS = 200
COLUMNS_PER_ROUND = 64
#: Shares of the fractional solution that are tried for rounding down.
SHARES = (1.0, 0.9, 0.65, 0.5, 0.3)

Config = tuple[tuple[int, int], ...]  # (length, how many), by falling length

# Below this code point both libraries cut and merge alike (tested over the whole range).
_BEYOND = re.compile("[　-\U0010ffff]")


@lru_cache(maxsize=4)
def encoder(vocabulary: str, ranks: str | None) -> Callable[[str], np.ndarray]:
    """Text to ids of the vocabulary file, special strings being their tokens.

    ``ranks`` names the same vocabulary in the form of a faster library, used for texts below
    U+3000; others, and texts it refuses, go through the vocabulary file itself.
    """
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)

    def slow(text: str) -> np.ndarray:
        return np.array(whole.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks is None:
        return slow
    import public_tokenizers
    import tiktoken

    with open(ranks, "rb") as lines:
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    specials = {t.content: i for i, t in whole.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding(
        "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens=specials
    )

    def encode(text: str) -> np.ndarray:
        if _BEYOND.search(text):
            return slow(text)
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except BaseException as refused:  # the library panics on some very long runs
            if isinstance(refused, (KeyboardInterrupt, SystemExit)):
                raise
            return slow(text)

    return encode


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of ``n`` ids: all full but the first."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


PIECES = (
    "doc_id long, piece int, start long, length long, ids_crc32 long, part int, local long"
)


def pieces(
    docs: DataFrame,
    vocabulary: str,
    ranks: str | None = None,
    capacity: int = CAPACITY,
    end_id: int = 0,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of every document: its ids and ``end_id``, cut where longer than ``capacity``.

    ``part`` and ``local`` number the pieces of one length within a task; the table must be
    stored before it is used. ``with_ids`` adds the ids themselves. Null text: empty, one
    piece of the end id alone. Null and repeated doc_ids are documents of their own. An empty
    table has no pieces; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        part, met = TaskContext.get().partitionId(), {}
        for batch in batches:
            rows: list[tuple] = []
            held: list[np.ndarray] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                for n, (at, length) in enumerate(cuts(len(ids), capacity)):
                    own = ids[at : at + length]
                    local = met[length] = met.get(length, -1) + 1
                    rows.append((doc_id, n, at, length, zlib.crc32(own.tobytes()), part, local))
                    if with_ids:
                        held.append(own)
            kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 3, pa.int32(), pa.int64()]
            columns = zip(*rows) if rows else [[]] * 7
            arrays = [pa.array(c, t) for c, t in zip(columns, kinds)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "local"]
            if with_ids:
                arrays.append(pa.array([x.tolist() for x in held], pa.list_(pa.int32())))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)

    read = docs.select(F.col("doc_id").cast("long"), "text")
    return in_python(read, run, PIECES + (", ids array<int>" if with_ids else ""))


# The plan: a linear program over the histogram


def knapsack(prices: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best total price for each used length 0..C, and a last item of it (0: none).

    ``prices[l]`` is the price of length l, zero where the length is not asked for.
    """
    capacity = len(prices) - 1
    best, last = np.zeros(capacity + 1), np.zeros(capacity + 1, np.int64)
    for room in range(1, capacity + 1):
        worth = best[room - 1 :: -1] + prices[1 : room + 1]
        item = int(worth.argmax())
        if worth[item] > best[room - 1]:
            best[room], last[room] = worth[item], item + 1
        else:
            best[room] = best[room - 1]
    return best, last


def filled(last: np.ndarray, room: int) -> dict[int, int]:
    config: dict[int, int] = {}
    while room > 0:
        item = int(last[room])
        if item == 0:
            room -= 1
            continue
        config[item] = config.get(item, 0) + 1
        room -= item
    return config


def fractions(counts: dict[int, int], capacity: int, rounds: int, eta: float = 4.0) -> dict[Config, float]:
    """A cover of the histogram by configurations, from multiplicative weights.

    Every length is a covering constraint. Its weight falls exponentially with the covered
    share; the prices are weights times length, so that at first every exact fill is optimal.
    In each round the lengths least covered get the best-paid configuration that holds them.
    The result covers every length.
    """
    lengths = np.array(sorted(counts))
    wanted = np.array([counts[n] for n in lengths], float)
    at = {int(n): i for i, n in enumerate(lengths)}
    covered, used = np.zeros(len(lengths)), {}
    for _ in range(rounds):
        share = covered / wanted
        weight = np.exp(-eta * (share - share.min()))
        prices = np.zeros(capacity + 1)
        prices[lengths] = lengths * weight
        _, last = knapsack(prices)
        needy = np.lexsort((-lengths, share))[:COLUMNS_PER_ROUND]
        for i in needy:
            length = int(lengths[i])
            config = filled(last, capacity - length)
            config[length] = config.get(length, 0) + 1
            config = {n: min(k, counts[n]) for n, k in config.items()}
            times = min(wanted[at[n]] / k for n, k in config.items()) / 4
            key = tuple(sorted(config.items(), reverse=True))
            used[key] = used.get(key, 0.0) + times
            for n, k in config.items():
                covered[at[n]] += times * k
    scale = float((wanted / covered).max())
    return {config: x * scale for config, x in used.items()}


def scaled_to_tokens(solved: dict[Config, float], counts: dict[int, int], capacity: int) -> dict[Config, float]:
    """The cover shrunk to as many sequences as the tokens need at least."""
    least = sum(n * k for n, k in counts.items()) / capacity
    scale = least / sum(solved.values())
    return {config: x * scale for config, x in solved.items()}


def take(counts: dict[int, int], config: Config, times: int) -> int:
    """Use a configuration up to ``times`` times, as far as its lengths last."""
    times = min([times, *(counts.get(n, 0) // k for n, k in config)])
    for n, k in config if times else ():
        counts[n] -= times * k
        if not counts[n]:
            del counts[n]
    return times


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Config, int]]:
    """Best fit by falling length, whole groups of alike sequences at a time."""
    groups: dict[int, list[tuple[Config, int]]] = {}
    rooms: list[int] = []

    def put(config: Config, times: int) -> None:
        room = capacity - sum(n * k for n, k in config)
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((config, times))

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                config, there = groups[room].pop()
                if not groups[room]:
                    del groups[room], rooms[i]
            else:
                room, config, there = capacity, (), left
            each = room // length
            whole = min(there, left // each)
            rest = left - whole * each if whole < there else 0
            if whole:
                put((*config, (length, each)), whole)
            if rest and rest < each:
                put((*config, (length, rest)), 1)
            open_left = there - whole - (1 if rest and rest < each else 0)
            if config and open_left > 0:
                put(config, open_left)
            left -= whole * each + (rest if rest < each else 0)
    return [x for found in groups.values() for x in found]


def rounded(
    solved: dict[Config, float], counts: dict[int, int], capacity: int, share: float
) -> list[tuple[Config, int]]:
    """The full configurations of a fractional cover, ``share`` of it rounded down, and the
    lengths left over by best fit."""
    counts, made = dict(counts), []
    for config, x in sorted(solved.items(), key=lambda c: -c[1]):
        if sum(n * k for n, k in config) == capacity:
            times = take(counts, config, math.floor(x * share))
            made += [(config, times)] * (times > 0)
    return made + best_fit(counts, capacity)


def solved_again(
    solved: dict[Config, float], counts: dict[int, int], capacity: int, rounds: int
) -> list[tuple[Config, int]]:
    """All configurations of a cover rounded down and the rest solved again, as long as a
    rounding takes a tenth of what is left; then best fit."""
    counts, made = dict(counts), []
    while counts:
        tokens, taken = sum(n * k for n, k in counts.items()), 0
        # Rounding in doubles must not lose a whole sequence.
        for config, x in sorted(solved.items(), key=lambda c: -c[1]):
            times = take(counts, config, math.floor(x + 1e-6))
            made += [(config, times)] * (times > 0)
            taken += times * sum(n * k for n, k in config)
        if taken * 10 < tokens or not counts:
            break
        solved = fractions(counts, capacity, rounds)
    return made + best_fit(counts, capacity)


def plan(histogram: dict[int, int], capacity: int = CAPACITY, rounds: int = ROUNDS) -> list[tuple[Config, int]]:
    """Configurations and how many sequences use each; together they hold the histogram.

    What a rounding leaves over packs better the more evenly its lengths are mixed, so
    several shares of the solution are rounded, besides solving the rest again, and the plan
    of fewest sequences stays.
    """
    counts = {n: c for n, c in histogram.items() if c and n < capacity}
    made: dict[Config, int] = {}
    if histogram.get(capacity):
        made[((capacity, 1),)] = histogram[capacity]
    if not counts:
        return list(made.items())
    cover = fractions(counts, capacity, rounds)
    least = scaled_to_tokens(cover, counts, capacity)
    tried = [rounded(least, counts, capacity, share) for share in SHARES]
    tried.append(solved_again(cover, counts, capacity, rounds))
    for config, times in min(tried, key=lambda t: sum(n for _, n in t)):
        made[config] = made.get(config, 0) + times
    return list(made.items())


def slots(planned: list[tuple[Config, int]]) -> dict[str, np.ndarray]:
    """The plan by length: ranges of piece numbers and the sequences they go to."""
    rows, met, first = [], {}, 0
    for config, times in planned:
        offset = 0
        for length, each in config:
            base = met.get(length, 0)
            rows.append((length, base, each, first, offset))
            met[length] = base + each * times
            offset += length * each
        first += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "base", "each", "first", "offset"), columns))


def pack(made: DataFrame, capacity: int = CAPACITY, rounds: int = ROUNDS) -> DataFrame:
    """Place stored pieces: all their columns but part and local, sequence_id and offset.

    ``made`` is a stored table as ``pieces`` gives it. What reaches the driver is one count
    per length. No pieces: no rows.
    """
    counts = stored(made.groupBy("part", "length").agg(F.count("*").alias("n")), "counts")
    # One window row per task and length.
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select(
        "part", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base")
    )
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    found = slots(plan(histogram, capacity, rounds))
    # One row per task and length would grow past any broadcast; the pieces are narrow rows.
    numbered = made.join(base.hint("merge"), ["part", "length"]).withColumn("number", F.col("base") + F.col("local"))
    kept = [c for c in made.columns if c not in ("part", "local")]
    out = numbered.select(*kept, "number")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by length, then number: one search finds a piece's range.
        starts = np.searchsorted(found["length"], np.arange(capacity + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            number = batch.column("number").to_numpy()
            row = np.zeros(len(length), np.int64)
            for n in np.unique(length):
                mine = np.flatnonzero(length == n)
                bases = found["base"][starts[n] : starts[n + 1]]
                row[mine] = starts[n] + np.searchsorted(bases, number[mine], "right") - 1
            within = number - found["base"][row]
            sequence = found["first"][row] + within // found["each"][row]
            offset = found["offset"][row] + within % found["each"][row] * length
            arrays = [batch.column(c) for c in kept] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(arrays, [*kept, "sequence_id", "offset"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in out.dtypes if c != "number")
    return in_python(out, place, kinds + ", sequence_id long, offset long")


def pack_documents(
    docs: DataFrame, vocabulary: str, ranks: str | None = None, capacity: int = CAPACITY,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces of all documents with their places; see ``pieces`` and ``pack``."""
    made = stored(pieces(docs, vocabulary, ranks, capacity, with_ids=with_ids), "pieces")
    return pack(made, capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences, from pieces with ids: sequence_id, ids."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(
        F.flatten(F.transform(ordered, lambda p: p["ids"])).alias("ids")
    )
