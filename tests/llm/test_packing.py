"""Ids against the tokenizer library, plans and placed pieces against what they must hold."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from citeloom.llm import packing

JSON, RANKS = (public_tokenizers.path(f"byte_bpe_50k.{kind}") for kind in ("json", "tiktoken"))
WHOLE = Tokenizer.from_file(JSON)


def ids(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


def test_all_code_points_of_the_fast_way():
    encode = packing.encoder(JSON, RANKS)
    for c in map(chr, range(0x3000)):
        text = f"a{c}b {c}c  {c}1{c}\n{c} {c}{c} 's{c}'ll {c}  {c}"
        assert encode(text).tolist() == ids(text), hex(ord(c))


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"])))
def test_any_text(text):
    assert packing.encoder(JSON, RANKS)(text).tolist() == ids(text)


@pytest.mark.parametrize("text", ["", "x <|endoftext|>y", " " * 300000, "a" * 100000, "\n \t" * 50000, "漢字 <|endoftext|>"])
def test_odd_texts(text):
    assert packing.encoder(JSON, RANKS)(text).tolist() == ids(text)


def test_cuts():
    assert packing.cuts(1, 4) == [(0, 1)] and packing.cuts(4, 4) == [(0, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


@pytest.mark.parametrize("seed", range(6))
def test_plan_holds_the_histogram(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 10, 64])
    histogram = {n: rng.randrange(0, 40) for n in range(1, capacity + 1) if rng.random() < 0.6}
    planned = packing.plan(histogram, capacity, rounds=20)
    held = Counter()
    for config, times in planned:
        assert times > 0 and sum(n * k for n, k in config) <= capacity
        for n, k in config:
            held[n] += k * times
    assert held == +Counter(histogram)
    tokens = sum(n * k for n, k in histogram.items())
    assert sum(t for _, t in planned) <= 11 / 9 * -(-tokens // capacity) + 2


def test_plan_is_near_the_bound():
    rng = random.Random(3)
    histogram = Counter(min(256, int(rng.lognormvariate(3.5, 1.2)) + 1) for _ in range(20000))
    n = sum(t for _, t in packing.plan(dict(histogram), 256))
    least = -(-sum(k * v for k, v in histogram.items()) // 256)
    assert n <= least * 1.002 + 1
    # Pairs that only fit together exactly.
    assert sum(t for _, t in packing.plan({100: 500, 156: 500, 64: 400, 192: 400}, 256)) == 900


@pytest.mark.parametrize("n", [1, 7, 1000])
def test_lengths_that_never_fill_a_sequence(n):
    # 1027 + 516 + 501 and 2 * 521 + 2 * 501 are 2044; best fit needs 11 n.
    histogram = {1027: 6 * n, 521: 6 * n, 516: 6 * n, 501: 12 * n}
    assert sum(t for _, t in packing.best_fit(dict(histogram), 2048)) == 11 * n
    planned = packing.plan(histogram)
    held = Counter()
    for config, times in planned:
        assert sum(length * k for length, k in config) <= 2048
        for length, k in config:
            held[length] += k * times
    assert held == Counter(histogram) and sum(t for _, t in planned) <= 9 * n + 1


def test_groups_of_alike_sequences_are_best_fit():
    def one_by_one(counts, capacity):
        rooms = []
        for n in sorted(Counter(counts).elements(), reverse=True):
            fits = [r for r in rooms if r >= n]
            if fits:
                rooms.remove(min(fits))
            rooms.append(min(fits, default=capacity) - n)
        return len(rooms)

    for seed in range(30):
        rng = random.Random(seed)
        counts = {n: rng.randrange(1, 9) for n in rng.sample(range(1, 50), 12)}
        assert sum(t for _, t in packing.best_fit(dict(counts), 50)) == one_by_one(counts, 50)


ROWS = [
    (1, "short text"), (2, None), (3, ""), (None, "no id"), (1, "short text"), (5, "word " * 5000),
    (6, "漢字 and <|endoftext|>"), (7, "x" * 40000), *[(100 + i, "the cat " * (i * 13 % 700)) for i in range(150)],
]


def test_pieces_and_places(spark):
    docs = spark.createDataFrame(
        [(*r, "a", "b") for r in ROWS], "doc_id long, text string, length string, part string"
    ).repartition(4)
    packed = packing.pack_documents(docs, JSON, RANKS, with_ids=True)
    rows = packed.collect()
    want = Counter()
    for doc_id, text in ROWS:
        own = [*ids(text or ""), 0]
        for n, (at, length) in enumerate(packing.cuts(len(own))):
            crc = zlib.crc32(np.array(own[at : at + length], "<u4").tobytes())
            want[doc_id, n, at, length, crc] += 1
    assert want == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows)
    held = defaultdict(list)
    for r in rows:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        held[r["sequence_id"]].append((r["offset"], r["length"], r["ids"]))
    whole = {r["sequence_id"]: r["ids"] for r in packing.sequences(packed).collect()}
    for number, parts in held.items():
        at, joined = 0, []
        for offset, length, own in sorted(parts):
            assert offset == at
            at, joined = at + length, joined + own
        assert at <= 2048 and whole[number] == joined
    assert len(held) <= -(-sum(r["length"] for r in rows) // 2048) + 1


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.pack_documents(docs, JSON, RANKS).count() == 0
