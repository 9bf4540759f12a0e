"""Fingerprint sketches against plain sets of paragraphs and a plain walk over the documents."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from citeloom.llm import bloom_diff as B


def prose(rng, n):
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 7)))
    return " ".join(word() + rng.choice(["", "", "", ".", "!\n"]) for _ in range(n))


@given(st.text(alphabet="ab. !?\n\réß中", max_size=400))
def test_paragraphs_are_the_whole_text(text):
    pieces = B.paragraphs(text.encode())
    assert b"".join(pieces) == text.encode() and all(pieces)


def test_long_runs_are_cut_by_content():
    words = [f"w{i}" for i in range(3000)]
    a = B.paragraphs(" ".join(words).encode())
    b = B.paragraphs(" ".join(["new", *words]).encode())
    assert len(a) > 100 and max(map(len, a)) < 1000
    assert len(set(a) ^ set(b)) < 6


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6))
def test_difference_recovers_the_digests(seed):
    rng = random.Random(seed)
    a = prose(rng, rng.choice([0, 1, 30, 400, 3000]))
    b = rng.choice([a, a + " more. And more.", prose(rng, 200), a[: len(a) // 2] + prose(rng, 20), ""])
    one, two = B.Version(a), B.Version(b)
    gone, come, width = B.difference(one, two)
    assert set(gone.tolist()) == set(one.keys.tolist()) - set(two.keys.tolist())
    assert set(come.tolist()) == set(two.keys.tolist()) - set(one.keys.tolist())
    assert width >= B.WIDTH
    both = set(one.keys.tolist()) | set(two.keys.tolist())
    share = len(set(one.keys.tolist()) & set(two.keys.tolist())) / len(both) if both else 1.0
    assert B.likeness(one, two)[0] == pytest.approx(share)


def test_stuck_sketches_are_retried_larger():
    rng = random.Random(1)
    one, two = B.Version(prose(rng, 2000)), B.Version(prose(rng, 2000))
    assert one.sketch(B.WIDTH).minus(two.sketch(B.WIDTH)).peel() is None
    assert B.difference(one, two)[2] > B.WIDTH


def test_repeated_paragraphs_count():
    one, two = B.Version("Same.\n" * 1000), B.Version("Same.\n" * 998)
    assert len(one.keys) == 1000
    assert [len(x) for x in B.difference(one, two)[:2]] == [2, 0]


def expected(rows):
    """doc_id, text to (n_chars, edited) by a plain reading of the rule."""
    texts = [(i, t or "") for i, t in rows]
    lowest = {}
    for i, t in texts:
        if i is not None:
            lowest[i] = min(t, lowest.get(i, t))
    order = sorted(lowest)
    found = []
    for i, t in texts:
        later = order if i is None else [j for j in order if j > i] or order
        after = lowest[later[0]] if later else ""
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        found.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t, edited, after))
    return found


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x", "y") for r in rows], "doc_id long, text string, ahead string, slot string"
    )


CASES = {
    "plain": [(i, prose(random.Random(i), 5 + i)) for i in range(60)],
    "one": [(7, "Alone. In here.")],
    "no ids": [(None, "Some text here.")] * 3 + [(None, "")],
    "a third without id": [(i, f"Text {i}. " * 5) for i in range(40)] + [(None, f"Lost {i}. " * 4) for i in range(20)],
    "one hot id": [(5, f"Hot {i % 9}. " * 6) for i in range(50)] + [(i, f"Row {i}. " * 6) for i in range(0, 60, 3)],
    "hot last id": [(90, f"Hot {i}. " * 6) for i in range(50)] + [(i, f"Row {i}. " * 6) for i in range(30)],
    "nulls and empty": [(1, None), (2, ""), (3, "abc é 中文字"), (4, None), (4, "z" * 9), (2, ""), (-5, "x")],
    "long": [(1, prose(random.Random(3), 30000)), (2, "a" * 200_000), (3, "b")],
    "extreme ids": [(2**63 - 1, "Last one. Of all."), (-(2**63), "First one. Of all."), (0, "Zero, zero, zero")],
}


@pytest.mark.parametrize("slots", ["1", "4", "13"])
@pytest.mark.parametrize("case", CASES)
def test_compare_with_next(spark, case, slots):
    rows = CASES[case]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", slots)
    try:
        got = B.compare_with_next(frame(spark, rows)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    want = []
    for i, n, digest, text, edited, after in expected(rows):
        versions = [B.Version(x) for x in (text, edited, after)]
        want.append((
            i, n, digest, versions[0].fingerprint(), versions[1].fingerprint(),
            B.likeness(versions[0], versions[1])[0], B.likeness(versions[0], versions[2])[0],
        ))
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, want))


def test_no_rows(spark):
    assert B.compare_with_next(frame(spark, [])).count() == 0
    assert B.fingerprints(frame(spark, [])).count() == 0


def test_fingerprints_and_compare(spark):
    rows = [(1, "One. Two. Three."), (2, "One. Two. Three."), (3, "One. Three. Two."), (None, None)]
    got = {r["doc_id"]: r for r in B.fingerprints(frame(spark, rows)).collect()}
    assert got[1]["fingerprint"] == got[2]["fingerprint"] != got[3]["fingerprint"]
    assert got[None]["n_paragraphs"] == 0
    pairs = spark.createDataFrame(
        [(1, "A. B. C.", "A. B. D."), (2, None, ""), (2, None, "E.")], "likeness int, old string, removed string"
    )
    found = {(r["pair"]["likeness"], r["pair"]["removed"]): r for r in B.compare(pairs, "old", "removed").collect()}
    one = found[1, "A. B. D."]
    assert one["likeness"] == 0.5 and len(one["removed"]) == len(one["added"]) == 1
    assert np.uint64(np.int64(one["removed"][0])) in B.digests(b"A. B. C.")
    assert found[2, ""]["likeness"] == 1.0 and found[2, "E."]["likeness"] == 0.0
