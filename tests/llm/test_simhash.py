"""Fingerprints and groups against a direct reading, all pairs compared."""

import random

import numpy as np
import pytest
import xxhash

from citeloom.llm import simhash


def plain_fingerprint(text, n=3):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        words = words.replace(blank, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    shingles = [words] if len(words) < n else [words[i : i + n] for i in range(len(words) - n + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(s).encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius):
    root = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize("text", ["", " \n", "One", "a b", "a b c", "A\x1cB x y z É é", "x " * 70000])
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


def near_prints(radius, seed):
    rng = random.Random(seed)
    prints = [0, 2**64 - 1]
    for _ in range(40):
        at = rng.getrandbits(64)
        prints.append(at)
        for _ in range(rng.randrange(8)):
            for _ in range(rng.randrange(radius + 3)):
                at ^= 1 << rng.randrange(64)
            prints.append(at)
    return sorted(set(prints))


@pytest.mark.parametrize("radius", [0, 1, 2, 3, 4])
def test_links_have_the_closure_of_all_pairs(spark, radius):
    prints = near_prints(radius, radius)
    rows = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    df = spark.createDataFrame(rows, "fingerprint long")
    edges = simhash.links(df, radius, len(prints)).collect()
    number = {int(np.uint64(p).view(np.int64)): i for i, p in enumerate(prints)}
    root = list(range(len(prints)))
    for a, b in edges:
        x, y = root[number[a]], root[number[b]]
        root = [min(x, y) if r in (x, y) else r for r in root]
    assert root == plain_groups(prints, radius)


def test_expansion_in_parts_is_the_same(monkeypatch):
    values = np.array(near_prints(3, 9), np.uint64)
    prefix = int(values[5] >> np.uint64(56))
    near = values[np.bitwise_count((values >> np.uint64(56)) ^ np.uint64(prefix)) <= simhash.reach(values, 3)]
    whole = simhash.links_of_prefix(near, prefix, 8, 3)
    monkeypatch.setattr(simhash, "VARIANTS_AT_ONCE", 500)
    assert (simhash.links_of_prefix(near, prefix, 8, 3) == whole).all()


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)]
    got = simhash.components(spark.createDataFrame(edges, "a long, b long"))
    expected = {i: 0 for i in range(61)} | {100: 100, 101: 100}
    assert {r["vertex"]: r["root"] for r in got.collect()} == expected


ROWS = [
    (1, "Alpha beta gamma delta", "x"), (2, "alpha beta\ngamma delta", "x"), (3, None, "y"), (4, "", "y"),
    (5, "two words", None), (5, "two words", None), (None, "two words", "z"), (None, "quite other things here", "z"),
    (None, "quite other things here", "z"), (9, "long " * 30000, "z"), (9, "another text of the same id", "z"),
]


def test_groups_and_one_of_each(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string, component_id string")
    rows = simhash.near_duplicates(docs).collect()
    prints = [plain_fingerprint(t) for _, t, _ in ROWS]
    roots = plain_groups(prints, 3)
    least = {}
    for (i, _, _), r in zip(ROWS, roots):
        least[r] = min([x for x in (least.get(r), i) if x is not None], default=None)
    expected = [(i, f"{p:016x}", least[r]) for (i, _, _), p, r in zip(ROWS, prints, roots)]
    got = [(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows]
    assert sorted(got, key=str) == sorted(expected, key=str)

    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    texts = sorted((r["doc_id"], r["text"][:9] if r["text"] else r["text"]) for r in kept.collect() if r["doc_id"])
    assert texts == [(1, "Alpha bet"), (3, None), (5, "two words"), (9, "another t"), (9, "long long")]
    assert [r["text"] for r in kept.collect() if r["doc_id"] is None] == ["quite other things here"]


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.one_of_each(docs).count() == 0
