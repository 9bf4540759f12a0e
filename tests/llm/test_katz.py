"""The model against a direct reading: same scores, and probabilities that sum to one."""

import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from citeloom.llm import katz


def tokens(text):
    folded = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        folded = folded.replace(blank, " ")
    return [w for w in folded.split(" ") if w] + [None]


class Plain:
    def __init__(self, texts):
        self.uni, self.bi, self.ctx = Counter(), Counter(), Counter()
        for text in texts:
            before = "START "
            for t in tokens(text):
                self.uni[t] += 1
                self.bi[before, t] += 1
                self.ctx[before] += 1
                before = t
        self.n, self.v = sum(self.uni.values()), len(self.uni)
        sizes = Counter(self.bi.values())
        self.d = katz.discounts([sizes[r] for r in range(1, katz.LARGEST + 2)])
        self.followers = defaultdict(list)
        for (c, t), r in self.bi.items():
            self.followers[c].append((t, r))

    def word(self, t):
        return (self.uni[t] + 1) / (self.n + self.v + 1)

    def p(self, c, t):
        if c not in self.ctx:
            return self.word(t)
        r = self.bi[c, t]
        if r:
            kept = r * self.d[r - 1] if r <= katz.LARGEST else r - katz.LEAST_MASS
            return kept / self.ctx[c]
        taken = sum(self.p(c, w) for w, _ in self.followers[c])
        return (1 - taken) / (1 - sum(self.word(w) for w, _ in self.followers[c])) * self.word(t)

    def score(self, text):
        total, before = 0.0, "START "
        for t in tokens(text):
            total += math.log10(self.p(before, t))
            before = t
        return total


def corpus(seed=1):
    rng = random.Random(seed)
    names = ["The", "of", "a", "É", "é"] + [f"w{i}" for i in range(60)]
    weights = [400, 200, 90, 20, 20] + [60 / (1 + i) for i in range(60)]
    rows = [(i, " ".join(rng.choices(names, weights, k=rng.randrange(60)))) for i in range(120)]
    rows += [(500 + i, "never seen words x" + str(i)) for i in range(5)]
    return rows + [(1000, None), (1001, ""), (None, "the of"), (3, "the  OF\n\x0ba"), (1002, "the " * 3000), (1003, "\x1c \x85")]


SCHEMA = "doc_id long, text string, score string, key string"


def training():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2


@pytest.mark.parametrize("per_bucket", [katz.TOKENS_PER_BUCKET, 400, 100])
def test_scores(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(katz, "TOKENS_PER_BUCKET", per_bucket)
    monkeypatch.setattr(katz, "GRAMS_AT_ONCE", 60)
    monkeypatch.setattr(katz, "WORDS_HELD", 50)
    rows = corpus()
    train = [i is not None and zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in rows]
    model = Plain([t for (_, t), ok in zip(rows, train) if ok])
    docs = spark.createDataFrame([(*r, "s", "k") for r in rows], SCHEMA).repartition(3)
    got = katz.score(docs, training()).collect()
    want = sorted(
        (str(i), len(tokens(t)), sum(w in model.uni for w in tokens(t)), model.n, ok,
         sum(math.log10(model.word(w)) for w in tokens(t)), model.score(t))
        for (i, t), ok in zip(rows, train)
    )
    found = sorted(
        (str(r["doc_id"]), r["n_tokens"], r["n_known"], r["train_tokens"], r["training"], r["base_score"], r["score"])
        for r in got
    )
    assert [w[:5] for w in want] == [f[:5] for f in found]
    for w, f in zip(want, found):
        assert f[5:] == pytest.approx(w[5:], rel=1e-9, abs=1e-9)
    if per_bucket < 1000:
        read = katz._read(docs, training())
        total = katz.token_total(read)
        hot = katz.frequent_words(read, math.ceil(total / per_bucket), total)
        assert total == sum(len(tokens(t)) for _, t in rows)
        assert katz.xxhash.xxh64_intdigest(b"the") in hot
        assert hot[katz.xxhash.xxh64_intdigest(b"the")] == model.uni["the"]
        assert (katz.END in hot) == (per_bucket == 100)


def test_every_context_sums_to_one():
    model = Plain([t for _, t in corpus()])
    for c in ["START ", "the", "w3", "never seen", None]:
        everything = [*model.uni, "an unknown word"]
        assert sum(model.p(c, w) for w in everything) == pytest.approx(1)


def test_discounts():
    assert katz.discounts([0] * 6) == [0.5, 0.75, 2.5 / 3, 3.5 / 4, 0.9]
    assert katz.discounts([1000, 300, 150, 90, 60, 40])[0] == pytest.approx((0.6 - 0.24) / 0.76)


def test_small_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert katz.score(empty, training()).count() == 0
    docs = spark.createDataFrame([(1, "a b", "", ""), (2, None, "", "")], SCHEMA)
    none = katz.score(docs, F.lit(False)).collect()
    assert [(r["train_tokens"], r["n_known"], r["base_score"], r["score"]) for r in none] == [(0, 0, 0.0, 0.0)] * 2


def test_packed_arrays_come_back():
    arrays = [[], [0, 255], [256, 70000], [2**63, 1], list(range(1000))]
    arrays = [katz.np.array(a, katz.np.uint64) for a in arrays]
    back = katz.unpacked(katz.packed(*arrays))
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, back))


@pytest.mark.parametrize("per_bucket", [katz.TOKENS_PER_BUCKET, 100])
def test_stored_counts_score_other_texts(spark, monkeypatch, per_bucket):
    monkeypatch.setattr(katz, "TOKENS_PER_BUCKET", per_bucket)
    monkeypatch.setattr(katz, "GRAMS_AT_ONCE", 60)
    rows = corpus()
    docs = spark.createDataFrame([(*r, "s", "k") for r in rows], SCHEMA).repartition(3)
    model = katz.fit(docs, training())
    plain = Plain([t for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 7 != 2])

    def signed(t, start):
        if t == "START ":
            t = " "
        h = katz.xxhash.xxh64_intdigest((t or "").encode())
        return h - (1 << 64) if h >= 1 << 63 else h

    stored = {(r["context"], r["word"]): r["r"] for r in katz.bigrams(model).collect()}
    assert stored == {(signed(c, True), signed(t, False)): r for (c, t), r in plain.bi.items()}
    other = [(1, "the of w1 w2"), (1, "the of w1 w2"), (2, None), (None, "of nothing w3 nothing"), (3, "the " * 50)]
    got = katz.score_texts(model, spark.createDataFrame([(*r, "", "") for r in other], SCHEMA)).collect()
    want = sorted((str(i), len(tokens(t)), plain.score(t)) for i, t in other)
    found = sorted((str(r["doc_id"]), r["n_tokens"], r["score"]) for r in got)
    assert [w[:2] for w in want] == [f[:2] for f in found]
    assert [f[2] for f in found] == pytest.approx([w[2] for w in want], rel=1e-9)
    own = {(r["doc_id"], r["n_tokens"]): r["score"] for r in katz.score(docs, training()).collect()}
    again = {(r["doc_id"], r["n_tokens"]): r["score"] for r in katz.score_texts(model, docs).collect()}
    assert own.keys() == again.keys() and all(own[k] == pytest.approx(again[k], rel=1e-9) for k in own)
