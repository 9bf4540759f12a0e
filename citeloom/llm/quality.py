"""Quality classifier: Bradley-Terry ranking of documents by features of their texts.

A document's strength is a linear function of its features. It is learned from preference
pairs (a document of label 1 is preferred to one of label 0): the logistic loss of the
difference of the two feature vectors, over all pairs of all labelled rows. A quantile of the
training scores is the threshold.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from functools import reduce
from operator import eq
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import fits_broadcast, in_python, stored

#: Score cells of the fit, which bound what a task of it sends.
CELLS = 512
WINDOW_WORDS = 64
WINDOW_BYTES = 512
KEEP_FROM = 0.3

_CLASSES = ("lower", "upper", "digit", "stop", "loud", "bar", "mark", "blank", "line", "high")


def _class_of(b: int) -> int:
    c = chr(b)
    if b > 127:
        return 9
    for n, found in enumerate((
        c.islower(), c.isupper(), c.isdigit(), c in ".,;:'\"-()?", c in "!", c in "|", False,
        c in " \t\x0b\x0c\r", c == "\n",
    )):
        if found:
            return n
    return 6


_TABLE = bytes(_class_of(b) for b in range(256))
_SHARES = (1, 2, 3, 4, 5, 6, 8)  # classes whose share is a feature
FEATURES = (
    ["log_words", "word_length", "repeated_next", "distinct", "loud_words", "bare_words"]
    + [f"share_{_CLASSES[n]}" for n in _SHARES]
    + [f"most_{_CLASSES[n]}" for n in _SHARES]
    + ["most_repeated", "least_distinct", "mean_distinct"]
)
N_FEATURES = 2 * len(FEATURES)


def _with_roots(plain: np.ndarray) -> np.ndarray:
    return np.concatenate([plain, np.sqrt(plain)], axis=-1)


def features(text: bytes) -> np.ndarray:
    """Features of a whole UTF-8 text: shares of character classes and of repeated words, over
    the text and in its worst window. Every value also enters by its square root."""
    words = text.split()
    n = len(words)
    kinds = np.frombuffer(text.translate(_TABLE), np.uint8)
    size = max(1, len(kinds))
    counts = np.bincount(kinds, minlength=10)
    starts = range(0, len(kinds), WINDOW_BYTES)
    edges = np.fromiter(starts, np.int64)
    worst = []
    for c in _SHARES:
        if not counts[c]:
            worst.append(0.0)
            continue
        sums = np.add.reduceat((kinds == c).astype(np.int32), edges)
        widths = np.minimum(WINDOW_BYTES, len(kinds) - edges)
        # A short last window counts as if it were a quarter full.
        worst.append(float((sums / np.maximum(widths, WINDOW_BYTES // 4)).max()))
    repeated = sum(map(eq, words, words[1:])) if n > 1 else 0
    distinct, again = [], 0.0
    for at in range(0, n, WINDOW_WORDS):
        part = words[at : at + WINDOW_WORDS]
        if len(part) * 4 < WINDOW_WORDS and at:
            break
        distinct.append(len(set(part)) / len(part))
        if repeated:
            again = max(again, sum(map(eq, part, part[1:])) / len(part))
    loud = sum(map(bytes.isupper, words)) if counts[1] else 0
    bare = n - sum(map(bytes.isalnum, words)) if counts[0] + counts[1] else n
    values = [
        np.log1p(n) / 10, min(5.0, len(text) / max(1, n) / 10), repeated / max(1, n),
        len(set(words)) / max(1, n), loud / max(1, n), bare / max(1, n),
        *(counts[c] / size for c in _SHARES), *worst,
        again, min(distinct, default=0.0), sum(distinct) / max(1, len(distinct)),
    ]
    return _with_roots(np.array(values, float))


class Model(NamedTuple):
    """score = sigmoid(slope * (weights . (x - mean) / spread - cut) + logit(KEEP_FROM))."""

    weights: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    cut: float
    slope: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = ((x - self.mean) / self.spread) @ self.weights
        at = self.slope * (raw - self.cut) + np.log(KEEP_FROM / (1 - KEEP_FROM))
        return 1 / (1 + np.exp(-np.clip(at, -500, 500)))


class Part(NamedTuple):
    """Rows of one label as count, mean and centred products; parts add up without cancelling."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    @staticmethod
    def of(x: np.ndarray) -> Part:
        if not len(x):
            return Part(0.0, np.zeros(N_FEATURES), np.zeros((N_FEATURES, N_FEATURES)))
        mean = x.mean(axis=0)
        return Part(float(len(x)), mean, (x - mean).T @ (x - mean))

    def plus(self, other: Part) -> Part:
        n = self.n + other.n
        if not self.n or not other.n:
            return self if self.n else other
        gap = other.mean - self.mean
        products = self.products + other.products + np.outer(gap, gap) * (self.n * other.n / n)
        return Part(n, self.mean + gap * (other.n / n), products)


#: What all rows add up to: ``fold`` takes the features and labels of some rows, ``merge`` two results.
Sums = Callable[[Callable, Callable], Any]


class Cells(NamedTuple):
    """Rows of one label by score: per cell their number, sum of scores and sum of features."""

    n: np.ndarray
    score: np.ndarray
    x: np.ndarray

    @staticmethod
    def of(x: np.ndarray, raw: np.ndarray, spread: float) -> Cells:
        """Cells are narrow near 0 and wide far out, so that they need no bounds."""
        share = 0.5 + np.arctan(raw / (2 * spread)) / np.pi
        at = np.minimum(share * CELLS, CELLS - 1).astype(np.int64)
        sums = np.zeros((CELLS, x.shape[1]))
        np.add.at(sums, at, x)
        return Cells(np.bincount(at, minlength=CELLS), np.bincount(at, raw, minlength=CELLS), sums)

    def means(self) -> Cells:
        used = self.n > 0
        n = self.n[used].astype(float)
        return Cells(n, self.score[used] / n, self.x[used] / n[:, None])


def _range(raw: np.ndarray) -> np.ndarray:
    return np.array([raw.min(), -raw.max()]) if len(raw) else np.array([np.inf, np.inf])


def newton(
    sums: Sums, scaled: Callable, within: list[np.ndarray], whole: np.ndarray, ridge: float, steps: int = 40
) -> np.ndarray:
    """Weights of least logistic loss over all pairs of a row of label 1 and a row of label 0.

    The chance that a pair is lost depends on its two scores alone, so all pairs add up from
    the rows by score cell: every row counts, with the mean score of its cell (of ``CELLS``).
    ``within`` are the products of the scaled features about the means of their labels; with
    them the second derivatives are near enough to lead to the same weights. ``whole`` is the
    covariance of all scaled rows, which gives the spread of the scores.
    """
    size = len(within[0])

    def cells(w: np.ndarray) -> list[Cells]:
        spread = max(1e-9, np.sqrt(w @ whole @ w))

        def fold(x, label):
            z = scaled(x)
            raw = z @ w
            return [Cells.of(z[label == k], raw[label == k], spread) for k in (1, 0)]

        found = sums(fold, lambda a, b: [Cells(*map(np.add, *pair)) for pair in zip(a, b)])
        return [c.means() for c in found]

    def loss(good: Cells, bad: Cells, w: np.ndarray) -> float:
        lost = np.logaddexp(0, bad.score[None, :] - good.score[:, None])
        return good.n @ lost @ bad.n / (good.n.sum() * bad.n.sum()) + ridge * (w @ w) / 2

    w = np.zeros(size)
    good, bad = cells(w)
    now = loss(good, bad, w)
    for _ in range(steps):
        pairs = np.outer(good.n, bad.n) / (good.n.sum() * bad.n.sum())
        p = pairs / (1 + np.exp(np.clip(good.score[:, None] - bad.score[None, :], -500, 500)))
        slope = p.sum(axis=1) @ good.x - p.sum(axis=0) @ bad.x - ridge * w
        q = p * (1 - p / pairs)
        cross = good.x.T @ q @ bad.x
        bend = (good.x.T * q.sum(axis=1)) @ good.x + (bad.x.T * q.sum(axis=0)) @ bad.x - cross - cross.T
        # What lies within the cells: the label's products less those between its cells.
        for c, products in zip((good, bad), within):
            centre = c.n @ c.x / c.n.sum()
            between = ((c.x - centre).T * c.n) @ (c.x - centre)
            bend += q.sum() * (products - between) / c.n.sum()
        step = np.linalg.solve(bend + ridge * np.eye(size), slope)
        while True:
            good, bad = cells(w + step)
            then = loss(good, bad, w + step)
            if then <= now + 1e-12 or np.abs(step).max() < 1e-6:
                break
            step /= 4
        w, gain, now = w + step, now - then, then
        if np.abs(step).max() < 1e-6 or gain < 1e-8:
            break
    return w


def _score_at(sums: Sums, score: Callable, k: int) -> tuple[float, float]:
    """The scores of rank ``k`` and ``k`` + 1 (from 0) of all rows, by counts in ever narrower cells."""

    def merge(a, b):
        return [a[0] + b[0], np.minimum(a[1], b[1]), np.maximum(a[2], b[2])]

    low, high = sums(lambda x, label: _range(score(x)), np.minimum) * (1, -1)
    below = 0
    while low < high:

        def fold(x, label, low=low, high=high):
            raw = score(x)
            raw = raw[(raw >= low) & (raw <= high)]
            at = np.clip((raw - low) / (high - low) * CELLS, 0, CELLS - 1).astype(np.int64)
            least, most = np.full(CELLS, np.inf), np.full(CELLS, -np.inf)
            np.minimum.at(least, at, raw)
            np.maximum.at(most, at, raw)
            return [np.bincount(at, minlength=CELLS), least, most]

        n, least, most = sums(fold, merge)
        cell = int(np.searchsorted(below + np.cumsum(n), k, side="right"))
        below += int(n[:cell].sum())
        low, high = float(least[cell]), float(most[cell])

    def around(x, label):
        raw = score(x)
        return [(raw <= low).sum(), raw[raw > low].min(initial=np.inf), 0.0]

    up_to, above, _ = sums(around, merge)
    return low, low if up_to > k + 1 else float(above)


def learn(sums: Sums, ridge: float = 1e-4) -> Model:
    """Learn the strengths from all preference pairs and cut them at a score quantile.

    The cut is the quantile of the training scores at the share of label 0, halfway to the
    next higher score. Without both labels nothing can be preferred: every document gets the score KEEP_FROM.
    """
    good, bad = sums(
        lambda x, label: [Part.of(x[label == k]) for k in (1, 0)], lambda a, b: [p.plus(q) for p, q in zip(a, b)]
    )
    both = good.plus(bad)
    spread = np.sqrt(np.diag(both.products) / max(1.0, both.n))
    spread = np.where(spread > 1e-12, spread, 1.0)
    if not both.n:
        return Model(np.zeros(N_FEATURES), np.zeros(N_FEATURES), np.ones(N_FEATURES), 0.0, 1.0)
    if not good.n or not bad.n:
        return Model(np.zeros(N_FEATURES), both.mean, spread, 0.0, 1.0)
    scale = np.outer(spread, spread)

    def scaled(x: np.ndarray) -> np.ndarray:
        return (x - both.mean) / spread

    whole = both.products / scale / both.n
    w = newton(sums, scaled, [good.products / scale, bad.products / scale], whole, ridge)
    at, above = _score_at(sums, lambda x: scaled(x) @ w, int(bad.n) - 1)
    return Model(w, both.mean, spread, (at + above) / 2, 1.0)


def fit(x: np.ndarray, label: np.ndarray, ridge: float = 1e-4) -> Model:
    """``learn`` from rows at hand."""
    return learn(lambda fold, merge: fold(x, label), ridge)


def _sums_of(rows: DataFrame) -> Sums:
    """Sums over a stored table of (x, label): a task sends one result, whatever its rows."""

    def sums(fold: Callable, merge: Callable):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found = None
            for batch in batches:
                if batch.num_rows:
                    plain = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
                    part = fold(_with_roots(plain), batch.column("label").to_numpy())
                    found = part if found is None else merge(found, part)
            if found is not None:
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["part"])

        parts = (pickle.loads(r["part"]) for r in in_python(rows, run, "part binary").toLocalIterator())
        none = fold(np.zeros((0, N_FEATURES)), np.zeros(0, int))
        return reduce(merge, parts, none)

    return sums


def _crc(column) -> F.Column:
    return F.crc32(column.cast("string").cast("binary"))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    Labels other than 0 and 1, null ids and ids with contradicting labels teach nothing; a
    repeated doc_id counts once, by its least text. The features are written once; each step
    of the fit is one pass over them, of which a task sends sums of a fixed size. Few label
    ids are broadcast; where they are many, the features meet them, so texts never travel.
    """
    known = stored(
        labels.filter("quality in (0, 1) and doc_id is not null")
        .filter(_crc(F.col("doc_id")) % 5 != 0)
        .groupBy("doc_id")
        .agg(F.min("quality").cast("int").alias("label"), F.max("quality").alias("other"))
        .filter("label = other")
        .select("doc_id", "label"),
        "known",
    )
    texts = docs.filter(_crc(F.col("doc_id")) % 5 != 0).select(
        "doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py())[: len(FEATURES)].tolist() for t in batch.column("text")]
            arrays = [batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "x"])

    few = fits_broadcast(known)
    chosen = texts.join(F.broadcast(known), "doc_id", "left_semi") if few else texts
    id_type = docs.schema["doc_id"].dataType.simpleString()
    made = in_python(chosen, run, f"doc_id {id_type}, x array<double>")
    rows = made.groupBy("doc_id").agg(F.min("x").alias("x"))
    rows = rows.join(F.broadcast(known) if few else known, "doc_id").select("x", "label")
    return learn(_sums_of(stored(rows, "features")))


SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (score >= 0.3).

    Null texts are scored as empty ones. Null and repeated doc_ids stay; a null one is not
    held out. An empty table gives no rows. Other columns are never read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py() or b"") for t in batch.column(2)]
            scores = model.scores(np.array(x).reshape(-1, N_FEATURES))
            arrays = [
                batch.column(0), batch.column(1), pa.array(scores),
                pa.array((scores >= KEEP_FROM).astype(np.int32)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "held_out", "score", "predicted"])

    held = F.coalesce(_crc(F.col("doc_id")) % 5 == 0, F.lit(False)).alias("held_out")
    read = docs.select(F.col("doc_id").cast("long"), held, F.col("text").cast("binary"))
    return in_python(read, run, SCHEMA)


def kept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents the model keeps, with all their columns, whatever their names.

    A null text is scored as the empty one; repeated rows are kept or go together; a score at
    the threshold is kept. No rows: no rows.
    """
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index("text")
        for batch in batches:
            texts = batch.column(at).to_pylist()
            x = [features((t or "").encode()) for t in texts]
            keep = model.scores(np.array(x).reshape(-1, N_FEATURES)) >= KEEP_FROM
            yield batch.filter(pa.array(keep))

    return in_python(docs, run, docs.schema)
