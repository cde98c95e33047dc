"""Quality classifier: naive Bayes support vectors.

Indicators of word n-grams and of word-shape n-grams are scaled by their class
log-count ratios; a linear hinge-loss model over them is fitted by dual coordinate
descent, and a logistic curve turns its margin into a score.

Learning uses a bounded, documented sample (``train_rows`` labelled rows) on the driver; its indicators
are computed on executors.  Scoring reads whole texts on executors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.common import bounded_sample, columns, label_sample

BUCKETS = 1 << 18
TRAIN_ROWS = 6000
#: Words whose codes a task remembers; more are computed again.
CACHE_WORDS = 500_000
ACCEPT = 0.3

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shape_of(word: str) -> str:
    """Letters to ``a`` or ``A``, digits to ``9``, runs of these shortened to one; the whole word counts."""
    out: list[str] = []
    for c in word:
        s = ("A" if c.isupper() else "a") if c.isalpha() else "9" if c.isdigit() else c
        if not out or out[-1] != s or not c.isalnum():
            out.append(s)
    return "".join(out)


class Words:
    """Bounded memory of the codes of words: (word code, shape code)."""

    def __init__(self, cache_words: int = CACHE_WORDS):
        self.cache_words = cache_words
        self.codes: dict[str, tuple[int, int]] = {}

    def __getstate__(self):
        return {"cache_words": self.cache_words, "codes": {}}

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        codes = self.codes
        if len(codes) > self.cache_words:
            codes.clear()
        for w in set(words).difference(codes):
            codes[w] = (zlib.crc32(w.lower().encode()), zlib.crc32(b"\x01" + shape_of(w).encode()))
        pairs = np.array([codes[w] for w in words], np.uint64).reshape(-1, 2)
        return pairs[:, 0], pairs[:, 1]


def _gram(kind: int, *parts: np.ndarray) -> np.ndarray:
    total = np.full(len(parts[0]), kind, np.uint64)
    for part in parts:
        total = (total ^ part) * _MIX
        total ^= total >> np.uint64(29)
    return total


def indicators(text: str | None, words: Words, buckets: int = BUCKETS) -> np.ndarray:
    """Sorted distinct indicator numbers of one whole text.

    Words and word pairs, shapes up to three in a row, whether a word
    repeats the one before, and the order of magnitude of the number of words.
    """
    split = (text or "").split()
    n = len(split)
    size = np.array([int(2 * np.log2(n + 1))], np.uint64)
    grams = [_gram(9, size)]
    if n:
        w, s = words(split)
        again = np.zeros(n, np.uint64)
        again[1:] = w[1:] == w[:-1]
        grams += [_gram(1, w), _gram(2, w[:-1], w[1:])]
        grams += [_gram(3, s), _gram(4, s[:-1], s[1:]), _gram(5, s[:-2], s[1:-1], s[2:])]
        grams += [_gram(6, again), _gram(7, again[:-1], again[1:])]
    return np.unique(np.concatenate(grams) % np.uint64(buckets)).astype(np.int32)


class Model:
    """Weight of each indicator (ratio times coefficient), offset and score curve."""

    def __init__(self, weights: np.ndarray, offset: float, slope: float, shift: float):
        self.weights, self.offset, self.slope, self.shift = weights, offset, slope, shift
        self.words = Words()

    def margin(self, text: str | None) -> float:
        found = indicators(text, self.words, len(self.weights))
        return float(self.weights[found].sum() / np.sqrt(len(found)) + self.offset)

    def score(self, text: str | None) -> float:
        z = np.clip(self.slope * self.margin(text) + self.shift, -40, 40)
        return float(1 / (1 + np.exp(-z)))


def log_count_ratios(
    rows: list[np.ndarray], labels: np.ndarray, buckets: int, smoothing: float = 1.0
) -> np.ndarray:
    counts = np.full((2, buckets), smoothing)
    for found, label in zip(rows, labels, strict=True):
        counts[int(label > 0), found] += 1
    shares = counts / counts.sum(axis=1, keepdims=True)
    return np.log(shares[1] / shares[0])


def dual_coordinate_descent(
    rows: list[np.ndarray], values: list[np.ndarray], signs: np.ndarray, width: int,
    costs: np.ndarray, epochs: int = 15, seed: int = 3,
) -> np.ndarray:
    """Weights of the hinge-loss model; the last one belongs to a constant feature."""
    weights = np.zeros(width + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for k in rng.permutation(len(rows)):
            at, value, sign = rows[k], values[k], signs[k]
            slack = sign * (value @ weights[at] + weights[-1]) - 1
            new = min(max(alpha[k] - slack / norm[k], 0.0), costs[k])
            if new != alpha[k]:
                move = (new - alpha[k]) * sign
                weights[at] += move * value
                weights[-1] += move
                alpha[k] = new
    return weights


def logistic_curve(margins: np.ndarray, labels: np.ndarray, rounds: int = 60) -> tuple[float, float]:
    """Slope and shift that make the margin a probability (damped Newton, smoothed targets)."""
    pos, neg = labels.sum(), len(labels) - labels.sum()
    target = np.where(labels > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    mean, spread = margins.mean(), margins.std() or 1.0
    x = np.column_stack([(margins - mean) / spread, np.ones(len(margins))])

    def loss(beta: np.ndarray) -> float:
        z = x @ beta
        return float((np.logaddexp(0, z) - target * z).sum() + 1e-3 * beta @ beta)

    beta = np.zeros(2)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -500, 500)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 2e-3 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (p - target) + 2e-3 * beta)
        size = 1.0
        while loss(beta - size * step) > loss(beta) and size > 1e-6:
            size /= 2
        beta = beta - size * step
    return float(beta[0] / spread), float(beta[1] - beta[0] * mean / spread)


def fit(rows: list[np.ndarray], labels: np.ndarray, buckets: int = BUCKETS, cost: float = 1.0) -> Model:
    """Four fifths of the rows train the weights, the rest the score curve."""
    if len(rows) < 10 or labels.min() == labels.max():
        share = (labels.sum() + 1) / (len(labels) + 2) if len(labels) else 0.5
        return Model(np.zeros(buckets, np.float32), 0.0, 0.0, float(np.log(share / (1 - share))))
    curve = np.arange(len(rows)) % 5 == 0

    def train(keep: np.ndarray) -> tuple[np.ndarray, float]:
        part = [rows[k] for k in np.flatnonzero(keep)]
        marks = labels[keep]
        ratios = log_count_ratios(part, marks, buckets)
        values = [ratios[r] / np.sqrt(len(r)) for r in part]
        share = marks.mean()
        costs = cost * np.where(marks > 0, 0.5 / max(share, 1e-9), 0.5 / max(1 - share, 1e-9))
        weights = dual_coordinate_descent(part, values, np.where(marks > 0, 1.0, -1.0), buckets, costs)
        return ratios * weights[:-1], float(weights[-1])

    weights, offset = train(~curve)
    margins = np.array([weights[r].sum() / np.sqrt(len(r)) + offset for r in rows])
    if labels[curve].min() == labels[curve].max():
        curve[:] = True
    slope, shift = logistic_curve(margins[curve], labels[curve])
    return Model(weights.astype(np.float32), offset, slope, shift)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "quality",
    doc_id: str = "doc_id",
    text: str = "text",
    folds: int = 5,
    held: int = 0,
    train_rows: int = TRAIN_ROWS,
) -> Model:
    """Fit on at most ``train_rows`` labelled rows outside the held-out fold.

    Without labels, or with one class only, every text gets the share of label 1.
    """
    chosen = label_sample(labels, label, folds=folds, held=held, rows=train_rows, doc_id=doc_id)
    words = Words()

    @F.pandas_udf("array<int>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([indicators(t, words) for t in texts])

    rows = columns(docs, doc_id, text).join(F.broadcast(chosen), doc_id)
    rows = rows.select(doc_id, F.col(label).cast("int").alias("label"), text)
    rows = bounded_sample(rows, doc_id, 2 * train_rows)
    rows = rows.select(doc_id, "label", found(F.col(text)).alias("found"))
    sample = sorted(
        ((r[0], r[1], np.array(r[2], np.int32)) for r in rows.toLocalIterator()),
        key=lambda r: (r[0], r[1], len(r[2])),
    )
    return fit([r[2] for r in sample], np.array([r[1] for r in sample], np.int64))


def score(model: Model, text: str) -> Column:
    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([model.score(t) for t in texts], dtype="float64")

    return scored.asNondeterministic()(F.col(text))


def classify(
    docs: DataFrame,
    model: Model,
    doc_id: str = "doc_id",
    text: str = "text",
    accept: float = ACCEPT,
) -> DataFrame:
    """(doc_id, score, predicted) of every row; null texts count as empty, which have a score too.

    Repeated rows are scored each; a null id stays null.
    """
    scored = columns(docs, doc_id, text).select(
        F.col(doc_id).alias("doc_id"), score(model, text).alias("score")
    )
    return scored.select("doc_id", "score", (F.col("score") >= accept).cast("int").alias("predicted"))
