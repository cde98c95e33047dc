"""Toxic passages by maximum-scoring segments.

Each token has a log-odds score between toxic and other texts with a Dirichlet prior
taken from the whole corpus; its units are the word itself and its beginnings, so that forms
never seen are scored by their stem; the unit with the largest z speaks for a word.  A linear scan finds every maximal scoring
segment of the token sequence.  Segment scores are put on an extreme-value scale (a Gumbel law
in the logarithm of the text's length), the significant ones are added up, and a
logistic curve gives the score of the text.

Class counts come from a bounded, documented sample (``train_rows`` labelled rows), the prior
from all documents.  All passes over texts run on executors.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.common import columns, label_sample, written
from shelfledger.llm.quality import logistic_curve

TRAIN_ROWS = 20_000
#: Units kept by the model, those with the largest z first: the bound of what is sent to each task.
MAX_UNITS = 20_000
MIN_TOXIC_TEXTS = 5
MIN_Z = 4.0
#: A unit's score is the lower end of its log-odds, so many standard errors down, at least MIN_SCORE.
ERRORS_DOWN = 1.64
MIN_SCORE = 1.0
GAP = 0.5
#: Weight of the prior in tokens: a share of the sample, up to a bound.
PRIOR_TOKENS = 10_000.0
PRIOR_SHARE = 0.01
STEM_LETTERS = (4, 5, 6, 7, 8)
CACHE_WORDS = 300_000
SCORE_CAP = 6.0
SIGNIFICANT = 0.05
ACCEPT = 0.5

SEGMENTS = "array<struct<first_token:int,last_token:int,start:int,end:int,score:double,p_value:double>>"

_TOKEN = re.compile(r"[^\W\d_]+")


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall(text.lower()) if text else []


def units_of(word: str) -> list[str]:
    """The word and its beginnings of 4 to 8 letters (``stem*``)."""
    return [word] + [word[:n] + "*" for n in STEM_LETTERS if len(word) > n]


def maximal_segments(places: list[int], scores: list[float], gap: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments, by one linear scan (Ruzzo and Tompa).

    ``places`` are the tokens with their own score, in order; every other token costs ``gap``.
    Returns (first, last, score) as indexes into ``places``.
    """
    left: list[float] = []
    right: list[float] = []
    bounds: list[tuple[int, int]] = []
    total, before = 0.0, -1
    for k, (place, value) in enumerate(zip(places, scores, strict=True)):
        total -= gap * (place - before - 1)
        before = place
        if value <= 0:
            total += value
            continue
        low, high, first = total, total + value, k
        total = high
        while True:
            j = len(left) - 1
            while j >= 0 and left[j] >= low:
                j -= 1
            if j < 0 or right[j] >= high:
                break
            low, first = left[j], bounds[j][0]
            del left[j:], right[j:], bounds[j:]
        left.append(low)
        right.append(high)
        bounds.append((first, k))
    return [(a, b, h - v) for (a, b), h, v in zip(bounds, right, left, strict=True)]


class Model:
    """Unit scores, cost of other tokens, extreme-value law (rate, log K) and score curve."""

    def __init__(self, units: dict[str, tuple[float, float]], gap: float = GAP):
        self.units, self.gap = units, gap
        self.rate, self.log_k = 1.0, 0.0
        self.slope, self.shift = 1.0, -5.0
        self._words: dict[str, float] = {}

    def __getstate__(self):
        return self.__dict__ | {"_words": {}}

    def word_score(self, word: str) -> float:
        known = [self.units[u] for u in units_of(word) if u in self.units]
        return max(known)[1] if known else -self.gap

    def scan(self, words: list[str]) -> list[tuple[int, int, float]]:
        """(first token, last token, score) of every maximal segment."""
        cache = self._words
        if len(cache) > CACHE_WORDS:
            cache.clear()
        for w in set(words).difference(cache):
            cache[w] = self.word_score(w)
        values = np.fromiter(map(cache.__getitem__, words), np.float64, len(words))
        again = [k for k in range(1, len(words)) if words[k] == words[k - 1]]
        values[again] = -self.gap  # a word said twice in a row is no more toxic than said once
        places = np.flatnonzero(values != -self.gap)
        found = maximal_segments(places.tolist(), values[places].tolist(), self.gap)
        return [(int(places[a]), int(places[b]), s) for a, b, s in found]

    def p_value(self, score: float, tokens: int) -> float:
        """Chance that a clean text of so many tokens has a segment with this score."""
        log_mean = self.log_k + math.log(max(tokens, 1)) - self.rate * score
        return -math.expm1(-math.exp(min(log_mean, 700.0)))

    def evidence(self, segments: list[tuple[int, int, float]], tokens: int) -> float:
        """Largest normalised sum of the best r scores, for any r (zero without segments)."""
        best, total = 0.0, 0.0
        scores = sorted((s for _, _, s in segments), reverse=True)
        for r, s in enumerate(scores, 1):
            total += self.rate * s - self.log_k - math.log(max(tokens, 1))
            best = max(best, total + math.lgamma(r + 1))
        return best

    def probability(self, evidence: float) -> float:
        z = min(max(self.slope * evidence + self.shift, -40.0), 40.0)
        return 1.0 / (1.0 + math.exp(-z))

    def passages(self, text: str | None, segments, tokens: int) -> list[dict]:
        """The significant segments, with their place in the text."""
        kept = [
            (a, b, s, p) for a, b, s in segments if (p := self.p_value(s, tokens)) <= SIGNIFICANT
        ]
        if not kept:
            return []
        spans = [m.span() for m in _TOKEN.finditer(text.lower())]
        same = len(text.lower()) == len(text)  # a few letters change length in lower case
        return [
            {
                "first_token": a,
                "last_token": b,
                "start": spans[a][0] if same else None,
                "end": spans[b][1] if same else None,
                "score": s,
                "p_value": p,
            }
            for a, b, s, p in kept
        ]


# --- learning -------------------------------------------------------------------------------


def _class_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tokens and texts per unit and class of a task; unit '' counts all tokens.

    A word counts once in a text, however often it is repeated there.
    """
    tokens: Counter = Counter()
    texts: Counter = Counter()
    for batch in batches:
        for text, label in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = set(tokens_of(text))
            tokens["", label] += len(words)
            texts["", label] += 1
            units = Counter(u for w in words for u in units_of(w))
            for u, n in units.items():
                tokens[u, label] += n
                texts[u, label] += 1
    keys = list(tokens)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k[0] for k in keys], pa.string()),
            pa.array([k[1] for k in keys], pa.int32()),
            pa.array([tokens[k] for k in keys], pa.int64()),
            pa.array([texts[k] for k in keys], pa.int64()),
        ],
        names=["unit", "label", "tokens", "texts"],
    )


def class_counts(sample: DataFrame, min_texts: int = MIN_TOXIC_TEXTS) -> DataFrame:
    """(unit, y1, y0) of units in at least ``min_texts`` toxic texts, and of '' for all tokens."""
    part = sample.mapInArrow(_class_counts, "unit string, label int, tokens long, texts long")
    one, n = F.col("label") == 1, F.col("tokens")
    summed = part.groupBy("unit").agg(
        F.coalesce(F.sum(F.when(one, n)), F.lit(0)).alias("y1"),
        F.coalesce(F.sum(F.when(~one, n)), F.lit(0)).alias("y0"),
        F.coalesce(F.sum(F.when(one, F.col("texts"))), F.lit(0)).alias("texts"),
    )
    return summed.filter((F.col("texts") >= min_texts) | (F.col("unit") == "")).drop("texts")


def corpus_counts(docs: DataFrame, text: str, units: set[str]) -> dict[str, int]:
    """How often each of the (bounded) units occurs in all documents; '' counts all tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        known: dict[str, list[str]] = {}
        for batch in batches:
            for value in batch.column(0):
                words = set(tokens_of(value.as_py()))
                found[""] += len(words)
                if len(known) > CACHE_WORDS:
                    known.clear()
                for w in words.difference(known):
                    known[w] = [u for u in units_of(w) if u in units]
                for hits in map(known.__getitem__, words):
                    for u in hits:
                        found[u] += 1
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())],
            names=["unit", "n"],
        )

    part = docs.select(text).mapInArrow(count, "unit string, n long")
    return {r[0]: r[1] for r in part.groupBy("unit").agg(F.sum("n")).collect()}


def unit_scores(
    counts: dict[str, tuple[int, int]], prior: dict[str, int], max_units: int = MAX_UNITS
) -> dict[str, tuple[float, float]]:
    """(z, score) by log-odds with an informative Dirichlet prior, of units with z above MIN_Z."""
    n1, n0 = counts.get("", (0, 0))
    total = max(prior.get("", 0), 1)
    weight = min(PRIOR_TOKENS, max(PRIOR_SHARE * (n1 + n0), 1.0))
    out = []
    for unit, (y1, y0) in counts.items():
        if not unit:
            continue
        a = weight * max(prior.get(unit, 0), 1) / total
        rest1, rest0 = n1 + weight - y1 - a, n0 + weight - y0 - a
        delta = math.log((y1 + a) / max(rest1, 1.0)) - math.log((y0 + a) / max(rest0, 1.0))
        error = math.sqrt(1 / (y1 + a) + 1 / (y0 + a))
        score = min(delta - ERRORS_DOWN * error, SCORE_CAP)
        if delta >= MIN_Z * error and score >= MIN_SCORE:
            out.append((-delta / error, unit, score))
    return {unit: (-z, score) for z, unit, score in sorted(out)[:max_units]}


def extreme_value_law(
    best: np.ndarray, tokens: np.ndarray, scores: np.ndarray, weights: np.ndarray
) -> tuple[float, float]:
    """Rate: the positive root of E[exp(rate * score)] = 1 over clean tokens; log K from the
    mean of the clean texts' best scores, for a Gumbel law in log tokens."""
    low, high = 1e-4, 10.0

    def excess(rate: float) -> float:
        return float((weights * np.exp(np.minimum(rate * scores, 700))).sum() / weights.sum()) - 1

    if not len(scores) or scores.max() <= 0:
        return 1.0, 0.0
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    rate = (low + high) / 2
    log_k = float((rate * best - np.log(np.maximum(tokens, 1))).mean() - 0.5772156649)
    return rate, log_k


def learn(
    docs: DataFrame,
    labels: DataFrame,
    label: str = "toxic",
    doc_id: str = "doc_id",
    text: str = "text",
    folds: int = 5,
    held: int = 0,
    train_rows: int = TRAIN_ROWS,
) -> Model:
    """Fit outside the held-out fold.  Without labels of both classes no text is toxic.

    Counts, extreme-value law and score curve all use the same sample, at every size of the tables.
    """
    chosen = written(
        label_sample(labels, label, folds=folds, held=held, rows=train_rows, doc_id=doc_id)
    )
    texts = columns(docs, doc_id, text)
    sample = texts.join(F.broadcast(chosen), doc_id).select(
        text, F.col(label).cast("int").alias("label")
    )
    # Copies of a text would count its chance words several times.
    sample = written(
        sample.filter(F.col(text).isNotNull()).dropDuplicates([text, "label"])
    )
    counts = {r[0]: (r[1], r[2]) for r in class_counts(sample.select(text, "label")).collect()}
    n1, n0 = counts.get("", (0, 0))
    if not n1 or not n0:
        return Model({})
    prior = corpus_counts(texts, text, set(counts) - {""})
    model = Model(unit_scores(counts, prior))
    scan = F.pandas_udf(_scanner(model), "tokens int, segments array<double>, found array<double>")
    rows = sample.select("label", scan(F.col(text)).alias("r")).select("label", "r.*").collect()
    marks = np.array([r[0] for r in rows])
    tokens = np.array([r[1] for r in rows], np.float64)
    best = np.array([max(r[2], default=0.0) for r in rows])
    clean = (marks == 0) & (tokens > 0)
    if clean.any():
        own = np.array([s for r, c in zip(rows, clean, strict=True) if c for s in r[3]])
        distinct, times = np.unique(own, return_counts=True)
        values = np.append(distinct, -model.gap)
        weights = np.append(times.astype(float), max(tokens[clean].sum() - len(own), 1.0))
        model.rate, model.log_k = extreme_value_law(best[clean], tokens[clean], values, weights)
    evidence = np.array([model.evidence([(0, 0, s) for s in r[2]], r[1]) for r in rows])
    if len(set(marks.tolist())) == 2:
        model.slope, model.shift = logistic_curve(evidence, marks)
    return model


def _scanner(model: Model):
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                words = tokens_of(text)
                segments = model.scan(words)
                cache = model._words
                own = [cache[w] for w in words if cache[w] != -model.gap]
                rows.append((len(words), [s for _, _, s in segments], own))
            yield pd.DataFrame(rows, columns=["tokens", "segments", "found"])

    scan.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return scan


# --- scoring --------------------------------------------------------------------------------


def passages(model: Model, text: str) -> Column:
    """Struct of score, evidence, tokens and the significant passages of ``text``."""

    @F.pandas_udf(f"score double, evidence double, n_tokens int, passages {SEGMENTS}")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for value in texts:
                words = tokens_of(value)
                segments = model.scan(words)
                evidence = model.evidence(segments, len(words))
                rows.append(
                    (
                        model.probability(evidence),
                        evidence,
                        len(words),
                        model.passages(value, segments, len(words)),
                    )
                )
            yield pd.DataFrame(rows, columns=["score", "evidence", "n_tokens", "passages"])

    return find.asNondeterministic()(F.col(text))


def detect(
    docs: DataFrame,
    model: Model,
    doc_id: str = "doc_id",
    text: str = "text",
    accept: float = ACCEPT,
) -> DataFrame:
    """One row per document: score, prediction, number of tokens and significant passages.

    ``start`` and ``end`` are code points of the text, null where lower case changes its
    length.  Null, empty and wordless texts have no segment and the lowest score.
    Repeated rows are scored each; a null id stays null.  An empty table gives no rows; other columns are left
    out; texts of any length are scanned whole.
    """
    found = columns(docs, doc_id, text).select(
        F.col(doc_id).alias("doc_id"), passages(model, text).alias("found")
    )
    return found.select(
        "doc_id",
        F.col("found.score").alias("score"),
        (F.col("found.score") >= accept).cast("int").alias("predicted"),
        F.col("found.n_tokens").alias("n_tokens"),
        F.col("found.passages").alias("passages"),
    )
