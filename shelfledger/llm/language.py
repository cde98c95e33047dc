"""Language of code-switched text by a linear-chain conditional random field.

Every word is labelled: its affixes, letter n-grams and, if it is in the learned lexicon,
the word itself give emission scores, and learned transitions tie neighbours together.
Forward-backward gives the marginal of each word; a document takes the
language with the largest marginal mass over letters.

Learning uses a bounded, documented sample (``train_docs`` documents, a span of
``span_chars`` characters of each) on the driver; code-switched sequences are made by
joining spans of different documents.  Prediction runs over whole texts on executors.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.common import bounded_sample, columns

UNKNOWN = "und"
TRAIN_DOCS = 4000
SPAN_CHARS = 600
LEXICON_WORDS = 400
MIN_COUNT = 3
#: Words whose scores a task remembers; more are computed again.
CACHE_WORDS = 300_000
#: Letters of a long word whose n-grams are counted together; all of its letters count.
PIECE_LETTERS = 10_000
#: Words labelled together; one longer document is a batch of its own.
BATCH_WORDS = 200_000

PREDICTION = "lang string, score double, words int, switches int, shares map<string,double>"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _ngrams(marked: str, first: int, last: int) -> list[str]:
    """Bigrams and trigrams that begin at ``first`` to ``last - 1``."""
    out = [marked[k : k + 2] for k in range(first, min(last, len(marked) - 1))]
    return out + [marked[k : k + 3] for k in range(first, min(last, len(marked) - 2))]


def word_features(word: str, lexicon: dict[str, int] | set[str], ngrams: bool = True) -> list[str]:
    """Affixes of up to three letters, all bigrams and trigrams with edges, lexicon entry, script."""
    marked = f"^{word}$"
    out = [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)]
    if ngrams:
        out += _ngrams(marked, 0, len(marked))
    if word in lexicon:
        out.append(f"w{word}")
    out.append(f"u{ord(word[0]) >> 7}")
    return out


def forward_backward(
    emissions: np.ndarray, starts: np.ndarray, lengths: np.ndarray, start: np.ndarray,
    transitions: np.ndarray,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of sequences laid end to end.

    ``emissions`` (words, labels) are log scores; sequence k covers the words from
    ``starts[k]``, ``lengths[k]`` of them (at least one).  Sequences must come longest first, so
    that step t works on the first ones only.  Returns the marginals, the normalised forward
    and the normalised backward messages.
    """
    scores = np.exp(emissions - emissions.max(axis=1, keepdims=True))
    step = np.exp(transitions)
    forward = np.empty_like(scores)
    backward = np.empty_like(scores)
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(1, longest + 1), "right")
    message = np.exp(start - start.max())[None, :] * scores[starts]
    for t in range(longest):
        n = active[t]
        if t:
            message = (message[:n] @ step) * scores[starts[:n] + t]
        message = message / message.sum(axis=1, keepdims=True)
        forward[starts[:n] + t] = message
    message = np.empty((0, scores.shape[1]))
    for t in range(longest - 1, -1, -1):
        n = active[t]
        ended = np.ones((n - len(message), scores.shape[1]))
        if len(message):
            at = starts[: len(message)] + t + 1
            message = (message * scores[at]) @ step.T
        message = np.concatenate([message, ended])
        message = message / message.sum(axis=1, keepdims=True)
        backward[starts[:n] + t] = message
    marginals = forward * backward
    marginals /= marginals.sum(axis=1, keepdims=True)
    return marginals, forward, backward


class Model:
    """Feature weights, transitions and a bounded memory of word scores."""

    def __init__(self, labels, features, weights, start, transitions, lexicon):
        self.labels: list[str] = labels
        self.features: dict[str, int] = features
        self.weights: np.ndarray = weights
        self.start: np.ndarray = start
        self.transitions: np.ndarray = transitions
        self.lexicon: set[str] = lexicon
        self._ids: dict[str, int] = {}
        self._scores = np.empty((0, len(labels)))

    def __getstate__(self):
        return self.__dict__ | {"_ids": {}, "_scores": np.empty((0, len(self.labels)))}

    def _long_score(self, word: str) -> np.ndarray:
        """Score of a word of any length; its n-grams are counted piece by piece."""
        counts = Counter(f for f in word_features(word, self.lexicon, ngrams=False) if f in self.features)
        marked = f"^{word}$"
        for at in range(0, len(marked), PIECE_LETTERS):
            counts.update(f for f in _ngrams(marked, at, at + PIECE_LETTERS) if f in self.features)
        ids = np.array([self.features[f] for f in counts], np.int64)
        return np.array(list(counts.values()), np.float64) @ self.weights[ids]

    def emissions(self, words: list[str]) -> np.ndarray:
        if len(self._ids) > CACHE_WORDS:
            self._ids, self._scores = {}, self._scores[:0]
        ids = self._ids
        new = [w for w in dict.fromkeys(words) if w not in ids]
        if new:
            ids.update(zip(new, range(len(ids), len(ids) + len(new)), strict=True))
            flat, ends = [], []
            features, lexicon = self.features, self.lexicon
            long = [k for k, word in enumerate(new) if len(word) > PIECE_LETTERS]
            for word in new:
                if len(word) <= PIECE_LETTERS:
                    flat += [features[f] for f in word_features(word, lexicon) if f in features]
                ends.append(len(flat))
            total = np.zeros((len(new) + 1, len(self.labels)))
            if flat:
                sums = np.cumsum(self.weights[np.array(flat)], axis=0)
                total[1:] = np.concatenate([total[:1], sums])[np.array(ends)]
            scores = np.diff(total, axis=0)
            for k in long:
                scores[k] = self._long_score(new[k])
            self._scores = np.concatenate([self._scores, scores])
        return self._scores[np.fromiter(map(ids.__getitem__, words), np.int64, len(words))]

    def label(self, texts: list[list[str]]) -> list[np.ndarray]:
        """Marginals of each list of words."""
        order = sorted(range(len(texts)), key=lambda k: -len(texts[k]))
        out: list[np.ndarray] = [np.empty((0, len(self.labels)))] * len(texts)
        order = [k for k in order if texts[k]]
        while order:
            total, take = 0, 0
            while take < len(order) and (not take or total + len(texts[order[take]]) <= BATCH_WORDS):
                total += len(texts[order[take]])
                take += 1
            part, order = order[:take], order[take:]
            lengths = np.array([len(texts[k]) for k in part])
            starts = np.cumsum(lengths) - lengths
            scores = self.emissions([w for k in part for w in texts[k]])
            marginals, _, _ = forward_backward(
                scores, starts, lengths, self.start, self.transitions
            )
            for k, at, n in zip(part, starts, lengths, strict=True):
                out[k] = marginals[at : at + n]
        return out

    def predict(self, texts: list[str | None]) -> pd.DataFrame:
        rows = []
        split = [words_of(t) for t in texts]
        labelled = self.label(split) if self.labels else [None] * len(split)
        for words, marginals in zip(split, labelled, strict=True):
            if not words or not self.labels:
                rows.append((UNKNOWN, 0.0, len(words), 0, {}))
                continue
            letters = np.fromiter(map(len, words), np.float64, len(words))
            shares = letters @ marginals / letters.sum()
            best = int(shares.argmax())
            path = marginals.argmax(axis=1)
            rows.append(
                (
                    self.labels[best],
                    float(min(1.0, shares[best])),
                    len(words),
                    int((np.diff(path) != 0).sum()),
                    dict(zip(self.labels, map(float, shares), strict=True)),
                )
            )
        return pd.DataFrame(rows, columns=["lang", "score", "words", "switches", "shares"])


def training_sequences(
    spans: list[tuple[list[str], int]], seed: int = 7
) -> list[tuple[list[str], list[int]]]:
    """Code-switched sequences: pieces of 4 to 30 words, one to four of them in a row."""
    rng = np.random.default_rng(seed)
    pieces = []
    for words, label in spans:
        at = 0
        while at < len(words):
            n = int(rng.integers(4, 31))
            pieces.append((words[at : at + n], label))
            at += n
    order = rng.permutation(len(pieces))
    out, at = [], 0
    while at < len(order):
        n = int(rng.integers(1, 5))
        words: list[str] = []
        labels: list[int] = []
        for k in order[at : at + n]:
            words += pieces[k][0]
            labels += [pieces[k][1]] * len(pieces[k][0])
        out.append((words, labels))
        at += n
    return out


def fit(
    samples: list[tuple[str, str]], lexicon_words: int = LEXICON_WORDS, epochs: int = 3,
    batch: int = 64, rate: float = 0.3, decay: float = 1e-5, seed: int = 7,
) -> Model:
    """Maximum likelihood by AdaGrad over (text, language) samples."""
    labels = sorted({lang for _, lang in samples})
    spans = [(words_of(text)[1:-1] or words_of(text), labels.index(lang)) for text, lang in samples]
    counts: dict[int, Counter] = {k: Counter() for k in range(len(labels))}
    for words, label in spans:
        counts[label].update(words)
    lexicon = {w for c in counts.values() for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]}
    of_word = {w: word_features(w, lexicon) for c in counts.values() for w in c}
    seen = Counter(f for c in counts.values() for w in c for f in of_word[w])
    features = {f: k for k, f in enumerate(sorted(f for f, n in seen.items() if n >= MIN_COUNT))}
    of_word = {w: np.array([features[f] for f in fs if f in features], np.int64) for w, fs in of_word.items()}
    k = len(labels)
    weights, start, trans = np.zeros((len(features), k)), np.zeros(k), np.zeros((k, k))
    square_w, square_s, square_t = np.full(weights.shape, 1e-6), np.full(k, 1e-6), np.full((k, k), 1e-6)
    sequences = training_sequences(spans, seed)
    rng = np.random.default_rng(seed)
    for _ in range(epochs if k > 1 else 0):
        order = rng.permutation(len(sequences))
        for at in range(0, len(order), batch):
            part = sorted((sequences[i] for i in order[at : at + batch]), key=lambda s: -len(s[0]))
            words = [w for s, _ in part for w in s]
            gold = np.array([y for _, ys in part for y in ys])
            lengths = np.array([len(s) for s, _ in part])
            starts = np.cumsum(lengths) - lengths
            sizes = np.array([len(of_word[w]) for w in words])
            flat = np.concatenate([of_word[w] for w in words])
            owner = np.repeat(np.arange(len(words)), sizes)
            scores = np.zeros((len(words), k))
            np.add.at(scores, owner, weights[flat])
            marginals, forward, backward = forward_backward(scores, starts, lengths, start, trans)
            error = marginals.copy()
            error[np.arange(len(words)), gold] -= 1
            # expected minus observed transitions
            inner = np.ones(len(words), bool)
            inner[starts] = False
            here = np.flatnonzero(inner)
            psi = np.exp(scores[here] - scores[here].max(axis=1, keepdims=True)) * backward[here]
            joint = forward[here - 1][:, :, None] * np.exp(trans)[None] * psi[:, None, :]
            joint /= joint.sum(axis=(1, 2), keepdims=True)
            grad_t = joint.sum(axis=0)
            np.add.at(grad_t, (gold[here - 1], gold[here]), -1)
            grad_s = error[starts].sum(axis=0)
            touched, place = np.unique(flat, return_inverse=True)
            grad_w = np.zeros((len(touched), k))
            np.add.at(grad_w, place, error[owner])
            grad_w += decay * weights[touched]
            square_w[touched] += grad_w**2
            weights[touched] -= rate * grad_w / np.sqrt(square_w[touched])
            square_t += grad_t**2
            trans -= rate * grad_t / np.sqrt(square_t)
            square_s += grad_s**2
            start -= rate * grad_s / np.sqrt(square_s)
    return Model(labels, features, weights, start, trans, lexicon)


def learn(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    train_docs: int = TRAIN_DOCS,
    span_chars: int = SPAN_CHARS,
) -> Model:
    """Fit on at most ``train_docs`` of the given documents with text and language.

    A span of ``span_chars`` characters at a place that depends on the id stands for each.
    Without any such document the model knows no language and answers ``und``.
    """
    known = columns(docs, doc_id, text, lang).filter(
        F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull()
    )
    chosen = bounded_sample(known.select(doc_id), doc_id, train_docs).distinct()
    room = F.greatest(F.length(text) - F.lit(span_chars), F.lit(0)) + 1
    at = F.pmod(F.xxhash64(F.col(doc_id), F.lit(1)), room.cast("long")) + 1
    spans = known.join(F.broadcast(chosen), doc_id, "left_semi").select(
        doc_id,
        F.substring(F.col(text), at.cast("int"), F.lit(span_chars)).alias("span"),
        F.col(lang).cast("string").alias("lang"),
    )
    spans = bounded_sample(spans, doc_id, 2 * train_docs)
    rows = sorted(map(tuple, spans.collect()))
    return fit([(span, lang_) for _, span, lang_ in rows])


def predict(model: Model, text: str) -> Column:
    """Struct of language, score, words, switches and the share of each language."""

    @F.pandas_udf(PREDICTION)
    def label(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            parts = [model.predict(list(texts[at : at + 1000])) for at in range(0, len(texts), 1000)]
            yield pd.concat(parts, ignore_index=True) if parts else model.predict([])

    return label.asNondeterministic()(F.col(text))


def identify(
    docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per document: language, score from 0 to 1, words, switches, shares.

    Null texts and texts without a letter give ``und`` with score 0.  Equal shares go to the
    language that comes first in alphabetical order.  Repeated rows are labelled each.
    """
    found = columns(docs, doc_id, text).select(
        F.col(doc_id).alias("doc_id"), predict(model, text).alias("found")
    )
    return found.select(
        "doc_id",
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.words").alias("n_words"),
        F.col("found.switches").alias("n_switches"),
        F.col("found.shares").alias("shares"),
    )
