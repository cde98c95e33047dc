"""Benchmark decontamination by greedy string tiling.

Benchmark items are the stated query set, indexed by the rolling (Karp-Rabin) hashes
of their token windows.  A document joins the index through the windows it shares; for each
item it meets, the longest unmarked common run of tokens is marked again and
again until none of ``min_match`` tokens is left.  Tiles may lie anywhere in the document, so
reordered passages count in full.  A pair is reported if its tiles cover enough of the item.

Documents are never shuffled.  The index of a block of items is bounded
(``block_chars``); a larger benchmark is taken block by block, each against all documents.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfledger.llm.common import columns, written

MIN_MATCH = 5
COVERAGE = 0.8
#: Characters of benchmark text in one broadcast index.
BLOCK_CHARS = 16_000_000
#: Pairs of places that are looked at together.
PAIRS = 1_000_000

_TOKEN = re.compile(r"\w+")
_BASE = 0x9E3779B97F4A7C15 | 1

HITS = (
    "array<struct<item_id:bigint,coverage:double,matched_tokens:int,item_tokens:int,"
    "tiles:int,longest_tile:int>>"
)


def tokens_of(text: str | None) -> list[str]:
    return _TOKEN.findall((text or "").lower())


def window_hashes(ids: np.ndarray, size: int) -> np.ndarray:
    """Karp-Rabin hash, modulo 2**64, of every window of ``size`` tokens."""
    count = len(ids) - size + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    values = ids.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    values ^= values >> np.uint64(32)
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total = total * np.uint64(_BASE) + values[k : k + count]
    return total


class ItemIndex:
    """Windows of one block of benchmark items, sorted by hash."""

    def __init__(self, items: list[tuple[int | None, str]], min_match: int):
        self.min_match = min_match
        self.vocabulary: dict[str, int] = {}
        self.item_ids: list[int | None] = []
        self.items: list[np.ndarray] = []
        hashes, owners, places = [], [], []
        for item_id, text in items:
            words = tokens_of(text)
            if len(words) < min_match:
                continue
            ids = np.array(
                [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], np.int64
            )
            h = window_hashes(ids, min_match)
            hashes.append(h)
            owners.append(np.full(len(h), len(self.items)))
            places.append(np.arange(len(h)))
            self.item_ids.append(item_id)
            self.items.append(ids)
        joined = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        owner = np.concatenate(owners) if owners else np.empty(0, np.int64)
        place = np.concatenate(places) if places else np.empty(0, np.int64)
        self.starts = np.concatenate([[0], np.cumsum([len(item) for item in self.items], dtype=np.int64)])
        self.tokens = np.concatenate(self.items) if self.items else np.empty(0, np.int64)
        before = np.where(place > 0, self.tokens[self.starts[owner] + np.maximum(place, 1) - 1], 0) if len(place) else place
        self.hashes, which = np.unique(joined, return_inverse=True)
        # Windows by hash, then by the token before them: 0 at the beginning of an item.
        self.step = len(self.vocabulary) + 2
        keys = which.astype(np.int64) * self.step + before
        order = np.lexsort((place, owner, keys))
        self.keys, self.owners, self.places = keys[order], owner[order], place[order]

    def matches(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(item, place in item, place in document, tokens) of the maximal common runs, some at a time.

        A run begins where the tokens before two shared windows differ.  Windows with an equal token before
        them are left out by range, so a text of one repeated word costs a few runs per token, not
        all pairs of its windows; every run is confirmed token by token.
        """
        size = self.min_match
        known = np.concatenate([[0], np.cumsum(ids > 0)])
        full = np.flatnonzero(known[size:] - known[:-size] == size)
        h = window_hashes(ids, size)[full]
        which = np.searchsorted(self.hashes, h)
        found = which < len(self.hashes)
        found[found] = self.hashes[which[found]] == h[found]
        full, which = full[found], which[found].astype(np.int64)
        # No token stands before the first one, and an unknown token differs from all: nothing is left out.
        before = np.where(full > 0, ids[full - 1], 0)
        own = np.where(before > 0, before, self.step - 1) + which * self.step
        low, high = (np.searchsorted(self.keys, (which + k) * self.step) for k in (0, 1))
        left, right = np.searchsorted(self.keys, own, "left"), np.searchsorted(self.keys, own, "right")
        counts = (left - low) + (high - right)
        ends = np.cumsum(counts)
        at = 0
        while at < len(full):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
            n = counts[at:end]
            each = np.repeat(np.arange(at, end), n)
            k = np.arange(len(each)) - np.repeat(np.cumsum(n) - n, n)
            first = left[each] - low[each]
            k = np.where(k < first, low[each] + k, right[each] + k - first)
            owner, place, doc = self.owners[k], self.places[k], full[each]
            yield owner, place, doc, self._lengths(owner, place, doc, ids)
            at = end

    def _lengths(
        self, owner: np.ndarray, place: np.ndarray, doc: np.ndarray, ids: np.ndarray
    ) -> np.ndarray:
        """Equal tokens from two places on."""
        p, d, last = self.starts[owner] + place, doc.copy(), self.starts[owner + 1]
        lengths = np.zeros(len(p), np.int64)
        going = np.arange(len(p))
        while going.size:
            inside = (p[going] < last[going]) & (d[going] < len(ids))
            going = going[inside]
            going = going[self.tokens[p[going]] == ids[d[going]]]
            lengths[going] += 1
            p[going] += 1
            d[going] += 1
        return lengths

    def hits(self, text: str | None, coverage: float) -> list[dict]:
        words = tokens_of(text)
        if len(words) < self.min_match or not self.items:
            return []
        ids = np.fromiter(map(self.vocabulary.get, words, [0] * len(words)), np.int64, len(words))
        runs = [
            tuple(column[lengths >= self.min_match] for column in (owner, place, doc, lengths))
            for owner, place, doc, lengths in self.matches(ids)
        ]
        if not runs:
            return []
        owners, places, at, lengths = (np.concatenate(c) for c in zip(*runs, strict=True))
        order = np.argsort(owners, kind="stable")
        found, first = np.unique(owners[order], return_index=True)
        out = []
        for item, mine in zip(found.tolist(), np.split(order, first[1:]), strict=True):
            size = len(self.items[item])
            edges = np.zeros(size + 1, np.int64)
            np.add.at(edges, places[mine], 1)
            np.add.at(edges, places[mine] + lengths[mine], -1)
            if (np.cumsum(edges[:-1]) > 0).sum() < coverage * size:
                continue
            tiles = tile(size, len(ids), places[mine], at[mine], lengths[mine], self.min_match)
            matched = sum(length for _, _, length in tiles)
            if matched >= coverage * size and tiles:
                out.append(
                    {
                        "item_id": self.item_ids[item],
                        "coverage": matched / size,
                        "matched_tokens": matched,
                        "item_tokens": size,
                        "tiles": len(tiles),
                        "longest_tile": max(length for _, _, length in tiles),
                    }
                )
        return out


def tile(
    item_size: int, doc_size: int, places: np.ndarray, at: np.ndarray, lengths: np.ndarray, size: int
) -> list[tuple[int, int, int]]:
    """Greedy tiling: (place in item, place in document, tokens), longest first.

    The input are the maximal common runs.  Ties go to the earliest place in the item, then in the document.
    """
    queue = [(-n, p, d) for n, p, d in zip(lengths.tolist(), places.tolist(), at.tolist(), strict=True)]
    heapq.heapify(queue)
    in_item, in_doc = np.zeros(item_size, bool), np.zeros(doc_size, bool)
    tiles: list[tuple[int, int, int]] = []
    room = item_size  # longest run of the item that no tile covers
    while queue and room >= size:
        n, p, d = heapq.heappop(queue)
        taken = in_item[p : p - n] | in_doc[d : d - n]
        if not taken.any():
            in_item[p : p - n] = True
            in_doc[d : d - n] = True
            tiles.append((p, d, -n))
            room = max((b - a for a, b in _free(in_item)), default=0)
            continue
        for a, b in _free(taken):
            if b - a >= size:
                heapq.heappush(queue, (a - b, p + a, d + a))
    return tiles


def _free(taken: np.ndarray) -> list[tuple[int, int]]:
    """Stretches (start, end) that are not taken."""
    edges = np.flatnonzero(np.diff(np.concatenate([[True], taken, [True]]).astype(np.int8)))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def hits_in(text: str, index: ItemIndex, coverage: float) -> Column:
    """Array of the items that ``text`` holds."""

    @F.pandas_udf(HITS)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([index.hits(t, coverage) for t in texts])

    return find.asNondeterministic()(F.col(text))


def item_blocks(
    benchmark: DataFrame, item_id: str, text: str, block_chars: int
) -> Iterator[list[tuple[int | None, str]]]:
    """The items in blocks whose text is bounded in size."""
    items = columns(benchmark, item_id, text).filter(F.col(text).isNotNull()).distinct()
    size = items.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = 1 + int(size // block_chars)
    for block in range(blocks):
        part = items
        if blocks > 1:
            part = items.filter(F.pmod(F.xxhash64(item_id, text), F.lit(blocks)) == block)
        yield sorted((tuple(r) for r in part.collect()), key=repr)


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """One row per document and benchmark item that it holds.

    Tokens are runs of word characters, in lower case.  An item with fewer than ``min_match``
    tokens matches nothing.  Null and empty texts hold nothing.  Repeated documents are
    reported each; repeated items once.  A null id stays null in the result.  Texts of any length are
    searched whole; an empty table gives no rows; other columns of both tables are left out.
    """
    out = None
    for items in item_blocks(benchmark, item_id, item_text, block_chars):
        if out is not None:
            out = written(out)  # one index in memory at a time
        index = ItemIndex(items, min_match)
        found = columns(docs, doc_id, text).select(
            F.col(doc_id).alias("doc_id"), F.explode(hits_in(text, index, coverage)).alias("hit")
        )
        found = found.select("doc_id", "hit.*")
        out = found if out is None else out.unionByName(found)
    return out


def clean_documents(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    min_match: int = MIN_MATCH,
    coverage: float = COVERAGE,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns.

    Rows are judged each, repeated ones alike; null and empty texts are kept.  An empty benchmark keeps
    all rows.  With several blocks of items, what one block leaves is written before the next one.
    """
    first = True
    for items in item_blocks(benchmark, item_id, item_text, block_chars):
        if not first:
            docs = written(docs)  # one index in memory at a time
        index = ItemIndex(items, min_match)
        kept = docs.select("*", hits_in(text, index, coverage).alias("__hits"))
        docs = kept.filter(F.size("__hits") == 0).drop("__hits")
        first = False
    return docs
