"""Periodic runs of words, found by a sparse diagonal recurrence.

A run is a stretch of consecutive words with smallest period q that is at least 24 words and at
least three periods long and that no neighbouring word extends.  Words q apart are equal inside it, so
it is a diagonal of lag q of the text against itself, with at least 2q and at least 16 matches.

The recurrence goes over the text word by word.  Earlier occurrences of what stands at a word
increment the match lengths of their lags; a lag that is not incremented has ended, and its diagonal is
emitted at once if it is long enough.  Two facts keep the recurrence sparse and lose no run:

* Lags from B to 1.5 B need 2 B equal words in a row, so occurrences of 2 B-word grams (exact ranks by
  doubling, 16 words for all lags below 12) are looked up in place of single words.
* Two lags that add up to at most the gram's length have a common divisor that is a period as well, so
  the larger one is no smallest period there.  At most three occurrences of a gram are
  left for each word and range of lags, even in a text of one repeated word.

The work is O(n log^2 n) for a text of n words; whole texts are searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfledger.llm.common import columns

#: A run has at least so many words and so many periods.  The search relies on both values.
MIN_WORDS = 24
MIN_PERIODS = 3
#: Every diagonal of a run has at least so many matches.
GRAM = 16
#: Characters of text that one pass of the batch filter takes.
BATCH_CHARS = 4_000_000

Run = tuple[int, int, int]
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


# --- one text -------------------------------------------------------------------------------


class _Ranks:
    """Exact ranks of the grams of a text: equal numbers stand for equal grams."""

    def __init__(self, ids: np.ndarray):
        self.powers = [ids]

    def of(self, length: int) -> np.ndarray:
        """Rank of the gram of ``length`` words at every place that has one."""
        level = length.bit_length() - 1
        while len(self.powers) <= level:
            step = 1 << (len(self.powers) - 1)
            self.powers.append(self._paired(self.powers[-1], step))
        rest = length - (1 << level)
        return self._paired(self.powers[level], rest) if rest else self.powers[level]

    @staticmethod
    def _paired(ranks: np.ndarray, step: int) -> np.ndarray:
        """Ranks of the pairs (rank at i, rank at i + step)."""
        pairs = ranks[:-step] * (int(ranks.max()) + 1) + ranks[step:]
        return np.unique(pairs, return_inverse=True)[1].astype(np.int64)


def _matches(ranks: np.ndarray, low: int, high: int, gram: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """(word, lag) of equal grams with low <= lag < high that may belong to a smallest period.

    Also whether any gram occurs twice at all.
    """
    order = np.argsort(ranks, kind="stable")
    sorted_ranks = ranks[order]
    repeated = bool((sorted_ranks[1:] == sorted_ranks[:-1]).any())
    at = np.arange(len(order))
    least = np.full(len(order), gram, np.int64)  # smallest distance of two occurrences so far
    words, lags = [], []
    back = 0
    while at.size:
        back += 1
        at = at[at >= back]
        at = at[sorted_ranks[at] == sorted_ranks[at - back]]
        lag = order[at] - order[at - back]
        at, lag = at[lag < high], lag[lag < high]
        known = least[at]
        least[at] = np.minimum(known, order[at - back + 1] - order[at - back])
        # A smaller distance is a period too; both together must not fit into the gram.
        good = (lag >= low) & ((lag + known > gram) | (known >= lag))
        words.append(order[at[good]])
        lags.append(lag[good])
        at = at[least[at] + high - 1 > gram]
    if not words:
        return at, at, repeated
    return np.concatenate(words), np.concatenate(lags), repeated


def _primitive(ids: np.ndarray, start: int, period: int) -> bool:
    """Whether the first period is no power of a shorter word."""
    rest, factor = period, 2
    while rest > 1:
        if factor * factor > rest:
            factor = rest
        if rest % factor == 0:
            d = period // factor
            if np.array_equal(ids[start : start + period], ids[start + d : start + d + period]):
                return False
            while rest % factor == 0:
                rest //= factor
        factor += 1
    return True


def _diagonals(words: np.ndarray, lags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(lag, last word, matches) of every diagonal, emitted when it ends."""
    order = np.lexsort((lags, words))
    active: dict[int, int] = {}
    now: dict[int, int] = {}
    last = -1
    for i, lag in zip(words[order].tolist(), lags[order].tolist(), strict=True):
        if i != last:
            yield from ((q, last - 1, n) for q, n in active.items() if q not in now)
            if i != last + 1:
                yield from ((q, last, n) for q, n in now.items())
                now = {}
            active, now, last = now, {}, i
        now[lag] = active.get(lag, 0) + 1
    yield from ((q, last - 1, n) for q, n in active.items() if q not in now)
    yield from ((q, last, n) for q, n in now.items())


def runs_of(words: list) -> list[Run]:
    """All runs (start, length, period) of a text's words, by start, then period."""
    n = len(words)
    if n < MIN_WORDS:
        return []
    seen: dict = {}
    ids = np.array([seen.setdefault(word, len(seen)) for word in words], np.int64)
    ranks = _Ranks(ids)
    found: list[Run] = []
    low, high, gram = 1, 8, GRAM
    while low * MIN_PERIODS <= n and gram < n:
        at, lags, repeated = _matches(ranks.of(gram), low, high, gram)
        for lag, last, matches in _diagonals(at, lags):
            start = last - matches + 1 - lag
            length = last + gram - start
            if length >= max(MIN_WORDS, MIN_PERIODS * lag) and _primitive(ids, start, lag):
                found.append((start, length, lag))
        if not repeated:
            break
        low, high = high, high * 3 // 2
        gram = 2 * low
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapsed(words: list, runs: list[Run]) -> list:
    """The words that stand in no run after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep)]


# --- batches --------------------------------------------------------------------------------


def _maybe_periodic(texts: list[list[bytes]]) -> list[bool]:
    """Whether a text has a gram twice within a third of its length; others have no run."""
    sizes = np.array([len(words) for words in texts])
    total = int(sizes.sum())
    if total < GRAM:
        return [False] * len(texts)
    owner = np.repeat(np.arange(len(texts)), sizes)
    names = np.fromiter((hash(w) for words in texts for w in words), np.int64, total).view(np.uint64)
    names = names + owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    step = 1
    while step < GRAM:
        names = (names[:-step] ^ (names[step:] * np.uint64(0xD6E8FEB86659FD93))) * np.uint64(0xFF51AFD7ED558CCD)
        names ^= names >> np.uint64(32)
        step *= 2
    order = np.argsort(names, kind="stable")
    same = names[order[1:]] == names[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    near = (owner[a] == owner[b]) & (MIN_PERIODS * (b - a) <= sizes[owner[a]])
    flags = np.zeros(len(texts), bool)
    flags[owner[a[near]]] = True
    return flags.tolist()


def _search(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at = 0
        sizes = np.cumsum([len(text) if text is not None else 0 for text in batch.column(1).to_pylist()])
        while at < batch.num_rows:
            before = sizes[at - 1] if at else 0
            end = max(at + 1, int(np.searchsorted(sizes, before + BATCH_CHARS, "right")))
            part = batch.slice(at, end - at)
            texts = [(text or "").encode("utf-8").split() for text in part.column(1).to_pylist()]
            runs, kept = [], []
            for words, maybe in zip(texts, _maybe_periodic(texts), strict=True):
                found = runs_of(words) if maybe else []
                runs.append([{"start": s, "length": n, "period": q} for s, n, q in found])
                kept.append(b" ".join(collapsed(words, found)).decode("utf-8"))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0).cast(schema.field(0).type),
                    pa.array([len(words) for words in texts], pa.int64()),
                    pa.array(runs, schema.field(2).type),
                    pa.array(kept, schema.field(3).type),
                ],
                schema=schema,
            )
            at = end


def periodic_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row.

    ``runs`` are in order of start, then period; ``collapsed`` is the text without what its runs repeat,
    words joined by one space.  Null, empty and blank texts have no words, no runs and an
    empty ``collapsed``.  Overlapping runs are all reported; a word dropped by any of them is dropped.
    Repeated rows and null ids stay; an empty table gives no rows; extra columns are left out.  Long
    texts are searched whole, in the memory of their task.
    """
    rows = columns(docs, doc_id, text).toDF("doc_id", "text")
    more = StructType.fromDDL(f"n_words bigint, runs {RUNS}, collapsed string")
    out = StructType([rows.schema["doc_id"], *more])
    schema = to_arrow_schema(out)
    return rows.mapInArrow(lambda batches: _search(batches, schema), out)


# --- report ---------------------------------------------------------------------------------


def strongest(runs: Column) -> Column:
    """The run with the greatest exact length / period, the first one among equals; null without runs."""
    return F.aggregate(
        runs,
        F.get(runs, F.lit(0)),
        lambda best, run: F.when(
            run["length"] * best["period"] > best["length"] * run["period"], run
        ).otherwise(best),
    )


def digests(found: DataFrame) -> DataFrame:
    """One row per text: number of runs, the strongest run, digests of all runs and of the kept words."""
    lines = F.transform(
        "runs",
        lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")),
    )
    best = found.withColumn("best", strongest(F.col("runs")))
    return best.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text) in which about every tenth text repeats a stretch of its words to its end.

    With h = crc32 of the decimal id and g = h div 10: if h mod 10 = 0 and the text has n > 0 words, each
    word i >= a becomes word a + (i - a) mod p, where a = g mod n and p = 1 + (n - a) div (3 + g mod 8).
    A row without an id keeps its text.
    """
    rows = columns(docs, doc_id, text).toDF("doc_id", "text")
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda word: word != "")
    rows = rows.withColumn("h", h).withColumn("words", F.when(F.col("h") % 10 == 0, words))
    rows = rows.selectExpr(
        "doc_id", "text", "words", "h div 10 as g", "nullif(size(words), 0) as n"
    ).selectExpr("*", "cast(g % n as int) as a").selectExpr(
        "*", "cast(1 + (n - a) div (3 + g % 8) as int) as p"
    )
    cycle = "flatten(array_repeat(slice(words, a + 1, p), cast(ceil((n - a) / p) as int)))"
    changed = F.expr(f"array_join(concat(slice(words, 1, a), slice({cycle}, 1, n - a)), ' ')")
    return rows.select(
        "doc_id", F.when(F.col("n") > 0, changed).otherwise(F.col("text")).alias("text")
    )


# --- the same in SQL ------------------------------------------------------------------------


def oracle() -> str:
    """DuckDB SQL of the registered query: equal words of a text are joined, whatever their distance."""
    crc = """list_reduce(
      list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split(CAST(doc_id AS VARCHAR), ''),
        lambda c: [256 + ord(c), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]))),
      lambda crc, x: CASE WHEN x >= 256 THEN xor(crc, x - 256)
        WHEN crc & 1 = 1 THEN xor(crc >> 1, 3988292384::BIGINT) ELSE crc >> 1 END)"""
    return f"""
WITH base AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, xor({crc}, 4294967295::BIGINT) AS h,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS original
  FROM documents
), planned AS (
  SELECT *, len(original) AS n, coalesce(h % 10 = 0 AND len(original) > 0, false) AS planted,
    CASE WHEN len(original) > 0 THEN (h // 10) % len(original) END AS a FROM base
), shaped AS (
  SELECT *, 1 + (n - a) // (3 + (h // 10) % 8) AS p FROM planned
), words AS MATERIALIZED (
  SELECT rid, n, i, original[1 + CASE WHEN planted AND i >= a THEN a + (i - a) % p ELSE i END] AS w
  FROM (SELECT *, unnest(range(0, n)) AS i FROM shaped)
), pairs AS (
  SELECT y.rid, y.i, y.i - x.i AS q
  FROM words AS x JOIN words AS y ON x.rid = y.rid AND x.w = y.w AND x.i < y.i
  WHERE {MIN_PERIODS} * (y.i - x.i) <= y.n
), diagonals AS MATERIALIZED (
  SELECT rid, q, min(i) AS low, max(i) AS high
  FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM pairs)
  GROUP BY rid, q, island
), long_ones AS (
  SELECT rid, q AS period, low - q AS start, high - low + 1 + q AS length FROM diagonals
  WHERE high - low + 1 + q >= greatest({MIN_WORDS}, {MIN_PERIODS} * q)
), runs AS MATERIALIZED (
  SELECT * FROM long_ones AS r
  WHERE NOT EXISTS (SELECT 1 FROM diagonals AS d WHERE d.rid = r.rid AND d.q < r.period AND r.period % d.q = 0
    AND d.low <= r.start + d.q AND d.high >= r.start + r.length - 1)
), listed AS (
  SELECT rid, count(*) AS n_runs,
    string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY rid
), best AS (
  SELECT * FROM runs AS r WHERE NOT EXISTS (SELECT 1 FROM runs AS o WHERE o.rid = r.rid AND (
    o.length * r.period > r.length * o.period OR (o.length * r.period = r.length * o.period
      AND (o.start, o.period) < (r.start, r.period))))
), kept AS (
  SELECT rid, string_agg(w, ' ' ORDER BY i) AS text
  FROM words AS x WHERE NOT EXISTS (SELECT 1 FROM runs AS r WHERE r.rid = x.rid
    AND x.i >= r.start + r.period AND x.i < r.start + r.length) GROUP BY rid
)
SELECT doc_id, coalesce(n_runs, 0)::BIGINT AS n_runs, start::BIGINT AS start, length::BIGINT AS length,
  period::BIGINT AS period, (1000 * length // period)::BIGINT AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM base LEFT JOIN listed USING (rid) LEFT JOIN best USING (rid) LEFT JOIN kept USING (rid)
"""
