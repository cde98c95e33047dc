"""Removal of byte strings that an earlier document holds already, by distributed prefix doubling.

The rank of the string of 2h bytes at a position is the pair of ranks of h bytes there and h bytes on; a
last, overlapping pair reaches the wanted length (50 = 32 and 32 at offset 18).  A position whose rank is
unique leaves the search.  Ranks of up to 32 bytes are made inside a text; from there on they
are sent, packed, to the task of their range, sorted there across all texts and sent back:

1. Rank of 32 bytes at the anchors.  The anchor of a 50-byte string is its 32-byte string with the least
   hashed rank, so equal strings have equal anchors, and about one position in ten is one.  An anchor
   that stands in one document only ends all strings around it.
2. Pairs of ranks over the whole stretch of strings that share an anchor.  The smallest document of
   equal stretches is known then; the others lose the whole stretch.  A first holder is done if its
   anchor stands in no other kind of stretch.
3. Pairs (rank at p, rank at p + 18) of every 50-byte string in the stretches left over, mostly the ends
   of long repeats and short passages in many surroundings.

Texts are dealt once into packs of a few megabytes by hash, and stored in buckets of packs, so that no
round moves a text again.  A pack asks about each rank once, so a passage in a third of all documents is one
question per pack, and parts of the rank range are as many as the packs.  No pair of documents is formed.

Ranks are 64-bit names, and the strings of a round are compared by two or more of them, 128 bits or more.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from shelfledger.llm.common import columns, drop_table, shared_folder, write_table

LENGTH = 50
#: Bytes of text in a pack.
PACK_BYTES = 16_000_000
#: Spark's own limit on buckets; with more packs a bucket holds several.
MOST_BUCKETS = 100_000
#: Bytes that are ranked in one go.
BLOCK = 1 << 16

_LAST = np.iinfo(np.int64).max
_M = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_BYTES = np.random.default_rng(12).integers(0, 2**64, 256, dtype=np.uint64)

SPANS = "array<struct<start:bigint,length:bigint>>"


# --- ranks inside a text --------------------------------------------------------------------


def _gram(length: int) -> int:
    return 1 << (length.bit_length() - 1)


def _paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of the pair of names (a, b)."""
    name = a * _M[0]
    name += b
    name ^= name >> np.uint64(32)
    name *= _M[1]
    name ^= name >> np.uint64(29)
    return name


def ranks(data: np.ndarray, gram: int) -> np.ndarray:
    """Names of the strings of ``gram`` bytes (a power of two) along the last axis, by doubling."""
    names = _BYTES[data]
    step = 1
    while step < gram:
        names = _paired(names[..., :-step], names[..., step:])
        step *= 2
    return names


class Pack:
    """The texts of a pack in a fixed order, one after the other."""

    def __init__(self, docs: pa.Table):
        ids = docs.column("doc_id").to_pylist()
        texts = [(text or "").encode("utf-8") for text in docs.column("text").to_pylist()]
        order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, texts[k]))
        self.order = order
        self.ids = [ids[k] for k in order]
        self.texts = [texts[k] for k in order]
        #: Place of a document in the order of ids; those without an id come last.
        self.place = np.array([_LAST if i is None else i for i in self.ids], np.int64)
        sizes = np.array([len(text) for text in self.texts], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(sizes)])

    def blocks(self, length: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(offset, bytes, whether a string of ``length`` starts there); long texts come in pieces."""
        k, n = 0, len(self.texts)
        while k < n:
            size = len(self.texts[k])
            if size > BLOCK:
                for at in range(0, size - length + 1, BLOCK):
                    data = np.frombuffer(self.texts[k][at : at + BLOCK + length - 1], np.uint8)
                    inside = np.zeros(len(data), bool)
                    inside[: len(data) - length + 1] = True
                    yield int(self.starts[k]) + at, data, inside
                k += 1
                continue
            first = k
            while k < n and self.starts[k + 1] - self.starts[first] <= BLOCK:
                k += 1
            if k == first:
                k += 1
            offset = int(self.starts[first])
            data = np.frombuffer(b"".join(self.texts[first:k]), np.uint8)
            edges = np.zeros(len(data) + 1, np.int64)
            begins, ends = self.starts[first:k] - offset, self.starts[first + 1 : k + 1] - offset
            long = ends - begins >= length
            np.add.at(edges, begins[long], 1)
            np.add.at(edges, ends[long] - length + 1, -1)
            yield offset, data, np.cumsum(edges[:-1]) > 0

    def owner(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, at, "right") - 1


class Stretches:
    """All stretches of a pack: the strings of ``length`` bytes that share an anchor.

    ``lo``: where the first string starts; ``count``: strings in it; ``anchor``: name of the
    anchor; ``name``: two names of the whole stretch and the anchor's place in it.
    """

    def __init__(self, pack: Pack, length: int):
        gram = _gram(length)
        width = length - gram + 1
        parts: list[tuple[np.ndarray, ...]] = []
        for offset, data, inside in pack.blocks(length):
            if len(data) < length or not inside.any():
                continue
            names = ranks(data, gram)
            # Names without their last bits, then the place: the least one, the first among equals.
            low = np.uint64((1 << 18) - 1)
            keys = (names & ~low) | np.arange(len(names), dtype=np.uint64)
            have = 1
            while 2 * have <= width:
                keys = np.minimum(keys[:-have], keys[have:])
                have *= 2
            if have < width:
                keys = np.minimum(keys[: have - width], keys[width - have :])
            at = np.flatnonzero(inside)
            anchors = (keys[at] & low).astype(np.int64)
            heads = np.ones(len(at), bool)
            heads[1:] = (anchors[1:] != anchors[:-1]) | (at[1:] != at[:-1] + 1)
            first = np.flatnonzero(heads)
            count = np.diff(np.append(first, len(at)))
            lo, anchor = at[first], anchors[first]
            reach = count + length - 1 - gram  # from the first gram to the last
            steps = -(-(length + width - 1) // gram) - 1
            grams = [names[lo + reach * k // steps] for k in range(steps + 1)] if steps else [names[lo]]
            shape = (anchor - lo).astype(np.uint64) * _M[2] + count.astype(np.uint64)
            one, two = shape * _M[3], shape ^ _M[1]
            for each in grams:
                one, two = _paired(one, each), _paired(each ^ _M[3], two)
            parts.append((lo + offset, count, names[anchor], one, two))
        empty = [np.zeros(0, np.int64)] * 2 + [np.zeros(0, np.uint64)] * 3
        joined = [np.concatenate(c) for c in zip(*parts, strict=True)] if parts else empty
        self.lo, self.count, self.anchor, self.one, self.two = joined
        self.place = pack.place[pack.owner(self.lo)] if len(self.lo) else self.lo


def _strings(pack: Pack, lo: np.ndarray, count: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """(start, name, name, place) of every string of the given stretches."""
    gram = _gram(length)
    found: list[tuple[np.ndarray, ...]] = []
    data = np.frombuffer(b"".join(pack.texts), np.uint8)
    for at in range(0, len(lo), 4096):
        first, n = lo[at : at + 4096], count[at : at + 4096]
        cells = first[:, None] + np.arange(int(n.max()) + length - 1)
        names = ranks(data[np.minimum(cells, len(data) - 1)], gram)
        row = np.repeat(np.arange(len(first)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        found.append((first[row] + k, names[row, k], names[row, k + length - gram]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start, one, two = (np.concatenate(c) for c in zip(*found, strict=True))
    return start, one, two, pack.place[pack.owner(start)]


# --- questions about ranks ------------------------------------------------------------------

#: Rows between packs and parts of the rank range; ``kind`` says what the numbers are.
_ROWS = pa.schema(
    [
        ("pack", pa.int64()),
        ("part", pa.int64()),
        ("kind", pa.string()),
        ("a", pa.binary()),
        ("b", pa.binary()),
        ("c", pa.binary()),
    ]
)
_DDL = "pack bigint, part bigint, kind string, a binary, b binary, c binary"


class Question:
    """Distinct ranks of a pack with their least value, in order of rank."""

    def __init__(self, keys: tuple[np.ndarray, ...], values: np.ndarray):
        order = np.lexsort(keys[::-1])
        heads = np.ones(len(order), bool)
        if len(order):
            heads[1:] = np.any([key[order[1:]] != key[order[:-1]] for key in keys], axis=0)
        at = np.flatnonzero(heads)
        group = np.cumsum(heads) - 1
        self.inverse = np.empty(len(order), np.int64)
        self.inverse[order] = group
        self.keys = [key[order[at]] for key in keys]
        ordered = values[order]
        self.least = np.minimum.reduceat(ordered, at) if len(at) else ordered
        self.several = (np.maximum.reduceat(ordered, at) if len(at) else ordered) != self.least

    def parts(self, parts: int) -> Iterator[tuple[int, slice]]:
        """Each part of the range of ranks that has one, and where its ranks are."""
        if not len(self.keys[0]):
            return
        number = ((self.keys[0] >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        found, first = np.unique(number, return_index=True)
        for part, start, end in zip(found.tolist(), first, np.append(first[1:], len(number)), strict=True):
            yield part, slice(start, end)


def _told(answers: pa.Table, kind: str, dtype: type) -> np.ndarray:
    """All answers of a kind, in order of rank."""
    rows = [
        (part, a)
        for part, k, a in zip(*(answers.column(c).to_pylist() for c in ("part", "kind", "a")), strict=True)
        if k == kind
    ]
    return np.concatenate([np.frombuffer(a, dtype) for _, a in sorted(rows)] or [np.zeros(0, dtype)])


def _rows(rows: list[tuple]) -> pa.Table:
    columns_ = zip(*rows, strict=True) if rows else [[]] * len(_ROWS)
    return pa.table([pa.array(c, f.type) for c, f in zip(columns_, _ROWS, strict=True)], schema=_ROWS)


def _answers(table: pa.Table) -> pa.Table:
    """Answers to all questions about one part of the rank range; other rows pass."""
    rows = table.to_pylist()
    out = [tuple(row.values()) for row in rows if row["kind"].startswith("state")]
    for kind in sorted({row["kind"] for row in rows if not row["kind"].startswith("state")}):
        asked = [row for row in rows if row["kind"] == kind]
        one = [np.frombuffer(row["a"], np.uint32 if kind == "anchor" else np.uint64) for row in asked]
        sizes = [len(a) for a in one]
        keys = [np.concatenate(one)]
        if kind in ("stretch", "string"):
            keys.append(np.concatenate([np.frombuffer(row["b"], np.uint64) for row in asked]))
        if kind == "anchor":
            values = np.repeat(np.arange(len(asked)), sizes)
        else:
            values = np.concatenate([np.frombuffer(row["c"], np.int64) for row in asked])
        ranked = Question(tuple(keys), values)
        if kind in ("stretch", "string"):
            told = ranked.least[ranked.inverse]
        else:
            flags = np.concatenate([np.frombuffer(row["b"], bool) for row in asked])
            several = ranked.several
            several[ranked.inverse[flags]] = True
            told = several[ranked.inverse]
        ends = np.cumsum(sizes)
        for row, end, size in zip(asked, ends, sizes, strict=True):
            out.append((row["pack"], row["part"], kind, told[end - size : end].tobytes(), None, None))
    return _rows(out)


# --- rounds ---------------------------------------------------------------------------------


def _ask_anchors(docs: pa.Table, length: int, parts: int) -> pa.Table:
    pack = docs.column("pack")[0].as_py()
    found = Stretches(Pack(docs), length)
    asked = Question((found.anchor,), found.place)
    return _rows(
        [
            # The first bits of a rank say its part; the last 32 are enough for a filter.
            (pack, part, "anchor", asked.keys[0][at].astype(np.uint32).tobytes(), asked.several[at].tobytes(), None)
            for part, at in asked.parts(parts)
        ]
    )


def _ask_stretches(docs: pa.Table, answers: pa.Table, length: int, parts: int) -> pa.Table:
    number = docs.column("pack")[0].as_py()
    found = Stretches(Pack(docs), length)
    asked = Question((found.anchor,), found.place)
    left = _told(answers, "anchor", bool)[asked.inverse]
    rows = [(number, number % parts, "state", np.packbits(left).tobytes(), None, None)]
    whole = Question((found.one[left], found.two[left]), found.place[left])
    for part, at in whole.parts(parts):
        one, two = (key[at].tobytes() for key in whole.keys)
        rows.append((number, part, "stretch", one, two, whole.least[at].tobytes()))
    kinds = Question((found.anchor[left],), found.one[left].view(np.int64))
    for part, at in kinds.parts(parts):
        flags = kinds.several[at].tobytes()
        rows.append((number, part, "kinds", kinds.keys[0][at].tobytes(), flags, kinds.least[at].tobytes()))
    return _rows(rows)


def _ask_strings(docs: pa.Table, answers: pa.Table, length: int, parts: int) -> pa.Table:
    number = docs.column("pack")[0].as_py()
    pack = Pack(docs)
    found = Stretches(pack, length)
    left = np.unpackbits(_told(answers, "state", np.uint8), count=len(found.lo)).astype(bool)
    lo, count, place = found.lo[left], found.count[left], found.place[left]
    whole = Question((found.one[left], found.two[left]), place)
    kinds = Question((found.anchor[left],), place)
    gone = _told(answers, "stretch", np.int64)[whole.inverse] < place
    open_ = ~gone & _told(answers, "kinds", bool)[kinds.inverse]
    spans = _merged(lo[gone], lo[gone] + count[gone] + length - 1, pack)
    rows = [
        (number, number % parts, "state spans", spans.tobytes(), None, None),
        (number, number % parts, "state open", np.stack([lo[open_], count[open_]]).tobytes(), None, None),
    ]
    _, one, two, place = _strings(pack, lo[open_], count[open_], length)
    asked = Question((one, two), place)
    for part, at in asked.parts(parts):
        first, second = (key[at].tobytes() for key in asked.keys)
        rows.append((number, part, "string", first, second, asked.least[at].tobytes()))
    return _rows(rows)


def _merged(starts: np.ndarray, ends: np.ndarray, pack: Pack) -> np.ndarray:
    """(start, end) columns of the maximal stretches covered, none across two texts."""
    if not len(starts):
        return np.zeros((2, 0), np.int64)
    order = np.lexsort((ends, starts))
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    owner = pack.owner(starts)
    heads = np.ones(len(starts), bool)
    heads[1:] = (starts[1:] > ends[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(heads)
    return np.stack([starts[first], ends[np.append(first[1:], len(starts)) - 1]])


def _remove(docs: pa.Table, answers: pa.Table, length: int, schema: pa.Schema) -> pa.Table:
    pack = Pack(docs)
    known = _told(answers, "state spans", np.int64).reshape(2, -1)
    lo, count = _told(answers, "state open", np.int64).reshape(2, -1)
    start, one, two, place = _strings(pack, lo, count, length)
    asked = Question((one, two), place)
    gone = start[_told(answers, "string", np.int64)[asked.inverse] < place]
    spans = _merged(np.append(known[0], gone), np.append(known[1], gone + length), pack)
    owner = pack.owner(spans[0])
    first = np.searchsorted(owner, np.arange(len(pack.texts) + 1))
    removed, kept = [], []
    for k, text in enumerate(pack.texts):
        mine = (spans[:, first[k] : first[k + 1]] - pack.starts[k]).T.tolist()
        removed.append([{"start": a, "length": b - a} for a, b in mine])
        edges = [0, *(x for span in mine for x in span), len(text)]
        kept.append(b"".join(text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
    return pa.table(
        [
            docs.column("doc_id").take(pa.array(pack.order, pa.int64())).cast(schema.field(0).type),
            pa.array([len(text) for text in pack.texts], pa.int64()),
            pa.array(removed, schema.field(2).type),
            pa.array(kept, schema.field(3).type),
        ],
        schema=schema,
    )


def _round(asked: DataFrame) -> tuple[DataFrame, str]:
    """Sorts the ranks of each part across all packs and stores the answers."""
    return write_table(asked.groupBy("part").applyInArrow(_answers, _DDL))


def remove_repeats(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    length: int = LENGTH,
    pack_bytes: int = PACK_BYTES,
) -> DataFrame:
    """(doc_id, n_bytes, removed, kept) of every row: its UTF-8 bytes without what an earlier one holds.

    A byte goes if a string of ``length`` bytes over it also starts in a document with a smaller id;
    strings are judged on the input, and overlaps count.  ``removed`` are the maximal removed stretches, ``kept``
    the remaining bytes.  Ids are whole numbers; rows of one id are the same document, a row
    without an id comes after all others, and neither kind removes bytes of its own kind.  Null and empty texts have no
    bytes; texts shorter than ``length`` stay whole.  An empty table gives no rows; extra columns
    are left out.  The texts are copied once, in buckets, into the shared folder.
    """
    spark = docs.sparkSession
    rows = columns(docs, doc_id, text).toDF("doc_id", "text")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs = max(least, -(-int(total) // pack_bytes))
    buckets = min(packs, MOST_BUCKETS)
    name = f"packs_{uuid.uuid4().hex}"
    number = F.pmod(F.xxhash64("doc_id", "text"), F.lit(packs)).alias("pack")
    (
        rows.select(number, "doc_id", "text")
        .repartition(buckets, "pack")
        .write.bucketBy(buckets, "pack")
        .option("path", f"{shared_folder(spark).rstrip('/')}/{name}")
        .saveAsTable(name)
    )
    stored = spark.table(name).groupBy("pack")

    def ask(step: Callable, answers: DataFrame) -> DataFrame:
        step = partial(step, length=length, parts=packs)
        return stored.cogroup(answers.groupBy("pack")).applyInArrow(lambda d, a: step(d, a), _DDL)

    told, path = _round(stored.applyInArrow(lambda d: _ask_anchors(d, length, packs), _DDL))
    for step in (_ask_stretches, _ask_strings):
        before = path
        told, path = _round(ask(step, told))
        drop_table(spark, before)
    out = StructType(
        [rows.schema["doc_id"], *StructType.fromDDL(f"n_bytes bigint, removed {SPANS}, kept binary")]
    )
    schema = to_arrow_schema(out)
    return stored.cogroup(told.groupBy("pack")).applyInArrow(
        lambda d, a: _remove(d, a, length, schema), out
    )


def digests(found: DataFrame) -> DataFrame:
    """One row per document: bytes, removed bytes, removed stretches, digest of what is kept."""
    return found.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("bigint").alias("n_removed"),
        F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


# --- the same in SQL ------------------------------------------------------------------------


def oracle(length: int = LENGTH) -> str:
    """DuckDB SQL of the registered query: every string of every document as a row."""
    return f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS h,
    octet_length(encode(coalesce(text, ''))) AS n
  FROM documents
), chunks AS (
  SELECT rid, doc_id, n, c, substr(h, 2 * c + 1, 2 * (200 + {length})) AS part
  FROM (SELECT rid, doc_id, h, n, unnest(range(0, n, 200)) AS c FROM docs WHERE n >= {length})
), strings AS (
  SELECT rid, doc_id, c + k AS p, substr(part, 2 * k + 1, {2 * length}) AS s
  FROM (SELECT *, unnest(range(0, least(200, n - {length - 1} - c))) AS k FROM chunks)
), firsts AS (
  SELECT s, min(doc_id) AS first_id FROM strings GROUP BY s
), gone AS (
  SELECT rid, p FROM strings JOIN firsts USING (s)
  WHERE first_id < doc_id OR (doc_id IS NULL AND first_id IS NOT NULL)
), opened AS (
  SELECT rid, p, CASE WHEN p <= lag(p) OVER (PARTITION BY rid ORDER BY p) + {length} THEN 0 ELSE 1 END AS opens
  FROM gone
), spans AS (
  SELECT rid, min(p) AS a, max(p) + {length} AS b
  FROM (SELECT rid, p, sum(opens) OVER (PARTITION BY rid ORDER BY p) AS span FROM opened) GROUP BY rid, span
), pieces AS (
  SELECT rid, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS a, a AS b FROM spans
  UNION ALL
  SELECT rid, max(b), n FROM spans JOIN docs USING (rid) GROUP BY rid, n
), kept AS (
  SELECT rid, string_agg(substr(h, 2 * p.a + 1, 2 * (p.b - p.a)), '' ORDER BY p.a) AS left_over
  FROM pieces AS p JOIN docs USING (rid) GROUP BY rid
), removed AS (
  SELECT rid, sum(b - a) AS bytes, count(*) AS spans FROM spans GROUP BY rid
)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(bytes, 0)::BIGINT AS n_removed,
  coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(left_over, h))) AS kept_sha256
FROM docs LEFT JOIN removed USING (rid) LEFT JOIN kept USING (rid)
"""
