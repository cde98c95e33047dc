"""Near duplicates by 64-bit similarity fingerprints and a Gray-order hierarchical index.

Texts within three differing fingerprint bits are linked.  The index has two parts:

* Upper nodes are masked bit patterns.  Two fingerprints with at most three
  differing bits agree on one of four bit blocks, so each distinct fingerprint
  stands under the node of each of its four block values, and only fingerprints
  below the same node are compared.  A node with too many fingerprints is factored
  again by four blocks of its remaining bits, as deep as three levels.  Nodes are the
  shuffle key, so no task sees the whole corpus.
* Below a node, fingerprints are sorted by Gray rank, so neighbours share most
  bits.  Runs of neighbours form inner nodes holding the bits that all members share.
  A pair of nodes is dropped when the differences accumulated on shared bits exceed the
  limit, and joined as a whole when no free bit can exceed it.

Each task returns a spanning forest of the links it finds, at most one row per
fingerprint and node, never all pairs of a group.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from shelfledger.llm.common import columns, drop_table, write_table, written

SHINGLE_WORDS = 3
MAX_BITS = 3
#: A node with more fingerprints than this is factored by further bits.
NODE_LIMIT = 2048
#: Fan-out of the inner nodes over Gray-sorted fingerprints.
FAN_OUT = 16
#: Widths of the blocks at each level: four blocks of each.
BLOCK_BITS = (16, 12, 9)


# --- fingerprints ---------------------------------------------------------------------------


def fingerprint_of(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit fingerprint of one whole text; zero if it has no word."""
    words = (text or "").encode("utf-8").lower().split()
    if not words:
        return 0
    if len(words) < shingle_words:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[k:] for k in range(shingle_words)), strict=False)))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 8192):
        part = shingles[at : at + 8192]
        hashes = np.array([xxhash.xxh64_intdigest(s, 42) for s in part], dtype=">u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    majority = np.packbits(2 * ones > len(shingles))
    return int.from_bytes(majority.tobytes(), "big", signed=True)


@F.pandas_udf(LongType())
def _fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield pd.Series([fingerprint_of(text) for text in texts], dtype="int64")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, bits) of every row.

    Null and empty texts, and texts of white space only, have fingerprint zero.
    """
    return columns(docs, doc_id, text).select(
        F.col(doc_id).alias("doc_id"), _fingerprint.asNondeterministic()(F.col(text)).alias("bits")
    )


# --- index ----------------------------------------------------------------------------------


def _block(bits: Column, total: int, at: int, width: int) -> tuple[Column, Column]:
    """Value of ``width`` bits at ``at`` of a ``total``-bit number, and the number without them."""
    value = F.shiftrightunsigned(bits, at).bitwiseAND(F.lit((1 << width) - 1))
    rest = bits.bitwiseAND(F.lit((1 << at) - 1))
    if at + width < total:
        above = F.shiftrightunsigned(bits, at + width)
        rest = rest.bitwiseOR(F.shiftleft(above, at))
    return value, rest


def _factor(node: Column, rest: Column, total: int, width: int) -> Column:
    """Array of the four nodes below ``node``, each with the bits it leaves open.

    The root is 1, so that numbers of different levels never meet.
    """
    below = []
    for k in range(4):
        value, left = _block(rest, total, k * width, width)
        key = node * F.lit(4 << width) + F.lit(k << width) + value
        below.append(F.struct(key.alias("node"), left.alias("rest")))
    return F.array(*below)


def upper_nodes(distinct: DataFrame, node_limit: int = NODE_LIMIT) -> DataFrame:
    """(node, bits): each distinct fingerprint below its masked bit patterns."""
    total = 64
    rows = distinct.select("bits", F.lit(1).cast("long").alias("node"), F.col("bits").alias("rest"))
    for level, width in enumerate(BLOCK_BITS):
        split = _factor(F.col("node"), F.col("rest"), total, width)
        if level:
            crowded = rows.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
            crowded = crowded.filter(F.col("n") > node_limit).select(
                "node", F.lit(True).alias("crowded")
            )
            rows = rows.join(crowded, "node", "left")
            keep = F.array(F.struct("node", "rest"))
            split = F.when(F.col("crowded"), split).otherwise(keep)
        rows = rows.select("bits", F.explode(split).alias("below"))
        rows = rows.select("bits", "below.node", "below.rest")
        total -= width
    return rows.select("node", "bits")


def gray_rank(bits: Column) -> Column:
    """Place of ``bits`` in the Gray code order, as a number that sorts as unsigned."""
    rank = bits
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(2**63)))


def _find(parent: np.ndarray, at: np.ndarray) -> np.ndarray:
    roots = parent[at]
    while True:
        above = parent[roots]
        if np.array_equal(above, roots):
            return roots
        roots = above


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while a.size:
        ra, rb = _find(parent, a), _find(parent, b)
        open_ = ra != rb
        a, b, ra, rb = a[open_], b[open_], ra[open_], rb[open_]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))


class _Level:
    """Nodes over runs of entries: their bounds, shared bits and the values of these."""

    def __init__(self, bits: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray):
        self.starts, self.ends, self.first = starts, ends, first
        low = np.bitwise_and.reduceat(bits, starts)
        high = np.bitwise_or.reduceat(bits, starts)
        self.mask, self.value = ~(low ^ high), low


def _levels(groups: np.ndarray, bits: np.ndarray) -> list[_Level]:
    """Single entries, then runs of up to FAN_OUT nodes of a group, until each group has one."""
    n = len(bits)
    at = np.arange(n)
    levels = [_Level(bits, at, at + 1, at)]
    owner = groups
    while True:
        count = len(owner)
        new = np.ones(count, bool)
        new[1:] = owner[1:] != owner[:-1]
        heads = np.flatnonzero(new)
        if len(heads) == count:
            return levels
        offset = np.arange(count) - np.repeat(heads, np.diff(np.append(heads, count)))
        first = np.flatnonzero(offset % FAN_OUT == 0)
        below = levels[-1]
        starts = below.starts[first]
        levels.append(_Level(bits, starts, np.append(starts[1:], n), np.append(first, count)))
        owner = owner[first]


def spanning_links(groups: np.ndarray, bits: np.ndarray, most: int = MAX_BITS) -> np.ndarray:
    """For entries sorted by group and Gray rank: the index of each entry's representative.

    Two entries get the same one if a chain of links inside their group joins them.
    """
    n = len(bits)
    parent = np.arange(n)
    if n < 2:
        return parent
    bits = bits.view(np.uint64)
    levels = _levels(groups, bits)
    top = len(levels) - 1
    roots = np.arange(len(levels[top].starts))
    many = levels[top].ends - levels[top].starts > 1
    stack = [(top, roots[many], roots[many])]
    while stack:
        depth, i, j = stack.pop()
        level = levels[depth]
        shared = level.mask[i] & level.mask[j]
        least = np.bitwise_count((level.value[i] ^ level.value[j]) & shared).astype(np.int64)
        near = least <= most
        i, j, shared, least = i[near], j[near], shared[near], least[near]
        whole = least + np.bitwise_count(~shared) <= most
        if whole.any():
            a, b = i[whole], j[whole]
            if depth:
                for x in (a, b):  # all members differ in few bits: link neighbours
                    sizes = level.ends[x] - level.starts[x]
                    inner = np.repeat(level.starts[x], sizes - 1) + _counting(sizes - 1)
                    _unite(parent, inner, inner + 1)
            _unite(parent, level.starts[a], level.starts[b])
        i, j = i[~whole], j[~whole]
        if not depth or not i.size:
            continue
        if i.size > 256:  # skip nodes that are in one component already
            label = _find(parent, np.arange(n))
            low = np.minimum.reduceat(label, level.starts)
            one = low == np.maximum.reduceat(label, level.starts)
            done = one[i] & one[j] & (low[i] == low[j])
            i, j = i[~done], j[~done]
        for at in range(0, i.size, 4096):
            a, b = i[at : at + 4096], j[at : at + 4096]
            na, nb = level.first[a + 1] - level.first[a], level.first[b + 1] - level.first[b]
            pair = _counting(na * nb)
            each = np.repeat(np.arange(len(a)), na * nb)
            x = level.first[a][each] + pair // nb[each]
            y = level.first[b][each] + pair % nb[each]
            same = (a == b)[each]
            ok = ~same | (x < y if depth == 1 else x <= y)
            stack.append((depth - 1, x[ok], y[ok]))
    return _find(parent, np.arange(n))


def _counting(sizes: np.ndarray) -> np.ndarray:
    """0..size-1 for each size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


def _links_of(nodes: np.ndarray, bits: np.ndarray) -> pa.RecordBatch:
    roots = spanning_links(nodes, bits)
    linked = np.flatnonzero(roots != np.arange(len(roots)))
    return pa.RecordBatch.from_arrays(
        [pa.array(bits[roots[linked]]), pa.array(bits[linked])], names=["a", "b"]
    )


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups arrive sorted; a group that may go on in the next batch waits for it."""
    nodes, bits = np.empty(0, np.int64), np.empty(0, np.int64)
    kept: list[tuple[np.ndarray, np.ndarray]] = []
    waiting = 0
    for batch in batches:
        kept.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        waiting += batch.num_rows
        if waiting < 200_000 and waiting < 2 * len(nodes):
            continue
        nodes = np.concatenate([nodes, *(k for k, _ in kept)])
        bits = np.concatenate([bits, *(b for _, b in kept)])
        kept, waiting = [], 0
        last = int(np.searchsorted(nodes, nodes[-1], "left")) if len(nodes) else 0
        if last:
            yield _links_of(nodes[:last], bits[:last])
            nodes, bits = nodes[last:], bits[last:]
    nodes = np.concatenate([nodes, *(k for k, _ in kept)])
    bits = np.concatenate([bits, *(b for _, b in kept)])
    if len(nodes):
        yield _links_of(nodes, bits)


def links(distinct: DataFrame, node_limit: int = NODE_LIMIT) -> DataFrame:
    """Links (a, b) that join all fingerprints within MAX_BITS of each other into components."""
    rows = upper_nodes(distinct, node_limit)
    rows = rows.repartition("node").sortWithinPartitions("node", gray_rank(F.col("bits")))
    return rows.mapInArrow(_search, "a long, b long").distinct()


# --- components -----------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node of an edge: root is the smallest node that it reaches.

    Alternating large-star and small-star rounds.  Minima are aggregated on the map
    side and joined back, so a hub with many edges can be split.  Each round is written to the
    shared folder; the one before it is removed.
    """
    spark = edges.sparkSession
    pairs = edges.select(
        F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    ).filter(F.col("u") != F.col("v"))
    current, path = write_table(pairs.distinct())
    before = None
    while True:
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"))
        least = least.select("u", F.least("u", "m").alias("m"))
        large = both.filter(F.col("v") > F.col("u")).join(least, "u")
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter(F.col("v") != F.col("m"))
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = small.union(least.select("u", F.col("m").alias("v"))).distinct()
        following, following_path = write_table(stars)
        drop_table(spark, path)
        current, path = following, following_path
        mark = current.agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s"),
        ).first()
        if mark == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = mark


# --- operator -------------------------------------------------------------------------------


def _named(bits: DataFrame, node_limit: int) -> DataFrame:
    """(bits, first_id, root) of each distinct fingerprint; root names its component."""
    classes = bits.groupBy("bits").agg(F.min("doc_id").alias("first_id"))
    reached = components(links(classes.select("bits"), node_limit))
    return classes.join(
        reached.select(F.col("node").alias("bits"), "root"), "bits", "left"
    ).select("bits", "first_id", F.coalesce("root", "bits").alias("root"))


def near_duplicates(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    node_limit: int = NODE_LIMIT,
) -> DataFrame:
    """(doc_id, fingerprint, component_id, root) of every row; root names the component.

    component_id is the smallest doc_id among all rows joined by links, the row itself
    included.  Null, empty and blank texts share fingerprint zero and are linked like any
    others.  Repeated rows stay repeated.  A null doc_id takes part, but never becomes
    a component_id unless its component has no other.  An empty table gives no rows; other columns, whatever
    their names, are left out.  Long texts count whole: shingles are hashed some thousands at a time.
    """
    prints = written(fingerprints(docs, doc_id, text))
    classes = _named(prints, node_limit)
    smallest = classes.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = classes.join(smallest, "root").select("bits", "component_id", "root")
    return prints.join(named, "bits").select(
        "doc_id", _shown("bits").alias("fingerprint"), "component_id", _shown("root").alias("root")
    )


def _shown(bits: str) -> Column:
    return F.lpad(F.lower(F.hex(bits)), 16, "0")


def first_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", node_limit: int = NODE_LIMIT
) -> DataFrame:
    """One row of each component, with all columns: that of the smallest id, known ids first.

    Among rows of one id in a component the smallest fingerprint wins, then the smallest digest of the
    text; of repeated rows one stays.  Null, empty and blank texts are one component.  An empty table gives no
    rows; further columns stay, and none of them is read.

    Texts are fingerprinted once.  Components are found on ids, digests and fingerprints; then the texts
    meet the winners, which are the hashed side, so no text is sorted or grouped.
    """
    marks = {
        "__id": F.coalesce(F.col(doc_id).cast("string"), F.lit("")),
        "__known": F.col(doc_id).isNotNull(),
        "__digest": F.xxhash64(text),
    }
    rows = docs.select(F.col(doc_id).alias("doc_id"), *[c.alias(n) for n, c in marks.items()], text)
    rows = rows.withColumn("bits", _fingerprint.asNondeterministic()(F.col(text))).drop(text)
    prints = written(rows.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("copies")))
    order = F.struct(~F.col("__known"), "doc_id", _shown("bits"), "__id", "__known", "__digest", "copies")
    winners = (
        prints.join(_named(prints, node_limit).select("bits", "root"), "bits")
        .groupBy("root")
        .agg(F.min(order).alias("first"))
        .select(*[F.col(f"first.{name}").alias(name) for name in (*marks, "copies")])
    )
    winners = written(winners)
    marked = docs.withColumns(marks)
    once = winners.where("copies = 1").select(*marks).hint("shuffle_hash")
    kept = marked.join(once, [*marks], "left_semi")
    again = winners.where("copies > 1").select(*marks)
    if not again.isEmpty():  # repeated rows: one of each stays
        copies = marked.join(again.hint("shuffle_hash"), [*marks], "left_semi")
        kept = kept.unionByName(copies.dropDuplicates([*marks]))
    return kept.select(*docs.columns)
