"""Exact integer k-means with a vantage-point tree over the centroids.

Vectors are scaled to integers, so assignments, sums and means are exact and the result does not depend
on how rows are dealt to tasks.  Each round builds a vantage-point tree over the current centroids on the
driver (a fixed, small number of rows), broadcasts it and assigns every vector by its own best-first
branch and bound: the open node with the least possible distance is visited next, and a
node is dropped only if its bound is beyond the best distance found.  Bounds are roots of
exact integer distances, lowered by more than their rounding error, and a node at exactly the best distance
is visited, so a tie is always seen and goes to the smaller number.  Leaf distances are exact integers.

Tasks return sums per cluster and component, at most one row for each of these; Spark adds them up.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import IntegerType, LongType, StructType

from shelfledger.llm.common import columns, written

CLUSTERS = 40
ROUNDS = 5
COMPONENTS = 64
SCALE = 256
SEED = "2:"
#: Centroids in a leaf of the tree.
LEAF = 4
#: Rounding errors of a few roots and sums stay far below this share.
MARGIN = 1e-9
#: Components up to this size: sums of squared differences fit into 64 bits.
SMALL = 2**27
#: Larger numbers are added up in pieces of so many bits.
PIECE_BITS = 30

Centroid = tuple[int, ...]


# --- vectors --------------------------------------------------------------------------------


def kept_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors with exactly so many finite components."""
    rows = columns(vectors, vec_id, embedding).toDF("vec_id", "embedding")
    rows = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    finite = F.forall(
        "embedding", lambda x: F.nvl(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), F.lit(False))
    )
    return rows.where((F.size("embedding") == components) & finite)


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), exactly."""
    top, bottom = x.as_integer_ratio()
    return top * scale // bottom


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """Rows of floor(scale * x): 64-bit numbers, or Python's if one is too large."""
    with np.errstate(over="ignore"):
        scaled = np.floor(values * scale) if math.log2(scale).is_integer() else None
    if scaled is not None and (not scaled.size or np.abs(scaled).max() <= SMALL):
        return scaled.astype(np.int64)
    exact = np.empty(values.shape, object)
    exact[:] = [[whole(x, scale) for x in row] for row in values.tolist()]
    if exact.size and max(abs(x) for x in exact.flat) <= SMALL:
        return exact.astype(np.int64)
    return exact


# --- tree -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class Node:
    """A leaf (numbers of its centroids), or a vantage point, its radius and two children."""

    numbers: tuple[int, ...]
    radius: float = 0.0
    inside: int = -1
    outside: int = -1


def _squared(a: Centroid, b: Centroid) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


def _root(squared: int) -> float:
    return math.sqrt(squared) if squared.bit_length() < 1000 else math.inf


def build_tree(centroids: list[Centroid], leaf: int = LEAF) -> list[Node]:
    """Nodes, the root first.  The vantage point is the smallest number; half of the rest lies inside."""
    nodes: list[Node | None] = []

    def add(numbers: list[int]) -> int:
        at = len(nodes)
        nodes.append(None)
        if len(numbers) <= leaf:
            nodes[at] = Node(tuple(numbers))
            return at
        point, rest = numbers[0], numbers[1:]
        away = {i: _squared(centroids[point], centroids[i]) for i in rest}
        radius = sorted(away.values())[(len(rest) - 1) // 2]
        inside = add([i for i in rest if away[i] <= radius])
        beyond = [i for i in rest if away[i] > radius]
        nodes[at] = Node((point,), _root(radius), inside, add(beyond) if beyond else -1)
        return at

    if centroids:
        add(list(range(len(centroids))))
    return nodes


def nearest(
    rows: np.ndarray, centroids: list[Centroid], nodes: list[Node]
) -> tuple[np.ndarray, np.ndarray]:
    """(number, squared distance) of the nearest centroid of each row of integers; ties: smaller number."""
    points = np.array(centroids, object).reshape(len(centroids), -1)
    if rows.dtype != object and max((abs(x) for x in points.flat), default=0) <= SMALL:
        points = points.astype(np.int64)
    else:
        rows = rows.astype(object)
    n = len(rows)
    number = np.full(n, -1)
    best = np.zeros(n, rows.dtype)
    reach = np.full(n, np.inf)  # root of the best distance
    bound = np.full((n, len(nodes)), np.inf)
    bound[:, 0] = 0.0
    opened = np.full(n, 1)
    active = np.arange(n)
    while active.size:
        node = bound[active].argmin(axis=1)
        least = bound[active, node]
        going = (least <= reach[active] * (1 + MARGIN)) & (opened[active] > 0)
        active, node, least = active[going], node[going], least[going]
        bound[active, node] = np.inf
        opened[active] -= 1
        for k in np.unique(node).tolist():
            chosen = node == k
            at, low = active[chosen], least[chosen]
            for i in nodes[k].numbers:
                away = ((rows[at] - points[i]) ** 2).sum(axis=1)
                better = (number[at] < 0) | (away < best[at]) | ((away == best[at]) & (i < number[at]))
                changed = at[better]
                best[changed], number[changed] = away[better], i
                reach[changed] = _roots(away[better])
            if nodes[k].inside >= 0:
                here = _roots(away)
                slack = MARGIN * (here + nodes[k].radius)
                for child, gap in (
                    (nodes[k].inside, here - nodes[k].radius - slack),
                    (nodes[k].outside, nodes[k].radius - here - slack),
                ):
                    if child >= 0:
                        bound[at, child] = np.maximum(low, np.nan_to_num(gap, nan=0.0, posinf=0.0))
                        opened[at] += 1
    return number, best


def _roots(squared: np.ndarray) -> np.ndarray:
    if squared.dtype == object:
        return np.array([_root(int(x)) for x in squared], float)
    return np.sqrt(squared.astype(float))


# --- rounds ---------------------------------------------------------------------------------


def _batches(
    batches: Iterator[pa.RecordBatch], components: int, scale: int
) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            yield batch, _integers(flat.reshape(-1, components), scale)


def _pieces(value: int) -> Iterator[tuple[int, int]]:
    """(place, number): value = sum of number * 2 ** (PIECE_BITS * place), the last one with the sign."""
    place = 0
    while value.bit_length() > 2 * PIECE_BITS:
        yield place, value & ((1 << PIECE_BITS) - 1)
        value >>= PIECE_BITS
        place += 1
    yield place, value


_SUMS = "cluster int, component int, piece int, total bigint"


def next_centroids(
    rows: DataFrame, centroids: list[Centroid], components: int = COMPONENTS, scale: int = SCALE
) -> list[Centroid]:
    """Exact floor of the mean of each centroid's vectors; a centroid without vectors stays."""
    spark = rows.sparkSession
    tree = spark.sparkContext.broadcast((centroids, build_tree(centroids)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, nodes = tree.value
        totals: dict[tuple[int, int], int] = {}
        for _, numbers in _batches(batches, components, scale):
            cluster, _ = nearest(numbers, points, nodes)
            for k in np.unique(cluster).tolist():
                mine = numbers[cluster == k]
                parts = [len(mine), *mine.sum(axis=0).tolist()]
                for component, part in enumerate(parts):
                    totals[k, component] = totals.get((k, component), 0) + int(part)
        out = [(k, c, p, x) for (k, c), total in totals.items() for p, x in _pieces(total)]
        if out:
            names = ["cluster", "component", "piece", "total"]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
            arrays = [pa.array(col, kind) for col, kind in zip(zip(*out, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    # A row for each cluster, component and piece: a bound that no table moves.
    added = (
        rows.mapInArrow(sums, _SUMS)
        .groupBy("cluster", "component", "piece")
        .agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
        .collect()
    )
    tree.unpersist()
    totals: dict[tuple[int, int], int] = {}
    for row in added:
        key = row["cluster"], row["component"]
        totals[key] = totals.get(key, 0) + (int(row["total"]) << (PIECE_BITS * row["piece"]))
    return [
        tuple(totals.get((k, c + 1), 0) // count for c in range(components))
        if (count := totals.get((k, 0), 0))
        else old
        for k, old in enumerate(centroids)
    ]


def first_centroids(
    rows: DataFrame, clusters: int = CLUSTERS, seed: str = SEED, scale: int = SCALE
) -> list[Centroid]:
    """The vectors whose seeded sha256 of the id is smallest; equal ids by their components."""
    text = F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    first = rows.orderBy(F.sha2(text.cast("binary"), 256), "embedding").limit(clusters)
    return [tuple(whole(x, scale) for x in row["embedding"]) for row in first.select("embedding").collect()]


def fit(
    rows: DataFrame,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: str = SEED,
) -> list[Centroid]:
    """Centroids after so many rounds; fewer than ``clusters`` if there are fewer vectors."""
    centroids = first_centroids(rows, clusters, seed, scale)
    for _ in range(rounds if centroids else 0):
        centroids = next_centroids(rows, centroids, components, scale)
    return centroids


def assign(
    rows: DataFrame, centroids: list[Centroid], components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """(vec_id, cluster, distance) of every vector; a squared distance beyond 64 bits is null."""
    out = StructType([rows.schema["vec_id"]]).add("cluster", IntegerType()).add("distance", LongType())
    if not centroids:
        return rows.sparkSession.createDataFrame([], out)
    schema = to_arrow_schema(out)
    tree = rows.sparkSession.sparkContext.broadcast((centroids, build_tree(centroids)))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, nodes = tree.value
        for batch, numbers in _batches(batches, components, scale):
            cluster, distance = nearest(numbers, points, nodes)
            shown = pa.array([x if x < 2**63 else None for x in distance.tolist()], pa.int64())
            ids = batch.column(0).cast(schema.field(0).type)
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster, pa.int32()), shown], schema=schema)

    return rows.mapInArrow(found, out)


def cluster_vectors(
    vectors: DataFrame,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    components: int = COMPONENTS,
    scale: int = SCALE,
    seed: str = SEED,
) -> tuple[DataFrame, list[Centroid]]:
    """(vec_id, cluster, distance) of every kept vector, and the final centroids.

    Vectors of another length, null vectors and those with a null or non-finite component are left out.
    Repeated rows stay and count each; a null id counts as empty text in the choice of the first centroids.  Without
    a kept vector, also for an empty table, there are no rows and no centroids.  Other columns are
    left out.  Components of any size are exact; only a squared distance beyond 64 bits is shown as null.
    """
    rows = kept_vectors(vectors, vec_id, embedding, components)
    centroids = fit(rows, clusters, rounds, components, scale, seed)
    return assign(rows, centroids, components, scale), centroids


def with_inertia(assigned: DataFrame, centroids: list[Centroid]) -> DataFrame:
    """``assigned`` with the distance sums of the cluster and of all, and the digest of the centroid.

    A sum is null if it is beyond 64 bits or if one of its distances is.
    """
    assigned = written(assigned)
    total = F.sum(F.col("distance").cast("decimal(38,0)"))
    sums = assigned.groupBy("cluster").agg(
        F.when(F.count("distance") == F.count(F.lit(1)), total).alias("part")
    )
    everything = Window.partitionBy(F.lit(1))  # one row per cluster
    known = F.count("part").over(everything) == F.count(F.lit(1)).over(everything)
    sums = sums.select(
        "cluster",
        F.col("part").try_cast("bigint").alias("cluster_inertia"),
        F.when(known, F.sum("part").over(everything)).try_cast("bigint").alias("inertia"),
    )
    digests = [
        (k, hashlib.sha256(",".join(map(str, point)).encode()).hexdigest())
        for k, point in enumerate(centroids)
    ]
    named = assigned.sparkSession.createDataFrame(digests, "cluster int, centroid_sha256 string")
    return (
        assigned.join(F.broadcast(sums), "cluster")
        .join(F.broadcast(named), "cluster")
        .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    )


# --- the same in SQL ------------------------------------------------------------------------


def oracle() -> str:
    """DuckDB SQL of the registered query: every distance in place of the tree, rounds unrolled."""
    parts = [
        f"""kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {COMPONENTS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {COMPONENTS}
)""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{SEED}' || coalesce(CAST(vec_id AS VARCHAR), '')), v) - 1 AS k, v
  FROM kept QUALIFY k < {CLUSTERS}
)""",
    ]
    for r in range(ROUNDS + 1):
        parts.append(
            f"""a{r} AS MATERIALIZED (
  SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min(code) % {CLUSTERS} AS k,
    min(code) // {CLUSTERS} AS distance
  FROM (
    SELECT rid, vec_id, kept.v, c{r}.k + {CLUSTERS} * CAST(list_sum(list_transform(
      list_zip(kept.v, c{r}.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS code
    FROM kept, c{r}
  ) GROUP BY rid
)"""
        )
        if r < ROUNDS:
            parts.append(
                f"""c{r + 1} AS MATERIALIZED (
  SELECT old.k, coalesce(means.v, old.v) AS v
  FROM c{r} AS old LEFT JOIN (
    SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v
    FROM (SELECT k, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n
          FROM (SELECT k, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY k, i)
    GROUP BY k
  ) AS means ON means.k = old.k
)"""
            )
    last = ROUNDS
    return f"""WITH {", ".join(parts)}
SELECT a.vec_id, CAST(a.k AS INTEGER) AS cluster, a.distance,
  CAST(sum(a.distance) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(a.distance) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{last} AS a JOIN c{last} AS c ON c.k = a.k"""
