import hashlib
import math
import random
from fractions import Fraction

import numpy as np

from shelfledger.llm import centroids as C

SCHEMA = "vec_id long, embedding array<double>, cluster string"


def brute(rows, k, rounds, dims, scale):
    """[(vec_id, cluster, distance)] and centroids of (vec_id, vector) rows, by plain loops."""
    kept = [
        (i, tuple(math.floor(Fraction(x) * scale) for x in v))
        for i, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    text = {i: hashlib.sha256(f"2:{'' if i is None else i}".encode()).hexdigest() for i, _ in kept}
    points = [v for _, v in sorted(kept, key=lambda r: (text[r[0]], r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, p, strict=True)), n) for n, p in enumerate(points))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        points = [
            tuple(sum(col) // len(groups[n]) for col in zip(*groups[n], strict=True)) if n in groups else p
            for n, p in enumerate(points)
        ]
    return [(i, nearest(v)[1], nearest(v)[0]) for i, v in kept], points


def sample(rng, n, dims, spread=1.0):
    rows = [(i, [round(rng.gauss(i % 4, spread), 2) for _ in range(dims)]) for i in range(n)]
    rows += [(n, rows[0][1]), (None, rows[1][1]), (1, rows[1][1]), (2, rows[2][1]), (n + 1, None), (n + 2, [])]
    rows += [(n + 3, [math.nan] * dims), (n + 4, [math.inf] * dims), (n + 5, [None] * dims), (n + 6, [0.1] * (dims + 1))]
    return rows + [(n + 7, [-0.001] * dims), (n + 8, [-0.0] * dims)]


def check(spark, rows, k, rounds, dims, scale=256, partitions=5):
    table = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(partitions)
    assigned, points = C.cluster_vectors(table, clusters=k, rounds=rounds, components=dims, scale=scale)
    expected, expected_points = brute(rows, k, rounds, dims, scale)
    assert points == expected_points
    expected = [(i, c, d if d < 2**63 else None) for i, c, d in expected]
    assert sorted(map(str, map(tuple, assigned.collect()))) == sorted(map(str, expected))
    return assigned, points


def test_equals_brute_force(spark):
    assigned, points = check(spark, sample(random.Random(1), 300, 3), 12, 4, 3)
    rows = C.with_inertia(assigned, points).collect()
    for row in rows:
        mine = [r["distance"] for r in rows if r["cluster"] == row["cluster"]]
        assert row["cluster_inertia"] == sum(mine) and row["inertia"] == sum(r["distance"] for r in rows)
        text = ",".join(map(str, points[row["cluster"]]))
        assert row["centroid_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_ties_and_few_vectors(spark):
    grid = [(i, [float(i % 3), float(i // 3 % 3)]) for i in range(90)]
    check(spark, grid, 20, 3, 2, scale=2)
    check(spark, grid[:4] * 3, 40, 2, 2, scale=1)


def test_numbers_beyond_64_bits(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e300, -1e200, 3e30, 0.5, 1.7e308]) * rng.random() for _ in range(2)]) for i in range(40)]
    assigned, points = check(spark, rows, 5, 3, 2)
    assert any(row["inertia"] is None for row in C.with_inertia(assigned, points).collect())
    check(spark, [(i, [rng.choice([1e6, 3e9, 0.25])]) for i in range(60)], 6, 3, 1, scale=10)


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assigned, points = C.cluster_vectors(empty)
    assert points == [] and C.with_inertia(assigned, points).collect() == []
    assert C.cluster_vectors(spark.createDataFrame([(1, [1.0], "x")], SCHEMA))[0].collect() == []


def test_search_prunes_and_keeps_ties():
    rng = np.random.default_rng(2)
    centers = rng.integers(-1000, 1000, (40, 2))
    points = [tuple(map(int, p)) for p in centers] + [tuple(map(int, centers[0]))]
    rows = np.concatenate([centers, rng.integers(-1200, 1200, (2000, 2))])
    number, best = C.nearest(rows, points, C.build_tree(points))
    away = ((rows[:, None, :] - np.array(points)[None]) ** 2).sum(axis=2)
    assert np.array_equal(best, away.min(axis=1)) and np.array_equal(number, away.argmin(axis=1))


def test_query_equals_sql(spark):
    from shelfledger.llm.queries import op11_centroid_clusters
    from tests.oracle import compare, connect

    class Query:
        frame = staticmethod(op11_centroid_clusters)
        oracle = staticmethod(C.oracle)

    folder = "/root/testdata/sf0.001"
    n, problems = compare(spark, folder, Query, connect(folder))
    assert n > 0 and not problems
