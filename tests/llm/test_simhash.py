from collections import Counter

import numpy as np
import pytest
import xxhash

from shelfledger.llm import simhash as S

DOCS = "doc_id long, text string, fingerprint string, bits long, node long"


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    words = [w for w in low.split(" ") if w]
    grams = [" ".join(words[k : k + 3]) for k in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    votes = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
    return f"{sum(1 << b for b, n in votes.items() if 2 * n > len(grams)):016x}"


def brute_components(pairs):
    """pairs: (id, hex); smallest id of each row's component."""
    values = [int(h, 16) for _, h in pairs]
    parent = list(range(len(pairs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(pairs)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= 3:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for k, (i, _) in enumerate(pairs):
        groups.setdefault(find(k), []).append(i)
    return [min((i for i in groups[find(k)] if i is not None), default=None) for k in range(len(pairs))]


@pytest.mark.parametrize("text", ["", None, " \t\n", "One", "a B", "Ä ß a b c\x1cd e", "x y z x y z x y z q"])
def test_fingerprint(text):
    assert f"{S.fingerprint_of(text) & (2**64 - 1):016x}" == brute_fingerprint(text)


def test_spanning_links_equal_brute_force():
    rng = np.random.default_rng(5)
    values = set()
    for base in rng.integers(-(2**63), 2**63, 60, dtype=np.int64):
        for _ in range(int(rng.integers(1, 20))):
            v = int(base) & (2**64 - 1)
            for bit in rng.integers(0, 64, rng.integers(0, 4)):
                v ^= 1 << int(bit)
            values.add(v)
    for bits in range(200):  # a dense group, where whole nodes are joined
        values.add(0xABCDEF0000000000 | bits)
    def gray(v):
        for s in (1, 2, 4, 8, 16, 32):
            v ^= v >> s
        return v

    ordered = np.array(sorted(values, key=gray), np.uint64).view(np.int64)
    roots = S.spanning_links(np.zeros(len(ordered), np.int64), ordered)
    pairs = [(k, f"{int(v) & (2**64 - 1):016x}") for k, v in enumerate(ordered)]
    assert roots.tolist() == brute_components(pairs)


@pytest.mark.parametrize("limit", [2, 2048])
def test_components_equal_brute_force(spark, limit):
    rng = np.random.default_rng(6)
    vocabulary = [f"w{k}" for k in range(50)]
    base = [list(rng.choice(vocabulary, 40)) for _ in range(12)]
    rows = [(None, None), (-5, ""), (-4, "\n"), (7, "same"), (7, "same"), (None, "SAME"), (99, "x " * 30_000)]
    for k in range(150):
        words = list(base[k % 12])
        for at in rng.choice(40, int(rng.integers(0, 3)), replace=False):
            words[at] = str(rng.choice(vocabulary))
        rows.append((1000 - k, " ".join(words)))
    docs = spark.createDataFrame([(i, t, "clash", 1, 2) for i, t in rows], DOCS)
    found = S.near_duplicates(docs, node_limit=limit).collect()
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in found)
    prints = [brute_fingerprint(t) for _, t in rows]
    ids = brute_components([(i, p) for (i, _), p in zip(rows, prints)])
    assert got == sorted((str(i), p, c) for (i, _), p, c in zip(rows, prints, ids))


def test_first_of_each(spark):
    rows = [(3, "a b c d"), (1, "A b c d"), (1, "a b c d"), (None, "a B c d"), (None, "other text here now"), (2, "something else again yes"), (2, "quite another one it is")]
    docs = spark.createDataFrame([(i, t, "f", 0, 0) for i, t in rows], DOCS)
    kept = S.first_of_each(docs).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == [
        ("1", "a b c d"), ("2", "quite another one it is"), ("2", "something else again yes"), ("None", "other text here now"),
    ]
    assert kept[0].asDict().keys() == {"doc_id", "text", "fingerprint", "bits", "node"}


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    found = {r.node: r.root for r in S.components(edges).collect()}
    assert all(found[k] == 0 for k in range(1, 61)) and found[101] == 100


def test_empty(spark):
    assert S.near_duplicates(spark.createDataFrame([], DOCS)).count() == 0
