import hashlib
import random
import time
import zlib

import pytest

from shelfledger.llm import periods as P
from shelfledger.llm import queries

DOCS = "doc_id long, text string, runs string, n_words int"


def brute_runs(words):
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            if length >= max(24, 3 * q) and not any(
                all(words[k] == words[k + d] for k in range(start, start + length - d)) for d in range(1, q)
            ):
                found.append((start, length, q))
    return sorted(found, key=lambda run: (run[0], run[2]))


def repetitive(rng):
    words = []
    while len(words) < rng.randint(0, 200):
        unit = [rng.randrange(3) for _ in range(rng.randint(1, rng.choice([2, 5, 12, 30])))]
        if rng.random() < 0.3:
            unit *= rng.randint(1, 4)
        part = unit * rng.choice([1, 1, 2, 3, 5, 20])
        part = part[: max(1, len(part) - rng.randrange(len(unit)))]
        if rng.random() < 0.2:
            part[rng.randrange(len(part))] = rng.randrange(4)
        words += part
    return words


def test_runs_equal_brute_force():
    rng = random.Random(3)
    seen = 0
    for _ in range(300):
        words = repetitive(rng)
        expected = brute_runs(words)
        assert P.runs_of(words) == expected, words
        seen += len(expected)
    assert seen > 100


@pytest.mark.parametrize(
    "words", [["a"] * 300_000, (["a"] * 100 + ["b"]) * 3_000, [x for i in range(3_000) for x in ["a"] * 99 + [str(i)]]]
)
def test_repeated_words_stay_cheap(words):
    began = time.time()
    assert P.runs_of(words)
    assert time.time() - began < 20


def brute_words(text):
    for c in "\t\n\x0b\x0c\r":
        text = (text or "").replace(c, " ")
    return [w for w in text.split(" ") if w]


def brute_row(doc_id, text):
    words = brute_words(text)
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute_runs(words)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    kept = " ".join(w for i, w in enumerate(words) if i not in dropped)
    best = None
    for run in runs:
        if best is None or run[1] * best[2] > best[1] * run[2]:
            best = run
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    shown = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (
        doc_id, len(runs), *shown,
        hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest(),
    )


def test_operator_edge_cases(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(map(str, repetitive(rng))), "x", 1) for i in range(150)]
    rows += [
        (None, "a " * 30, "x", 1), (200, None, None, None), (201, "", "x", 1), (202, " \t\x0b\n", "x", 1),
        (203, "ä\x1cö   " * 40, "x", 1), (203, "ä\x1cö   " * 40, "x", 1), (204, "one", None, 2),
        (205, "x y z " * 9 + "x y " * 20, "", 0),
    ]
    docs = spark.createDataFrame(rows, DOCS)
    got = [tuple(row) for row in P.digests(P.periodic_runs(P.planted(docs))).collect()]
    expected = [brute_row(row[0], row[1]) for row in rows]
    assert sorted(map(str, got)) == sorted(map(str, expected))


def test_empty_table(spark):
    found = P.periodic_runs(spark.createDataFrame([], DOCS))
    assert found.columns == ["doc_id", "n_words", "runs", "collapsed"] and not found.collect()


def test_texts_of_a_batch_are_split(spark, monkeypatch):
    monkeypatch.setattr(P, "BATCH_CHARS", 10)
    docs = spark.createDataFrame([(i, "a b " * i) for i in range(40)], "doc_id int, text string").coalesce(1)
    found = {row["doc_id"]: row["runs"] for row in P.periodic_runs(docs).collect()}
    assert [len(found[i]) for i in (0, 11, 12, 39)] == [0, 0, 1, 1]


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    short = [row for row in texts if len((row["text"] or "").split()) < 700]
    found = {row["doc_id"]: tuple(row) for row in queries.op13_periodic_runs(spark, folder).collect()}
    assert len(found) == len(texts)
    for row in short:
        assert found[row["doc_id"]] == brute_row(row["doc_id"], row["text"])
    assert sum(found[row["doc_id"]][1] for row in short) > 5


def test_query_equals_sql(spark):
    from tests.oracle import compare, connect

    class Query:
        frame = staticmethod(queries.op13_periodic_runs)
        oracle = staticmethod(P.oracle)

    folder = "/root/testdata/sf0.01"
    n, problems = compare(spark, folder, Query, connect(folder))
    assert n and not problems
