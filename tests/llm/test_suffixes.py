import hashlib
import random

import pytest

from shelfledger.llm import queries
from shelfledger.llm import suffixes as S

DOCS = "doc_id long, text string, pack long, removed string"


def brute(rows, length):
    """[(doc_id, spans, kept)] of (doc_id, text) rows."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, t in texts:
        for p in range(len(t) - length + 1):
            s = t[p : p + length]
            key = (i is None, i or 0)
            first[s] = min(first.get(s, key), key)
    out = []
    for i, t in texts:
        gone = [False] * len(t)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < (i is None, i or 0):
                gone[p : p + length] = [True] * length
        spans, p = [], 0
        while p < len(t):
            if gone[p]:
                start = p
                while p < len(t) and gone[p]:
                    p += 1
                spans.append((start, p - start))
            else:
                p += 1
        out.append((i, len(t), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def found(frame):
    return [
        (r["doc_id"], r["n_bytes"], [tuple(x) for x in r["removed"]], bytes(r["kept"])) for r in frame.collect()
    ]


def related(rng, n, letters, most=300):
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(3, 120))) for _ in range(6)]
    texts = []
    for _ in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.6:
                part = rng.choice(passages)
                a = rng.randrange(len(part))
                parts.append(part[a:] if rng.random() < 0.3 else part)
            elif texts and rng.random() < 0.5:
                parts.append(rng.choice(texts)[-rng.randint(1, 90) :])
            else:
                parts.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 60))))
        texts.append("".join(parts)[:most])
    return texts


@pytest.mark.parametrize(("length", "letters"), [(50, "ab é"), (50, "abcdefgh "), (33, "a"), (7, "abc")])
def test_equals_brute_force(spark, length, letters):
    rng = random.Random(length)
    rows = list(enumerate(related(rng, 120, letters)))
    rng.shuffle(rows)
    rows += [(None, rows[0][1]), (None, rows[1][1] + "q"), (5, rows[2][1]), (5, rows[2][1]), (900, None), (901, "")]
    rows += [(902, "x" * 49), (903, "x" * 49), (904, "x" * 50), (905, "x" * 51), (906, "y" * 400)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], DOCS).repartition(3)
    got = found(S.remove_repeats(docs, length=length))
    assert sorted(map(str, got)) == sorted(map(str, brute(rows, length)))


def test_pieces_of_long_texts_hold_every_string(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(S, "BLOCK", 64)
    rng = random.Random(1)
    texts = related(rng, 30, "ab ", 2000) + ["z" * 500, ""]
    pack = S.Pack(pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    stretches = S.Stretches(pack, 20)
    starts = sorted(p for a, n in zip(stretches.lo, stretches.count, strict=True) for p in range(a, a + n))
    expected = [int(pack.starts[k]) + p for k, t in enumerate(pack.texts) for p in range(len(t) - 19)]
    assert starts == expected


def test_hot_passage_and_copies(spark):
    passage = "every page of this site ends with one and the same sentence about its terms. "
    rows = [(i, f"page {i * 7919} {passage}{i * 104729} words") for i in range(400)] + [(i, passage * 3) for i in range(400, 500)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(16)
    got = found(S.remove_repeats(docs, pack_bytes=2_000))
    assert sorted(got) == sorted(brute(rows, 50))


def test_empty_table(spark):
    frame = S.remove_repeats(spark.createDataFrame([], DOCS))
    assert frame.columns == ["doc_id", "n_bytes", "removed", "kept"] and not frame.collect()


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op12_suffix_repeats(spark, folder).collect()]
    expected = [
        (i, n, n - len(kept), len(spans), hashlib.sha256(kept).hexdigest()) for i, n, spans, kept in brute(rows, 50)
    ]
    assert sorted(got) == sorted(expected) and sum(row[2] for row in got) > 1000


def test_query_equals_sql(spark):
    from tests.oracle import compare, connect

    class Query:
        frame = staticmethod(queries.op12_suffix_repeats)
        oracle = staticmethod(S.oracle)

    folder = "/root/testdata/sf0.01"
    n, problems = compare(spark, folder, Query, connect(folder))
    assert n and not problems
