import resource
import time

import numpy as np
import pytest

from shelfledger.llm import decontamination as D

DOCS = "doc_id long, text string, item_id long, hit string"
ITEMS = "item_id long, text string, doc_id long"


def brute_tiles(item, doc, size):
    """Greedy tiling by definition: the longest unmarked common run, again and again."""
    used_i, used_d, total = [False] * len(item), [False] * len(doc), 0
    while True:
        best = (0, 0, 0)
        for p in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while p + n < len(item) and d + n < len(doc) and item[p + n] == doc[d + n] and not used_i[p + n] and not used_d[d + n]:
                    n += 1
                if n > best[0]:
                    best = (n, p, d)
        n, p, d = best
        if n < size:
            return total
        total += n
        for k in range(n):
            used_i[p + k] = used_d[d + k] = True


def test_tiling_equals_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(80):
        words = [f"w{k}" for k in range(int(rng.integers(3, 9)))]
        item = list(rng.choice(words, 24))
        doc = list(rng.choice(words, 15)) + item[14:] + list(rng.choice(words, 6)) + item[:12]
        index = D.ItemIndex([(1, " ".join(item))], 3)
        hits = index.hits(" ".join(doc), 0.0001)
        assert (hits[0]["matched_tokens"] if hits else 0) == brute_tiles(item, doc, 3)


PASSAGE = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"


def found(spark, docs, items, **more):
    rows = D.contaminated(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **more)
    return sorted((str(r.doc_id), r.item_id) for r in rows.collect())


def test_whole_reordered_and_partial_passages(spark):
    words = PASSAGE.split()
    docs = [
        (1, f"before {PASSAGE.upper()}, after", 9, ""),
        (2, " ".join(words[7:]) + " between " + " ".join(words[:7]), 9, ""),
        (3, " ".join(words[:10]), 9, ""),  # 10 of 14 tokens
        (4, " ".join(words[::2]), 9, ""),
        (5, "x " * 50_000 + PASSAGE, 9, ""),
    ]
    assert found(spark, docs, [(7, PASSAGE, 1)]) == [("1", 7), ("2", 7), ("5", 7)]


def test_edge_cases(spark):
    docs = [(None, PASSAGE, 1, ""), (1, None, 1, ""), (2, "", 1, ""), (3, PASSAGE, 1, ""), (3, PASSAGE, 1, "")]
    items = [(7, PASSAGE, 1), (7, PASSAGE, 1), (8, None, 1), (9, "", 1), (10, "one two", 1)]
    assert found(spark, docs, items) == [("3", 7), ("3", 7), ("None", 7)]
    assert found(spark, docs, []) == [] and found(spark, [], items) == []
    frame, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    clean = D.clean_documents(frame, bench)
    assert sorted(r.doc_id for r in clean.collect()) == [1, 2] and clean.columns == frame.columns


def test_a_large_benchmark_is_taken_in_blocks(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(12)), 0) for k in range(30)]
    docs = [(k, f"start {t} end", 0, "") for k, t, _ in items]
    whole = found(spark, docs, items)
    assert whole == sorted((str(k), k) for k in range(30))
    assert found(spark, docs, items, block_chars=500) == whole
    clean = D.clean_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), block_chars=500)
    assert clean.count() == 0


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.01"])
def test_given_tables_against_text_search(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    items = spark.read.parquet(f"{folder}/benchmark.parquet")
    got = {(r.doc_id, r.item_id) for r in D.contaminated(docs, items).collect()}
    plain = {
        (d.doc_id, i.item_id)
        for d in docs.collect()
        for i in items.collect()
        if " ".join(D.tokens_of(i.text)) in " ".join(D.tokens_of(d.text))
    }
    assert plain <= got and len(got) <= 1.05 * len(plain)


@pytest.mark.parametrize(
    ("item", "doc"),
    [
        (["a"] * 300, ["a"] * 1_000_000),
        (["a"] * 150 + ["b"] + ["a"] * 150, ["a"] * 300_000),
        (["a", "b"] * 200, ["a", "b"] * 200_000),
    ],
)
def test_repeated_words_need_no_pairs(item, doc):
    index = D.ItemIndex([(1, " ".join(item))], 5)
    began, memory = time.time(), resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    hits = index.hits(" ".join(doc), 0.8)
    assert [h["item_id"] for h in hits] == [1]
    assert time.time() - began < 20
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - memory < 500_000


def test_tiling_of_repetitive_texts_equals_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(60):
        item = list(rng.choice(["a", "b"], 14, p=[0.8, 0.2]))
        doc = list(rng.choice(["a", "b", "c"], 30, p=[0.6, 0.2, 0.2]))
        hits = D.ItemIndex([(1, " ".join(item))], 3).hits(" ".join(doc), 0.0001)
        assert (hits[0]["matched_tokens"] if hits else 0) == brute_tiles(item, doc, 3)
