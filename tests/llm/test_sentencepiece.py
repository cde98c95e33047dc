import itertools
import random

import pytest

from shelfledger.llm import sentencepiece as S
from shelfledger.llm.queries import VOCABULARY

DOCS = "doc_id long, text string, ids string, word string"


@pytest.fixture(scope="module")
def vocabulary():
    return S.load(VOCABULARY)


def brute(word, vocabulary):
    """Best score over all ways of cutting a word."""
    best = float("-inf")
    for cuts in itertools.product([0, 1], repeat=len(word) - 1):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(word)]
        score = 0.0
        for a, b in zip(at, at[1:]):
            known = vocabulary.pieces.get(word[a:b])
            if known is None and b - a > 1:
                score = float("-inf")
                break
            score += known[1] if known else vocabulary.unknown_score
        best = max(best, score)
    return best


def score(ids, vocabulary):
    own = {k: s for k, s in vocabulary.pieces.values()}
    return sum(own.get(k, 0.0) for k in ids)


def test_cuts_never_split_a_piece(vocabulary):
    cut = S.Cutter(vocabulary)
    cut.prefix = ""
    for piece in vocabulary.pieces:
        assert len(cut(piece.replace(S.SPACE, " "))) == 1, piece
    text = " a  b,c\n\nd.e 12x_y日本 😀!"
    assert "".join(cut(text)) == text.replace(" ", S.SPACE)


def test_path_is_the_best_of_all(vocabulary):
    rng = random.Random(0)
    for _ in range(60):
        word = S.SPACE * rng.randint(0, 2) + "".join(rng.choice("theraionsß9.,") for _ in range(rng.randint(1, 9)))
        ids = S.viterbi(word, vocabulary)
        assert score(ids, vocabulary) == pytest.approx(brute(word, vocabulary))


def encoded(spark, texts, vocabulary, **more):
    docs = spark.createDataFrame([(k, t, "clash", "clash") for k, t in texts], DOCS)
    return S.encode(docs, vocabulary, **more)


TEXTS = [
    (1, "The and attion to thanedble the, anea."), (2, None), (3, ""), (None, "null id"), (5, "  two  spaces \n\n\tand tabs "),
    (6, "日本語 😀 é́ \u0000x"), (7, "12.5% a_b <s> </s> <0x41>"), (8, "word " * 20_000), (8, "word " * 20_000),
    (9, "x" * 3000 + " " + "ab" * 400), (10, " "), (11, "\n"),
]


@pytest.mark.parametrize("group_bytes", [S.GROUP_BYTES, 20_000])
def test_relation_equals_the_recurrence_and_round_trips(spark, vocabulary, group_bytes):
    found = encoded(spark, TEXTS, vocabulary, group_bytes=group_bytes)
    found = found.select("doc_id", "ids", "decodes", S.decode(vocabulary, "ids").alias("back"))
    cut = S.Cutter(vocabulary)
    rows = found.collect()
    text = dict(TEXTS)
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(k) for k, _ in TEXTS)
    for r in rows:
        assert r.ids == [k for w in cut(text[r.doc_id]) for k in S.viterbi(w, vocabulary)]
        assert r.decodes and r.back == (text[r.doc_id] or "")


def test_a_literal_space_mark_is_a_space(spark, vocabulary):
    row = encoded(spark, [(1, f"a{S.SPACE}b")], vocabulary).first()
    assert not row.decodes and S.decoded(row.ids, vocabulary) == "a b"


def test_best_paths_on_a_small_vocabulary(spark):
    small = S.Vocabulary({"a": (0, -1.0), "b": (1, -1.0), "ab": (2, -2.0), "abb": (3, -9.0), "bb": (4, -1.5)}, [9] * 256, [], 9, False)
    words = spark.createDataFrame([("abb",), ("ab",), ("xab",), ("a",)], "word string")
    paths = S.best_paths(words, S.piece_table(spark, small), small.longest, small.unknown_score)
    found = {r.word: [(p.start, p.id) for p in r.path] for r in paths.collect()}
    # Equal sums ("ab" and "a", "b") go to the longer last piece.
    assert found == {"abb": [(0, 0), (1, 4)], "ab": [(0, 2)], "xab": [(0, -1), (1, 2)], "a": [(0, 0)]}


def test_empty(spark, vocabulary):
    assert encoded(spark, [], vocabulary).count() == 0


def test_given_table_round_trips(spark):
    from shelfledger.llm.queries import op10_sentencepiece

    found = op10_sentencepiece(spark, "/root/testdata/sf0.001")
    assert found.filter("NOT decodes OR n_pieces <> size(ids)").count() == 0
    assert found.count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()
