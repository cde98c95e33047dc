import numpy as np
import pytest

from shelfledger.llm import toxicity as T

DOCS = "doc_id long, text string, score double, toxic int"
LABELS = "doc_id long, toxic int, text string"


def brute_segments(values):
    """Repeatedly take the best contiguous part left, as the definition says."""
    found = []

    def take(low, high):
        best = (0.0, 0, None)
        for a in range(low, high):
            for b in range(a, high):
                s = sum(values[a : b + 1])
                if s > best[0] + 1e-12 or (best[2] and abs(s - best[0]) <= 1e-12 and b - a < best[2][1] - best[2][0]):
                    best = (s, 0, (a, b))
        if best[2]:
            a, b = best[2]
            take(low, a)
            found.append((a, b, best[0]))
            take(b + 1, high)

    take(0, len(values))
    return found


def test_maximal_segments_equal_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(200):
        values = [float(v) for v in rng.choice([-0.5, -0.5, -0.5, 1.3, 2.1, 3.7], size=14)]
        places = [k for k, v in enumerate(values) if v != -0.5]
        found = T.maximal_segments(places, [values[k] for k in places], 0.5)
        got = [(places[a], places[b], round(s, 9)) for a, b, s in found]
        assert got == [(a, b, round(s, 9)) for a, b, s in brute_segments(values)]


def test_a_word_said_twice_in_a_row_counts_once():
    model = T.Model({"bad": (9.0, 2.0)})
    assert model.scan("bad bad bad".split()) == [(0, 0, 2.0)]
    assert model.scan("bad x bad".split()) == [(0, 2, 3.5)]
    assert model.scan([]) == []


def test_stems_speak_for_unseen_words():
    model = T.Model({"nast*": (9.0, 3.0)})
    assert model.word_score("nastier") == 3.0 and model.word_score("nas") == -model.gap


@pytest.fixture(scope="module")
def taught(spark):
    rng = np.random.default_rng(3)
    words = [a + b for a in ("ka", "lo", "mi", "ne", "po") for b in ("ra", "su", "ti", "vo", "we")]
    rows, labels = [], []
    for k in range(400):
        text = list(rng.choice(words, 60))
        if k % 4 == 0:
            for at in rng.choice(60, 5, replace=False):
                text[at] = str(rng.choice(["filthus", "scumbo"]))
        rows.append((k, " ".join(text), None, None))
        labels.append((k, int(k % 4 == 0), "clash"))
    labels += [(None, 1, ""), (3, None, ""), (8, 0, "")]
    docs = spark.createDataFrame(rows, DOCS)
    return T.learn(docs, spark.createDataFrame(labels, LABELS)), docs


def test_toxic_texts_and_their_passages_are_found(spark, taught):
    model, docs = taught
    found = T.detect(docs, model).toPandas().set_index("doc_id")
    assert ((found.index % 4 == 0) == (found.predicted == 1)).mean() > 0.98
    text = {r.doc_id: r.text for r in docs.collect()}
    for p in found.loc[0].passages:
        assert text[0][p["start"] : p["end"]].split()[0] in ("filthus", "scumbo")


def test_edge_cases(spark, taught):
    model, _ = taught
    rows = [(1, None, 1.0, 1), (2, "", None, None), (3, "1 2 | !", None, 1), (None, "filthus", None, 1)]
    rows += [(5, "kara " * 100_000 + "filthus", None, 0)] * 2 + [(6, "İ filthus scumbo filthus scumbo", None, 1)]
    found = T.detect(spark.createDataFrame(rows, DOCS), model).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    assert {found[k].score for k in range(3)} == {found[0].score}
    assert found[-1].passages and found[-1].passages[0]["start"] is None
    empty = spark.createDataFrame([], DOCS)
    assert T.detect(empty, model).count() == 0
    untaught = T.learn(empty, spark.createDataFrame([], LABELS))
    assert T.detect(spark.createDataFrame(rows, DOCS), untaught).agg({"predicted": "max"}).first()[0] == 0


def test_held_out_accuracy(spark):
    from shelfledger.llm.queries import op7_toxicity

    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = op7_toxicity(spark, folder).join(labels, "doc_id").filter("held_out").toPandas()
    assert (found.toxic == found.predicted).mean() >= 0.97
    assert found[found.toxic == 1].predicted.mean() >= 0.85
