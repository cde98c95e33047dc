import numpy as np
import pytest

from shelfledger.llm import quality as Q

DOCS = "doc_id long, text string, score double, quality int"
LABELS = "doc_id long, quality int, text string"


def test_log_count_ratios():
    rows = [np.array([0, 1]), np.array([0]), np.array([2])]
    found = Q.log_count_ratios(rows, np.array([1, 1, 0]), 3)
    p, q = np.array([3, 2, 1]) / 6, np.array([1, 1, 2]) / 4
    assert np.allclose(found, np.log(p / q))


def test_dual_coordinate_descent_reaches_the_primal_optimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(60, 4))
    y = np.where(x @ [1, -2, 0.5, 0] + 0.3 * rng.normal(size=60) > 0, 1.0, -1.0)
    at = np.arange(4)
    w = Q.dual_coordinate_descent([at] * 60, list(x), y, 4, np.full(60, 0.5), epochs=500)

    def primal(w):
        margins = y * (x @ w[:4] + w[4])
        return 0.5 * w @ w + 0.5 * np.maximum(0, 1 - margins).sum()

    best = primal(w)
    for _ in range(300):
        assert primal(w + 0.02 * rng.normal(size=5)) >= best - 1e-6


def test_indicators_are_distinct_and_see_repetition():
    words = Q.Words()
    found = Q.indicators("a a b", words)
    assert len(set(found.tolist())) == len(found)
    assert set(Q.indicators("x y", words)) != set(Q.indicators("x x", words))
    assert Q.indicators(None, words).tolist() == Q.indicators("", words).tolist()
    assert Q.shape_of("Thon***") == "Aa***" and Q.shape_of("12a") == "9a"


@pytest.fixture(scope="module")
def taught(spark):
    rng = np.random.default_rng(2)
    good = "the a house garden tree with and river".split()
    rows, labels = [], []
    for k in range(300):
        words = rng.choice(good, 20)
        if k % 3 == 0:
            words = [f"{w} |" for w in words]
        rows.append((k, " ".join(words), None, None))
        labels.append((k, int(k % 3 != 0), "clash"))
    labels += [(1, None, ""), (None, 1, ""), (7, 0, ""), (10_000, 1, "")]
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, LABELS)
    return Q.learn(docs, marks), docs, marks


def test_classes_are_told_apart(spark, taught):
    model, docs, _ = taught
    found = Q.classify(docs, model).toPandas()
    assert (found.predicted == (found.doc_id % 3 != 0)).all()
    assert found.score.between(0, 1).all()


def test_edge_cases(spark, taught):
    model, _, marks = taught
    rows = [(1, None, 9.0, 1), (2, "", None, None), (None, "the house", None, 1), (4, "x " * 100_000, None, 1), (4, "x " * 100_000, None, 1)]
    found = Q.classify(spark.createDataFrame(rows, DOCS), model).collect()
    assert len(found) == 5 and all(0 <= r.score <= 1 for r in found)
    assert found[0].score == found[1].score
    empty = spark.createDataFrame([], DOCS)
    assert Q.classify(empty, model).count() == 0
    blank = Q.learn(empty, marks)
    assert Q.classify(spark.createDataFrame(rows, DOCS), blank).first().score == pytest.approx(0.5)


def test_held_out_accuracy(spark):
    from shelfledger.llm.queries import op2_quality

    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = op2_quality(spark, folder).join(labels, "doc_id").filter("held_out").toPandas()
    assert (found.quality == found.predicted).mean() >= 0.93
