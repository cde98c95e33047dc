import itertools
import math

import numpy as np
import pytest

from shelfledger.llm import language as L

SCHEMA = "doc_id long, text string, lang string, lang_pred string, score double"


def brute_marginals(scores, start, trans):
    n, k = scores.shape
    total, out = 0.0, np.zeros((n, k))
    for path in itertools.product(range(k), repeat=n):
        weight = start[path[0]] + scores[range(n), path].sum()
        weight += sum(trans[a, b] for a, b in zip(path, path[1:]))
        weight = math.exp(weight)
        total += weight
        for t, y in enumerate(path):
            out[t, y] += weight
    return out / total


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lengths = np.array([5, 3, 3, 1])
    starts = np.cumsum(lengths) - lengths
    scores, start, trans = rng.normal(size=(12, 3)), rng.normal(size=3), rng.normal(size=(3, 3))
    found, _, _ = L.forward_backward(scores, starts, lengths, start, trans)
    for at, n in zip(starts, lengths):
        assert np.allclose(found[at : at + n], brute_marginals(scores[at : at + n], start, trans))


@pytest.fixture(scope="module")
def model():
    en = "the house and the garden with that thing is here for them"
    de = "das haus und der garten mit dem ding ist hier für sie"
    words = {"en": en.split(), "de": de.split()}
    rng = np.random.default_rng(1)
    samples = [(" ".join(rng.choice(words[k], 30)), k) for k in ("en", "de") for _ in range(40)]
    return L.fit(samples)


def test_code_switched_words_get_their_own_labels(model):
    words = "the house and the garden das haus und der garten".split()
    marginals = model.label([words])[0]
    assert [model.labels[k] for k in marginals.argmax(axis=1)] == ["en"] * 5 + ["de"] * 5


def test_labels_do_not_depend_on_the_batch(model):
    texts = [["the"] * 50, ["das", "haus"], [], ["garden"]]
    together = model.label(texts)
    for text, marginals in zip(texts, together):
        assert np.allclose(model.label([text])[0], marginals)


def test_all_letters_of_a_long_run_count(model):
    run = "dashausundder" * 4 + "thehouseandthegardenwiththatthing" * 20 + "und"
    assert len("dashausundder" * 4) > 40
    assert model.predict([run]).lang[0] == "en"


def test_long_words_are_scored_like_others(model, monkeypatch):
    run = "thehouseanddashausundder" * 9
    plain = model.emissions([run, "the"])
    monkeypatch.setattr(L, "PIECE_LETTERS", 7)
    again = L.Model(model.labels, model.features, model.weights, model.start, model.transitions, model.lexicon)
    assert np.allclose(again.emissions([run, "the"]), plain)


def test_edge_cases(spark, model):
    rows = [(1, None, "x", "clash", 0.0), (2, "", None, None, None), (3, "12 | 3!", "en", "", 1.0)]
    rows += [(None, "the garden and the house", "en", "", 1.0), (5, "das Haus und DER Garten", None, "", 1.0)]
    rows += [(5, "das Haus und DER Garten", None, "", 1.0), (6, "the house " * 20_000, "en", "", 1.0)]
    found = L.identify(spark.createDataFrame(rows, SCHEMA), model).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == len(rows)
    assert [by_id[k].lang_pred for k in (1, 2, 3)] == ["und"] * 3
    assert by_id[None].lang_pred == "en" and by_id[5].lang_pred == "de"
    assert by_id[6].lang_pred == "en" and by_id[6].n_words == 40_000
    assert all(0 <= r.score <= 1 for r in found)
    assert by_id[1].score == 0 and abs(sum(by_id[5].shares.values()) - 1) < 1e-9


def test_empty_tables(spark, model):
    empty = spark.createDataFrame([], SCHEMA)
    assert L.identify(empty, model).count() == 0
    untaught = L.learn(empty)
    docs = spark.createDataFrame([(1, "the house", None, None, None)], SCHEMA)
    assert L.identify(docs, untaught).first().lang_pred == "und"


def test_held_out_accuracy(spark):
    from shelfledger.llm.queries import op1_language_id

    folder = "/root/testdata/sf0.001"
    truth = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang")
    found = op1_language_id(spark, folder).join(truth, "doc_id").filter("held_out").toPandas()
    assert len(found) > 40
    assert (found.lang == found.lang_pred).mean() >= 0.95
