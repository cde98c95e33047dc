import pytest

import corpus_pipeline as C
from shelfledger.llm import decontamination, language, sentencepiece, simhash
from shelfledger.llm.queries import VOCABULARY

FOLDER = "/root/testdata/sf0.001"


def run_stages(spark, docs, folder):
    out = [docs]
    for _, stage in C.STAGES:
        frame = stage(spark, out[-1], folder)
        rows = frame.collect()
        out.append(spark.createDataFrame(rows, frame.schema))
    return out


@pytest.fixture(scope="module")
def stages(spark):
    return run_stages(spark, spark.read.parquet(f"{FOLDER}/documents.parquet"), FOLDER)


def test_all_but_the_last_return_documents(stages):
    for frame in stages[1:-1]:
        assert frame.columns == stages[0].columns


def test_decisions_take_effect(stages):
    docs, labelled, distinct, clean, private, encoded = [f.toPandas() for f in stages]
    assert set(labelled.doc_id) <= set(docs.doc_id) and len(labelled) >= 0.99 * len(docs)
    found = simhash.near_duplicates(stages[1]).toPandas()
    assert sorted(distinct.doc_id) == sorted(found.component_id.unique())
    hits = decontamination.contaminated(stages[2], stages[2].sparkSession.read.parquet(f"{FOLDER}/benchmark.parquet"))
    assert set(clean.doc_id) == set(distinct.doc_id) - {r.doc_id for r in hits.collect()}
    assert sorted(private.doc_id) == sorted(clean.doc_id) == sorted(encoded.doc_id)
    assert (private.n_chars == private.text.str.len()).all()
    assert encoded.decodes.all()
    vocabulary = sentencepiece.load(VOCABULARY)
    text = dict(zip(private.doc_id, private.text))
    for r in encoded.itertuples():
        assert sentencepiece.decoded(list(r.ids), vocabulary) == text[r.doc_id]


def test_run_equals_the_stages(spark, stages):
    got = {r.doc_id: r.ids for r in C.run(spark, FOLDER).collect()}
    assert got == {r.doc_id: r.ids for r in stages[-1].collect()}


def test_evenly_mixed_documents_stay(spark, stages):
    texts = {}
    for r in stages[0].orderBy("doc_id").collect():
        if r.lang and r.text and len(r.text) > 400:
            texts.setdefault(r.lang, r.text[:400])
    assert len(texts) >= 3
    mixed = spark.createDataFrame([(-1, " ".join(texts.values()), "en", "s", 1)], stages[0].schema)
    model = language.learn(stages[0])
    assert model.predict([" ".join(texts.values())]).score[0] < 0.4
    kept = C.language_id(spark, stages[0].union(mixed), FOLDER)
    assert kept.filter("doc_id = -1").count() == 1


def test_edge_cases(spark, stages):
    schema = stages[0].schema
    rows = [(1, None, "en", "s", 0), (2, "", None, None, None), (None, "the and with that for was in the", "en", None, 3)]
    rows += [(4, "the of and to in is that " * 3000, "en", "s", 1)] * 2 + [(5, "1234 | 99", "en", "s", 9)]
    out = run_stages(spark, spark.createDataFrame(rows, schema), FOLDER)
    assert sorted(str(r.doc_id) for r in out[-1].collect()) == ["4", "None"]
    empty = run_stages(spark, spark.createDataFrame([], schema), FOLDER)
    assert empty[-1].count() == 0
