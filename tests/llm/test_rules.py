import math
from fractions import Fraction

import pytest

from shelfledger.llm import rules as R

DOCS = "doc_id long, text string, lang string, kept boolean, stratum string, good int"
LABELS = "doc_id long, quality int, lang string"


def brute(text):
    text = text or ""
    spaces = " \t\n\x0b\x0c\r"
    words = "".join(" " if c in spaces else c for c in text).split(" ")
    words = [w for w in words if w]
    lines = [x for x in text.split("\n") if x.strip(spaces)]
    grams = [tuple(words[k : k + 8]) for k in range(len(words) - 7)]
    covered = {k + j for k, g in enumerate(grams) if grams.count(g) > 1 for j in range(8)}
    return (
        len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"),
        len(lines), len(lines) - len(set(lines)), sum(a == b for a, b in zip(words, words[1:])), len(covered),
    )


TEXTS = [
    None, "", " \t ", "one", "a a a a a a a a a a a a", "l1\nl1\n \n\nl1 \nl2", "# 1 | <b> 100% $&*",
    "a b c d e f g h x a b c d e f g h y b c d e f g h x", "é ü ñ\x0bz\x0cq\r\nw", "w " * 5000 + "end",
    "1 2 3 4 5 6 7 8 " * 3 + "9 1 2 3 4 5 6 7 8",
]


def test_statistics_equal_brute_force(spark):
    docs = spark.createDataFrame([(k, t, "en", None, "", 0) for k, t in enumerate(TEXTS) if t is None or len(t) < 5000], DOCS)
    found = R.statistics(docs).collect()
    for r in found:
        got = (r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_stutters, r.n_repeat_words)
        assert got == brute(TEXTS[r.doc_id]), TEXTS[r.doc_id]


def test_long_repetitive_text(spark):
    docs = spark.createDataFrame([(1, "w " * 20_000 + "end", "en", None, "", 0)], DOCS)
    assert R.statistics(docs).first().n_repeat_words == 20_000


def test_binomial_tail_is_exact(spark):
    cases = [(0, 10), (3, 10), (10, 10), (7, 400), (0, 5000), (90, 5000), (0, 0)]
    p = Fraction(1, 80)
    rows = spark.createDataFrame(cases, "x long, n long")
    found = rows.select("x", "n", R.binomial_tail(rows.x, rows.n, float(p)).alias("t")).collect()
    for r in found:
        exact = sum(math.comb(r.n, k) * p**k * (1 - p) ** (r.n - k) for k in range(r.x + 1))
        assert r.t == pytest.approx(float(exact), rel=1e-9)


def test_cutoffs_are_the_strictest_proven_ones(spark):
    # 1000 good documents, share k / 10 per thousand: cutoff c rejects those above it.
    rows = [("en", True, k // 10, 0, 0, 0) for k in range(1000)] + [("de", True, 0, 0, 0, 0)] * 50
    schema = "stratum string, good boolean, " + ", ".join(f"{r} long" for r in R.RULES)
    control = R.Control(cutoffs=(0, 50, 90, 98, 99), risk=0.2, error=0.05)
    found = {r.stratum: r for r in R.proven_cutoffs(spark.createDataFrame(rows, schema), control).collect()}
    level, risk = 0.05 / 8, 0.05

    def proven(x, n):
        return sum(math.comb(n, k) * risk**k * (1 - risk) ** (n - k) for k in range(x + 1)) <= level

    passed = [c for c in control.cutoffs if proven(sum(k // 10 > c for k in range(1000)), 1000)]
    assert found["en"].symbol_share_cutoff == min(passed) == 98
    assert not proven(0, 50) and "de" not in found


def test_edge_cases(spark):
    rows = [(k, t, None if k % 2 else "en", True, "x", 9) for k, t in enumerate(TEXTS)]
    rows += [(None, "w", None, True, "", 0), (3, "one", "en", True, "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    labels = spark.createDataFrame([(1, 1, ""), (1, 0, ""), (None, 1, ""), (2, None, "")], LABELS)
    found = R.judge(docs, labels).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.kept == (not r.base_failed)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
    assert R.judge(spark.createDataFrame([], DOCS), labels).count() == 0


def test_labels_without_a_document_take_no_place_in_the_proof(spark):
    text = " ".join(f"w{k}" for k in range(30))
    docs = spark.range(400).selectExpr("id AS doc_id", f"concat('{text} ', id) AS text", "'en' AS lang")
    labels = spark.range(60_000).selectExpr("id AS doc_id", "1 AS quality")
    found = R.judge(docs, labels).collect()
    assert len(found) == 400 and {r.symbol_share_cutoff for r in found} == {0}  # 349 good ones prove it


def test_given_tables_equal_sql(spark):
    from shelfledger.llm.queries import op9_quality_rules
    from tests.oracle import compare, connect

    class Query:
        frame = staticmethod(op9_quality_rules)
        oracle = staticmethod(R.oracle)

    folder = "/root/testdata/sf0.01"
    n, problems = compare(spark, folder, Query, connect(folder))
    assert n and not problems


def test_few_good_documents_are_rejected(spark):
    from shelfledger.llm.queries import op9_quality_rules

    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    found = op9_quality_rules(spark, folder).join(labels, "doc_id").filter("NOT base_failed").toPandas()
    rate = (~found[found.quality == 1].kept).groupby(found.stratum).mean()
    assert (rate <= R.RISK).all()
    assert (~found[found.quality == 0].kept).mean() > 0.5


def test_copies_of_a_text_are_one_trial(spark):
    text = " ".join(f"w{k}" for k in range(30))
    copies = spark.range(600).selectExpr("id AS doc_id", f"'{text}' AS text", "'en' AS lang")
    labels = spark.range(600).selectExpr("id AS doc_id", "1 AS quality")
    assert {r.symbol_share_cutoff for r in R.judge(copies, labels).collect()} == {None}
    texts = copies.selectExpr("doc_id", "concat(text, ' ', doc_id div 2) AS text", "lang")  # 300 texts, twice each
    split = labels.selectExpr("doc_id", "cast(doc_id % 2 AS int) AS quality")  # both labels for each text
    assert {r.symbol_share_cutoff for r in R.judge(texts, split).collect()} == {None}
    assert {r.symbol_share_cutoff for r in R.judge(texts.union(texts), labels).collect()} == {None}
    many = copies.selectExpr("doc_id", "concat(text, ' ', doc_id) AS text", "lang")
    assert {r.symbol_share_cutoff for r in R.judge(many, labels).collect()} == {0}
