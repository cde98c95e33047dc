from shelfledger.llm import chat as C

SAID = "conv_id long, turn long, role string, text string, segment string, perspective string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], SAID)


def test_every_participant_becomes_the_assistant(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "ann", "Hi"), (1, 2, "bob", "Hello"), (1, 3, "ann", "Bye")]
    found = {r.perspective: r for r in C.dialogues(C.rotate(frame(spark, rows))).collect()}
    assert set(found) == {"ann", "bob"}
    ann = found["ann"]
    assert ann.text == (
        "<|im_start|>system\nBe kind.<|im_end|>\n<|im_start|>assistant\nHi<|im_end|>\n"
        "<|im_start|>user name=bob\nHello<|im_end|>\n<|im_start|>assistant\nBye<|im_end|>\n"
    )
    assert [ann.text[s.start : s.end] for s in ann.spans] == ["Hi<|im_end|>", "Bye<|im_end|>"]
    bob = found["bob"]
    assert [bob.text[s.start : s.end] for s in bob.spans] == ["Hello<|im_end|>"]
    assert "user name=ann\nHi" in bob.text


def test_each_turn_is_trained_in_exactly_one_perspective(spark):
    rows = [(c, t, f"s{(c + t) % 4}", f"text {t}") for c in range(5) for t in range(9)]
    found = C.rotate(frame(spark, rows)).toPandas()
    assert len(found) == 5 * 9 * 4
    assert (found.groupby(["conv_id", "turn"]).train.sum() == 1).all()


def test_edge_cases(spark):
    rows = [
        (1, 0, "user", None), (1, None, "user", ""), (1, 2, None, "a<|im_end|>b"), (1, 2, None, "a<|im_end|>b"),
        (2, 0, "system", "alone"), (None, 0, "x y", "é" * 100_000),
    ]
    found = C.rotate(frame(spark, rows)).collect()
    assert len(found) == 4 * 2 + 1
    assert {r.perspective for r in found} == {"user", "unknown", "x y"}
    assert not any("a<|im_end|>b" in r.segment for r in found)
    lone = next(r for r in found if r.conv_id is None)
    assert lone.train and lone.segment[lone.train_start : lone.train_end] == "é" * 100_000 + C.END
    named = next(r for r in found if r.perspective == "user" and r.name == "unknown")
    assert named.role == "user" and named.train_end == 0
    assert C.rotate(frame(spark, [])).count() == 0


def test_speakers_never_share_a_name(spark):
    who = ["a b", "a_b", "a  b", "a|b", "a_b#0", None, "unknown", "unknown#", " a_b ", "x"]
    rows = [(1, k, w, "t") for k, w in enumerate(who)]
    found = C.rotate(frame(spark, rows)).toPandas()
    assert found.perspective.nunique() == 9  # " a_b " is a_b
    seen = found[(found.perspective == "x") & (found.role == "user")]
    assert seen.name.nunique() == 8 and "a_b" in set(seen.name)
    assert not seen.name.str.contains(r"[\s<>|]").any()


def test_given_table_equals_sql(spark):
    from shelfledger.llm.queries import op6_chat_perspectives
    from tests.oracle import compare, connect

    class Query:
        frame = staticmethod(op6_chat_perspectives)
        oracle = staticmethod(C.oracle)

    folder = "/root/testdata/sf0.01"
    n, problems = compare(spark, folder, Query, connect(folder))
    assert n and not problems


def test_names_equal_sql(spark, tmp_path):
    import duckdb

    who = ["a b", "a_b", "a|b", "a_b#0", None, "unknown", "unknown#", "", "é x"]
    rows = frame(spark, [(1, k, w, "t<|x") for k, w in enumerate(who)])
    rows.toPandas().to_parquet(tmp_path / "c.parquet")
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c.parquet'")
    found = C.rotate(rows)
    expected = connection.sql(C.oracle()).select(*found.columns).fetchall()
    assert sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))
