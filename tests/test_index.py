"""The stored index through its life, marks in words, and statements of great depth."""

import pytest
from pyspark.sql import functions as F

from strandix.errors import EngineError
from strandix.functions.text import query_terms, query_tokens
from strandix.operators import lexical as lx
from strandix.operators import structures as st
from strandix.operators import vectors as vx
from strandix.operators.inverted import TextIndex
from strandix.plans.sql_parser import parse


def plain(df):
    return [(r["doc_id"], round(r["score"], 9)) for r in df.collect()]


def test_index_through_insert_replace_and_delete(spark, tmp_path):
    rows = {1: "rust search engine", 2: "Rust rust guide", 3: None, 4: "", 5: "हिन्दी search straße", 6: "x " * 300}
    frame = lambda d: spark.createDataFrame([*d.items()], "doc_id long, text string")

    def same(index, docs):
        for q in ("search RUST nothing", "हिन्दी STRASSE x"):
            assert plain(index.bm25(q, 10)) == plain(lx.bm25(lx.analyzed(frame(docs)), q, 10)), q

    one = TextIndex(spark, str(tmp_path / "i")).index(frame(rows))
    same(one, rows)
    more = {2: "guide only", 7: "rust", 8: "search search"}
    two = one.index(frame(more))
    same(two, rows | more)
    three = two.delete(frame({1: None, 8: None, 99: None}))
    left = {i: t for i, t in (rows | more).items() if i not in (1, 8)}
    same(three, left)
    same(three.replace(frame({1: "rust again"})), left | {1: "rust again"})
    same(three.consolidated(), left)
    same(one, rows)  # earlier states stay
    allow = spark.createDataFrame([(7,)], "doc_id long")
    assert [i for i, _ in plain(two.bm25("rust", 5, allow))] == [7] and two.bm25("", 5).count() == 0
    assert {r["doc_id"] for r in three.documents().collect()} == set(left)
    none = TextIndex(spark, str(tmp_path / "e")).index(frame(rows).limit(0))
    assert none.bm25("rust", 3).count() == 0
    with pytest.raises(EngineError):
        TextIndex(spark, str(tmp_path / "n")).documents()


def test_marks_belong_to_words():
    assert query_tokens("हिन्दी") == ["हिन", "दी"]  # vowel signs are alphabetic, the virama is not
    assert query_terms("தமிழ் தமிழ்") == ["தமிழ"] and query_tokens("of the_of") == ["of", "the", "of"]


def test_no_vector_is_near_that_is_none(spark):
    nan, inf = float("nan"), float("inf")
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [1.0]), (4, [nan, 0.0]), (5, [inf, 0.0]), (6, [0.0, 0.0]), (7, [None, 1.0])], "id long, v array<float>")
    for metric, want in (("l2", [1, 6]), ("cosine", [1]), ("dot", [1, 6])):
        assert [r["id"] for r in vx.exact(v, [1.0, 0.0], metric, 9, vid="id", col="v").collect()] == want
        q = spark.createDataFrame([(9, [1.0, 0.0])], "query_id long, v array<float>")
        assert [r["id"] for r in vx.batch_exact(v, q, metric, 9).orderBy("rank").collect()] == want
    assert vx.batch_exact(v, q.limit(0), "l2", 3).count() == 0
    with pytest.raises(EngineError):
        vx.batch_exact(v, v.select(F.col("id").alias("query_id"), "v"), "l2", 3)


def test_depth_of_statements():
    head, tail = "SELECT id FROM t WHERE ", " LIMIT 3"
    for text in ("(" * 5000 + "a = 1" + ")" * 5000,):
        with pytest.raises(EngineError) as e:
            parse(head + text + tail)
        assert e.value.code == "SQL001"
    for text in ("NOT " * 3001 + "a = 1", " AND ".join(["a = 1"] * 3000), " OR ".join(["a = 1"] * 3000), "(" * 60 + "a = 1" + ")" * 60):
        parse(head + text + tail)


def test_field_outcomes_follow_expiry(spark):
    log = [("k", "f", 1, "put", 5, 1), ("k", "f", 2, "put", None, 4), ("k", "f", 3, "put", 9, 6), ("k", "f", 4, "put", None, 9), ("k", "f", 5, "remove", None, 10), ("k", "f", 6, "remove", None, 11), ("k", "g", 7, "remove", None, 11)]
    got = st.outcomes(spark.createDataFrame(log, "key string, field string, seq long, op string, expiry long, at long")).orderBy("seq").collect()
    assert [(r["added"], r["updated"], r["removed"]) for r in got] == [(True, False, False), (False, True, False), (False, True, False), (True, False, False), (False, False, True), (False, False, False), (False, False, False)]
