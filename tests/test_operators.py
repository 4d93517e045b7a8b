"""Structured queries, text, vectors, hybrid search, structures and the store, against small brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandix.errors import EngineError
from strandix.functions import text as tx
from strandix.operators import convergence as cv
from strandix.operators import hybrid as hy
from strandix.operators import lexical as lx
from strandix.operators import structured as sq
from strandix.operators import structures as st
from strandix.operators import vectors as vx
from strandix.sources.store import Store, digest_of
from strandix.sources.tables import read_lines, stream_lines
from strandix.types import canonical_json


def rows(df):
    return [tuple(r) for r in df.collect()]


# -- structured


def test_missing_and_null_and_two_valued_not(spark):
    df = spark.createDataFrame([(1, '{"x": 1}'), (2, '{"x": null}'), (3, "{}")], "id long, doc string")
    x = sq.json_field("doc", "x", "bigint")
    get = lambda f: [r[0] for r in df.filter(sq.condition(f)).orderBy("id").collect()]
    assert get(sq.Exists(x)) == [1, 2]
    assert get(sq.Compare(x, "!=", 1)) == [2]
    assert get(sq.Not(sq.Compare(x, "=", 1))) == [2, 3]
    assert get(sq.Compare(x, "=", None)) == [2]
    assert get(sq.All(())) == [1, 2, 3] and get(sq.Any(())) == []


def test_cursor_pages_cover_everything_once(spark):
    r = random.Random(3)
    data = [(i, r.choice([None, 1, 2, 3]), r.randint(0, 2)) for i in range(60)]
    df = spark.createDataFrame(data, "k long, a int, b int")
    for desc, first in ((False, False), (True, True)):
        q = sq.Query(sorts=[sq.Sort("a", desc, first), sq.Sort("b", not desc)], limit=7)
        seen, cursor = [], None
        while True:
            page, cursor = sq.page_with_cursor(df, sq.Query(sorts=q.sorts, limit=7, cursor=cursor), "k")
            seen += [x["k"] for x in page]
            if cursor is None:
                break
        null = -1 if first else 1
        key = lambda x: ((null if x[1] is None else 0), (0 if x[1] is None else (-x[1] if desc else x[1])), (x[2] if desc else -x[2]), x[0])  # noqa: E731,B023
        assert seen == [x[0] for x in sorted(data, key=key)]


def test_aggregates_of_nothing(spark):
    df = spark.createDataFrame([], "k long, v long")
    m = [sq.Metric("n", "count"), sq.Metric("s", "sum", sq.field_of("v"))]
    assert rows(sq.aggregate(df, sq.Query(metrics=m))) == [(0, None)]
    assert rows(sq.aggregate(df, sq.Query(metrics=m, groups=["k"]))) == []


def test_sum_beyond_64_bits(spark):
    df = spark.createDataFrame([(2**62,)] * 4, "v long")
    assert rows(sq.aggregate(df, sq.Query(metrics=[sq.Metric("s", "sum", sq.field_of("v"))])))[0][0] == 2**64


def test_limits_give_no_partial_result(spark):
    with pytest.raises(EngineError, match="LIM003"):
        sq.within(spark.range(11), 10, "rows")
    with pytest.raises(EngineError, match="LIM003"):
        sq.page(spark.range(3).toDF("k"), sq.Query(limit=5000), "k")


def test_tagged_order(spark):
    df = spark.range(1).select(F.array_sort(F.array(sq.tagged(F.lit("a"), "string"), sq.tagged(F.lit(5), "integer"), sq.tagged(F.lit(True), "boolean"), sq.tagged(F.lit(None).cast("string"), "string"))).alias("x"))
    assert [t["tag"] for t in df.first()["x"]] == [0, 1, 2, 3]


# -- text


def test_analyzer(spark):
    df = spark.createDataFrame([("Straße ＨＥＬＬＯ café ①",), ("a" * 257 + " ok",)], "t string")
    got = rows(df.select(tx.tokens(tx.fold(F.col("t")))))
    assert got[0][0] == ["strasse", "hello", "café", "1"] and got[1][0] == ["ok"]
    assert [tuple(p) for p in df.select(tx.positions(tx.fold(F.col("t")))).collect()[1][0]] == [("ok", 1)]


def test_bm25_by_hand(spark):
    docs = {1: "rust database engine", 2: "rust field guide rust", 3: "garden tools"}
    a = lx.analyzed(spark.createDataFrame(list(docs.items()), "doc_id long, text string"))
    got = dict(rows(lx.bm25(a, "Rust engine", 10)))
    toks = {k: v.split() for k, v in docs.items()}
    avg = sum(map(len, toks.values())) / 3
    for k, t in toks.items():
        want = 0.0
        for q in ("engine", "rust"):
            df = sum(q in x for x in toks.values())
            tf = t.count(q)
            want += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(t) / avg)) if tf else 0
        assert got.get(k, 0) == pytest.approx(want)
    assert rows(lx.bm25(a, "...", 10)) == [] and lx.retrieve(a, "zzz", 3).reason == "no_candidates"


def test_boolean_search(spark):
    a = lx.analyzed(spark.createDataFrame([(1, "rust storage engine"), (2, "rust search storage"), (3, "durable searching")], "doc_id long, text string"))
    q = lx.Bool(must=(lx.Term("RUST"),), should=(lx.Phrase("rust storage"), lx.StartsWith("stor"), lx.Fuzzy("enginr", 1)), must_not=(lx.Term("search"),))
    assert rows(lx.boolean_search(a, q, 10)) == [(1, 4)]
    with pytest.raises(EngineError, match="LEX002"):
        lx.boolean_search(a, lx.Term("two words"), 5)


@pytest.mark.parametrize("pattern,yes,no", [("a*c", ["ac", "abc", "a\nc"], ["ab", "xac"]), ("a?c", ["abc"], ["ac"]), ("[a-c]x", ["bx"], ["dx", "-x"]), ("[^a]x", ["bx"], ["ax"]), ("[!a]x", ["!x", "ax"], ["bx"]), ("a\\*b", ["a*b"], ["axb"]), ("a.b", ["a.b"], ["axb"]), ("[]a]", ["]", "a"], ["b"])])
def test_globs(spark, pattern, yes, no):
    df = spark.createDataFrame([(x,) for x in yes + no], "x string")
    assert sorted(r[0] for r in df.filter(tx.glob(F.col("x"), pattern)).collect()) == sorted(yes)


# -- vectors


@pytest.fixture(scope="module")
def vectors(spark):
    r = random.Random(5)
    return spark.createDataFrame([(i, [r.gauss(0, 1) for _ in range(8)]) for i in range(200)], "vec_id long, embedding array<float>")


def test_cells_are_exact(spark, vectors):
    for metric in ("l2", "cosine"):
        index = vx.build_cells(vectors, metric, cells=9)
        q = [0.3 * i - 1 for i in range(8)]
        hits, receipt = vx.search_cells(index, q, 7)
        truth = rows(vx.exact(vectors, q, metric, 7))
        assert [h[0] for h in hits] == [t[0] for t in truth] and receipt["certified"]
        assert [h[1] for h in hits] == pytest.approx([t[1] for t in truth], abs=1e-6)
    few = vectors.filter("vec_id < 20").select("vec_id")
    assert [h[0] for h in vx.filtered_search(vx.build_cells(vectors), q, 5, few)[0]] == [r[0] for r in rows(vx.exact(vectors, q, "l2", 5, few))]


def test_abstention_order():
    hits = [(1, 0.9), (2, 0.89), (3, 0.1)]
    assert vx.abstaining([], 0.5, 0.1, 2)[0] == "no_candidates"
    assert vx.abstaining(hits, 0.95, 0.5, 2)[0] == "below_threshold"
    assert vx.abstaining(hits, 0.5, 0.1, 2)[0] == "ambiguous"
    assert vx.abstaining(hits, 0.5, 0.0, 3) == ("matches", hits)


def test_fixed_point_and_errors(vectors):
    assert vx.q15_nanos([3, 4], [3, 4]) == 10**9 and vx.q15_nanos([1, 0], [0, 1]) == 0
    with pytest.raises(EngineError, match="VEC002"):
        vx.distance("cosine", F.col("embedding"), [0.0] * 8)
    assert vx.recall_ppm([1, 2], [1, 3]) == 500_000 and vx.recall_ppm([], []) == 1_000_000


# -- hybrid


def test_integer_fusion(spark):
    a = spark.createDataFrame([(1, 1), (2, 2)], "id long, a long")
    b = spark.createDataFrame([(2, 1), (3, 2)], "id long, b long")
    got = [(r["id"], r["score_nanos"]) for r in hy.fuse_int({"a": a, "b": b}, {"a": 1, "b": 1}, 10).collect()]
    one, two = 10**9 // 61, 10**9 // 62
    assert got == [(2, one + two), (1, one), (3, two)]


def test_lexical_branch_keeps_its_unfiltered_rank(spark):
    docs = spark.createDataFrame([(1, "rust rust rust", "gear"), (2, "rust rust", "book"), (3, "rust", "book")], "id long, text string, category string")
    a = lx.analyzed(docs, doc="id")
    s = hy.Search("rust", filter=sq.Compare(sq.field_of("category"), "=", "book"), facets={"category": 5})
    found = hy.integrated(docs.drop("text"), a, s)
    assert [(r["id"], r["score"]) for r in found.hits.collect()] == [(2, pytest.approx(1 / 62)), (3, pytest.approx(1 / 63))]
    assert rows(found.facets["category"]) == [("book", 2)]
    plain = hy.integrated(docs.drop("text"), None, hy.Search(limit=2))
    assert [(r["id"], r["score"]) for r in plain.hits.collect()] == [(1, 0.0), (2, 0.0)]


# -- convergence


def test_convergence(spark):
    a = spark.createDataFrame([(1, "1.5"), (2, "2"), (3, "x")], "object_id long, value string")
    b = spark.createDataFrame([(2, 4.0), (1, 3.0)], "object_id long, value double")
    got = cv.converge([cv.Source("a", a, "bytes"), cv.Source("b", b, "distance")])
    assert rows(got.rows) == [(1, "1.5", -3.0), (2, "2", -4.0)]
    assert rows(cv.aggregate(got.rows, ["a", "b"], ("a",))) == [(2, 3.5, 1.5, 2.0, 2, -7.0, -4.0, -3.0)]
    with pytest.raises(EngineError, match="CNV003"):
        cv.converge([cv.Source("a", a.union(a), "bytes")])
    with pytest.raises(EngineError, match="CNV002"):
        cv.converge([cv.Source("a", a, "bytes", cap=2)])


# -- structures


def test_hash_life(spark):
    log = [("h", 1, "create", None, None, None), ("h", 2, "put", "a", "1", None), ("h", 3, "put", "b", "2", 50), ("h", 4, "delete", None, None, None), ("h", 5, "create", None, None, None), ("h", 6, "put", "b", "3", 50), ("h", 7, "put", "c", "4", None), ("h", 8, "remove", "c", None, None), ("e", 9, "create", None, None, None)]
    df = spark.createDataFrame(log, "key string, seq long, op string, field string, value string, expiry long")
    assert rows(st.fold_members(df, 49)) == [("h", "b", "3", 50)] and rows(st.fold_members(df, 50)) == []
    assert sorted(rows(st.cardinality(st.headers(df, 49), st.fold_members(df, 49)))) == [("e", 0), ("h", 1)]


def test_lists_against_deques(spark):
    from collections import deque

    r = random.Random(4)
    ops = [("k", i, r.choice(["lpush", "rpush", "rpush", "lpop", "rpop"]), str(i)) for i in range(80)]
    held, popped = deque(), {}
    for _, i, op, v in ops:
        if op == "lpush":
            held.appendleft(v)
        elif op == "rpush":
            held.append(v)
        else:
            popped[i] = (held.popleft() if op == "lpop" else held.pop()) if held else None
    got = st.fold_list(spark.createDataFrame(ops, "key string, seq long, op string, value string")).persist()
    assert dict((r["pos"], r["value"]) for r in got.filter("popped").collect()) == popped
    state = got.filter("NOT popped")
    assert [r["value"] for r in state.orderBy("pos").collect()] == list(held)
    full = list(held)
    for start, stop in ((0, -1), (1, 2), (-3, -2), (5, 2), (-100, 100)):
        got_range = [r["value"] for r in st.l_range(state, start, stop).orderBy("index").collect()]
        lo, hi = (start + len(full) if start < 0 else start), (stop + len(full) if stop < 0 else stop)
        assert got_range == full[max(0, lo) : hi + 1]


def test_conditional_sets(spark):
    ops = [("k", 1, "set", "a", None, "NX", 1), ("k", 2, "set", "b", None, "NX", 2), ("k", 3, "set", "c", 10, "XX", 3), ("k", 4, "set", "d", None, "XX", 10), ("k", 5, "set", "e", None, "NX", 11), ("m", 6, "set", "x", None, "XX", 1)]
    df = spark.createDataFrame(ops, "key string, seq long, op string, value string, expiry long, when string, at long")
    assert rows(st.fold_conditional(df)) == [("k", "e", None)]


def test_sorted_sets_and_ranges(spark):
    z = spark.createDataFrame([("z", m, s) for m, s in (("a", 2.0), ("b", 1.0), ("c", 2.0), ("d", 3.0))], "key string, member string, score double")
    assert [r[0] for r in rows(st.z_range(z, "z", 0, -1))] == ["b", "a", "c", "d"]
    assert [r[0] for r in rows(st.z_range(z, "z", 0, 1, True))] == ["d", "c"]
    assert rows(st.z_range(z, "z", 3, 1)) == []
    assert [r[0] for r in rows(st.z_range_by_score(z, "z", 2.0, 2.0))] == ["a", "c"]
    assert rows(st.z_range_by_score(z, "z", 2.0, 2.0, high_open=True)) == []


def test_counters(spark):
    df = spark.createDataFrame([("5",), (None,), ("-3",)], "v string")
    assert [r[0] for r in rows(df.select(st.counter(F.col("v"))))] == [5, 0, -3]
    for bad in ("+1", "01", "-0", " 1"):
        with pytest.raises(Exception, match="not an integer"):
            rows(spark.createDataFrame([(bad,)], "v string").select(st.counter(F.col("v"))))


def test_expire_due_and_scan_match(spark):
    h = spark.createDataFrame([("a", 5), ("b", 3), ("c", 9), ("d", None)], "key string, expiry long")
    gone, left, more = st.expire_due(h, 5, 1)
    assert rows(gone) == [("b", 3)] and more and sorted(r[0] for r in rows(left)) == ["a", "c", "d"]
    f = spark.createDataFrame([("h", f"f{i}", None if i % 2 else 1) for i in range(6)], "key string, field string, expiry long")
    m = st.scan_match(f, "h", "f*", 5, 2, 10)
    assert [r["field"] for r in m.rows] == ["f1", "f3"] and m.cursor == "f3" and m.stop == "output"
    assert st.scan_match(f, "h", "f*", 5, 9, 2).stop == "visit" and st.scan_match(f, "h", "f1", 5, 9, 9).cursor is None


# -- store, lines, JSON


def test_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"))
    one = s.commit({"t": spark.range(3)})
    two = s.upsert("t", spark.range(2, 5), "id")
    assert (one, two) == (1, 2) and s.table("t").count() == 5 and s.table("t", 1).count() == 3
    batch = spark.range(10, 12)
    three = s.upsert("t", batch, "id", "r1", digest_of(batch))
    assert s.upsert("t", batch, "id", "r1", digest_of(batch)) == three
    with pytest.raises(EngineError, match="ING001"):
        s.upsert("t", batch, "id", "r1", "other")
    with pytest.raises(EngineError, match="ING002"):
        s.upsert("t", batch.union(batch), "id")
    with pytest.raises(EngineError, match="TXN001"):
        s.commit({"t": spark.range(1)}, one)
    assert s.delete("t", spark.range(2), "id") == 4 and s.table("t").count() == 5
    s.backup(str(tmp_path / "b"))
    other = Store(spark, str(tmp_path / "r"))
    other.restore(str(tmp_path / "b"))
    assert other.table("t").count() == 5


def test_stream_ingest(spark, tmp_path):
    from strandix.streaming.ingest import ingest

    for k in range(3):
        spark.range(10 * k, 10 * k + 12).selectExpr("id", f"{k} AS v").write.mode("append").parquet(str(tmp_path / "in"))
    s = Store(spark, str(tmp_path / "s"))
    stream = spark.readStream.schema("id long, v int").option("maxFilesPerTrigger", 4).parquet(str(tmp_path / "in"))
    for _ in range(2):
        q = ingest(stream, s, "t", "id", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert s.table("t").count() == 32


def test_lines_need_an_end(spark):
    lines = list(stream_lines(spark.range(3)))
    assert read_lines(iter(lines)) == [{"id": 0}, {"id": 1}, {"id": 2}]
    with pytest.raises(EngineError, match="SRC002"):
        read_lines(iter(lines[:-1]))


def test_canonical_json():
    assert canonical_json('{"b": 1, "a": [1, "é"]}') == '{"a":[1,"é"],"b":1}'
    for bad in ('{"a": 1, "a": 2}', "NaN", "{"):
        with pytest.raises(EngineError, match="SQL006"):
            canonical_json(bad)


def test_fixed_point_scores_equal_integers(spark):
    r = random.Random(1)
    q = [r.randint(-32767, 32767) for _ in range(16)]
    made = [v for m in (1, 5, 300, 32767) for _ in range(50) if any(v := [r.randint(-m, m) for _ in range(16)])] + [q, [-x for x in q]]
    df = spark.createDataFrame([*enumerate(made), (9998, None), (9999, [1])], "vec_id long, q15 array<int>")
    assert {x["id"]: x["score_nanos"] for x in vx.retrieve_q15(df, q, 1000).collect()} == {i: vx.q15_nanos(v, q) for i, v in enumerate(made)}
    for bad in ([0] * 16, [40_000] + [0] * 15):
        with pytest.raises(Exception, match="zero vector|out of range"):
            vx.retrieve_q15(spark.createDataFrame([(1, bad)], "vec_id long, q15 array<int>"), q, 5).collect()
