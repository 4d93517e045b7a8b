"""Lives of structures and fields, outcomes, pages and adapters, each beside a small fold in Python."""

import random

import pytest
from pyspark.sql import functions as F

from strandix.errors import EngineError
from strandix.operators import convergence as cv
from strandix.operators import pages as pg
from strandix.operators import structures as st


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_field_expiry_equals_a_fold(spark):
    r = random.Random(2)
    log, held = [], {}
    for seq in range(600):
        key, field, op = r.choice("ab"), r.choice("xyz"), r.choice(["put", "put", "remove", "expire", "expire"])
        expiry = None if op == "remove" or r.random() < 0.3 else seq + r.randint(0, 60)
        log.append((key, field, seq, seq, op, str(seq), expiry))
        now = held.get((key, field))
        alive = now is not None and (now[1] is None or now[1] > seq)
        if op == "put":
            held[key, field] = (str(seq), expiry)
        elif op == "remove":
            held.pop((key, field), None)
        elif alive:
            held[key, field] = (now[0], expiry)
    df = spark.createDataFrame(log, "key string, field string, seq long, at long, op string, value string, expiry long")
    for upto, at in ((600, 600), (600, 640), (300, 300)):
        if upto == 600:
            want = sorted((k, f, v) for (k, f), (v, e) in held.items() if e is None or e > at)
            assert rows(st.fold_expiring(df, at).select("key", "field", "value")) == want
        else:
            assert len(rows(st.fold_expiring(df.filter(F.col("seq") < upto), at))) <= 6
    assert rows(st.fold_expiring(df.limit(0), 0)) == []


def test_whole_structures_expire_and_are_made_again(spark):
    log = [("a", 1, "put", "f", 10, None), ("a", 2, "expire", None, None, 50), ("b", 3, "put", "f", 1, None), ("b", 4, "expire", None, None, 40), ("b", 5, "delete", None, None, None), ("b", 6, "put", "g", 2, None), ("c", 7, "create", None, None, 9)]
    df = spark.createDataFrame(log, "key string, seq long, op string, field string, value int, expiry long")
    assert rows(st.headers(df, 8).select("key")) == [("a",), ("b",), ("c",)]
    assert rows(st.headers(df, 45).select("key")) == [("a",), ("b",)]  # the delete ended b's expiry
    assert rows(st.live_members(df, 45).select("key", "field")) == [("a", "f"), ("b", "g")]
    assert rows(st.live_members(df, 50).select("key", "field")) == [("b", "g")]


def test_score_outcomes(spark):
    log = [("z", "m", 1, "add", 1.0), ("z", "m", 2, "add", 1.0), ("z", "m", 3, "add", 2.0), ("z", "m", 4, "remove", None), ("z", "m", 5, "remove", None), ("z", "n", 6, "add", -0.0), ("z", "n", 7, "add", 0.0)]
    df = spark.createDataFrame(log, "key string, member string, seq long, op string, score double")
    assert [r["outcome"] for r in st.z_outcomes(df).orderBy("seq").collect()] == ["added", "unchanged", "updated", "removed", "missing", "added", "unchanged"]
    assert rows(st.fold_scores(df)) == [("z", "n", 0.0)]
    with pytest.raises(Exception, match="not a number"):
        st.z_outcomes(df.withColumn("score", F.lit(float("nan")))).collect()


def test_sweep_equals_rounds_of_expire_due(spark):
    r = random.Random(4)
    header = spark.createDataFrame([(f"k{i:03}", r.choice([None, *range(9)])) for i in range(60)], "key string, expiry long")
    gone, stays = st.sweep(header, 5, 7)
    left, n, want = header, 0, []
    while True:
        due, left, more = st.expire_due(spark.createDataFrame(left.collect(), header.schema), 5, 7)
        want += [(x["key"], n) for x in due.collect()]
        n += 1
        if not more:
            break
    assert rows(gone.select("key", "round")) == sorted(want) and rows(stays.select("key")) == rows(left.select("key"))
    with pytest.raises(EngineError):
        st.sweep(header, 5, 0)


def test_pages_cover_a_relation(spark):
    r = random.Random(6)
    keys = sorted({(r.randint(0, 9), r.randint(0, 9)) for _ in range(60)})
    df = spark.createDataFrame([(*k, "v") for k in keys], "a int, b int, v string").repartition(5)
    for low, high in ((None, None), (pg.Bound((3, 2)), pg.Bound((7, 5))), (pg.Bound((3, 2), False), pg.Bound((7, 5), False))):
        want = [k for k in keys if (low is None or k > low.key or (low.included and k == low.key)) and (high is None or k < high.key or (high.included and k == high.key))]
        got, cursor = [], None
        while True:
            p = pg.page(df, ["a", "b"], 7, low, high, cursor)
            got += [(x["a"], x["b"]) for x in p.rows]
            if (cursor := p.cursor) is None:
                break
        assert got == want
    for bad in (lambda: pg.page(df, ["a", "b"], 0), lambda: pg.page_rows(df, ["a", "b"], 5, pg.Bound((1,)))):
        with pytest.raises(EngineError):
            bad()


def test_adapters_refuse_repeated_ids(spark):
    entries = spark.sql("SELECT 'k' AS key, id AS entry_id, map('f', 'v') AS fields FROM range(2)")
    with pytest.raises(EngineError):
        cv.converge([cv.stream_source("s", entries, "k")])
    twice = spark.sql("SELECT 'k' AS key, 'x' AS value FROM range(2)")
    with pytest.raises(EngineError):
        cv.converge([cv.list_source("l", twice, "k")])
    one = spark.sql("SELECT 'k' AS key, 'x' AS field, '7' AS value")
    got = cv.converge([cv.hash_source("h", one, "k"), cv.list_source("l", twice.limit(1), "k")])
    assert [tuple(r) for r in got.rows.collect()] == [("x", "7", None)] and [e["strategy"] for e in got.explain] == ["hash", "list"]


def test_counters_are_read_in_the_order_asked_for(spark):
    state = spark.createDataFrame([("a", "5"), ("b", "05")], "key string, value string")
    assert [tuple(r) for r in st.counters_of(state, ["z", "a", "z"]).collect()] == [(0, "z", 0), (1, "a", 5), (2, "z", 0)]
    with pytest.raises(Exception, match="not an integer"):
        st.counters_of(state, ["b"]).collect()


@pytest.fixture(scope="module")
def many_events(spark, tmp_path_factory):
    """Events of sets whose union, intersection and difference each have over 65,536 members, and members that are null."""
    d = str(tmp_path_factory.mktemp("many"))
    both = "SELECT id AS user_id, type AS event_type FROM range(66000) LATERAL VIEW explode(array('click', 'view', 'purchase')) t AS type"
    alone = "SELECT id + 100000, 'view' FROM range(66000)"
    empty = "SELECT CAST(NULL AS BIGINT), explode(array('click', 'view'))"
    spark.sql(f"SELECT *, TIMESTAMP_NTZ '2024-01-05 00:00:00' AS ts FROM ({both} UNION ALL {alone} UNION ALL {empty})").write.parquet(f"{d}/events.parquet")
    return d


def equals_sql(spark, d, name):
    import duckdb

    from strandix.plans import catalog_queries

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet'")
    want = {x for (x,) in duck.execute(catalog_queries.ORACLES[name]).fetchall()}
    got = [x for (x,) in catalog_queries.QUERIES[name](spark, d).collect()]
    assert len(got) == len(want) > st.SET_OUTPUT and set(got) == want
    assert got == sorted(got, key=lambda x: (x is not None, x))


def test_union_of_sets_beyond_the_ceilings_of_a_request(spark, many_events):
    equals_sql(spark, many_events, "str_set_union")
    one = spark.range(1_100_000).select(F.lit("a").alias("key"), F.col("id").alias("member"))
    assert st.set_union(one, ["a"], whole=True).count() == 1_100_000 > st.SET_VISITS
    for refused in (lambda: st.set_union(one, ["a"]), lambda: st.set_union(one, ["a"] * 65, whole=True)):
        with pytest.raises(EngineError, match="LIM010"):
            refused()


def test_difference_of_sets_beyond_the_ceilings_of_a_request(spark, many_events):
    equals_sql(spark, many_events, "str_set_difference")
    two = spark.range(1_100_000).select(F.explode(F.array(F.lit("a"), F.when(F.col("id") % 2 == 0, "b"))).alias("key"), F.col("id").alias("member"))
    assert st.set_difference(two, ["a", "b"], whole=True).count() == 550_000
    with pytest.raises(EngineError, match="LIM010"):
        st.set_difference(two, ["a", "b"])


def test_difference_of_repeated_and_missing_keys_and_null_members(spark):
    state = spark.createDataFrame([("a", 1), ("a", None), ("a", 3), ("b", None), ("b", 1), ("b", 1), (None, 3)], "key string, member int")
    for whole in (False, True):
        got = {k: [r["member"] for r in st.set_difference(state, list(k), whole).collect()] for k in ("a", "ab", "ax", "xa", "aa", "aba", "ba")}
        assert got == {"a": [None, 1, 3], "ab": [3], "ax": [None, 1, 3], "xa": [], "aa": [], "aba": [], "ba": []}


def test_intersection_of_sets_beyond_the_ceilings_of_a_request(spark, many_events):
    equals_sql(spark, many_events, "str_set_intersect")
    two = spark.range(1_100_000).select(F.explode(F.array(F.lit("a"), F.when(F.col("id") % 2 == 0, "b"))).alias("key"), F.col("id").alias("member"))
    assert st.set_intersection(two, ["a", "b", "a"], whole=True).count() == 550_000
    with pytest.raises(EngineError, match="LIM010"):
        st.set_intersection(two, ["a", "b"])


def test_intersection_of_as_many_keys_as_there_may_be(spark):
    state = spark.createDataFrame([(f"k{i}", m) for i in range(64) for m in (7, None, 100 + i % 63) for _ in range(2)], "key string, member int")
    for whole in (False, True):
        got = [[r["member"] for r in st.set_intersection(state, keys, whole).collect()] for keys in ([f"k{i}" for i in range(64)], ["k0", "k63", "k0"], ["k0", "absent"], ["k5"])]
        assert got == [[None, 7], [None, 7, 100], [], [None, 7, 105]]
