"""The registered queries of the engine's own operators, and the SQL that each is compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.database import Database
from strandix.operators import convergence as cv
from strandix.operators import docvalues as dv
from strandix.operators import hybrid as hy
from strandix.operators import lexical as lx
from strandix.operators import structured as sq
from strandix.operators import structures as st
from strandix.operators import vectors as vx
from strandix.operators.inverted import TextIndex
from strandix.sources.tables import table

FLAGSHIP = "sql_scan_limit"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


# -- SQL dialect


def database(spark: SparkSession, d: str) -> Database:
    db = Database(spark)
    db.register("orders", table(spark, d, "orders"), ["o_orderkey"], {"orders_status": ["o_orderstatus"], "orders_status_priority": ["o_orderstatus", "o_orderpriority"], "orders_customer": ["o_custkey"]})
    db.register("customer", table(spark, d, "customer"), ["c_custkey"], {"customer_segment": ["c_mktsegment"], "customer_nation": ["c_nationkey"]})
    db.register("nation", table(spark, d, "nation"), ["n_regionkey", "n_nationkey"])
    db.register("country", table(spark, d, "nation"), ["n_nationkey"], {"country_name": ["n_name"]}, unique=("country_name",))
    db.register("region", table(spark, d, "region"), ["r_regionkey"])
    return db


def sql(name: str, text: str, oracle: str | None = None, params: tuple = ()) -> None:
    """Registers a statement of the dialect; where DuckDB reads it too, it is its own oracle."""
    query(name, oracle or text)(lambda spark, d: database(spark, d).execute(text, params))


sql("sql_scan_limit", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_custkey < 100 ORDER BY o_orderkey LIMIT 50")
sql("sql_scan_all", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 2147483647")
sql("sql_filter_3vl", "SELECT o_orderkey FROM orders WHERE NOT (o_custkey > 50 AND o_orderstatus = NULL) ORDER BY o_orderkey LIMIT 100")
sql("sql_filter_kleene", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey = NULL OR c_custkey <= 40 ORDER BY c_custkey LIMIT 1000")
sql("sql_is_null", "SELECT c_custkey FROM customer WHERE c_name IS NOT NULL AND NOT c_mktsegment IS NULL ORDER BY c_custkey LIMIT 200")
sql("sql_not_or_precedence", "SELECT c_custkey, c_mktsegment FROM customer WHERE NOT c_mktsegment = 'BUILDING' AND c_nationkey < 5 OR c_custkey = 7 ORDER BY c_custkey LIMIT 300")
sql("sql_pk_lookup", "SELECT * FROM customer WHERE c_custkey = 42")
sql("sql_pk_range", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 900 ORDER BY o_orderkey LIMIT 500")
sql("sql_pk_range_empty", "SELECT o_orderkey FROM orders WHERE o_orderkey > 900 AND o_orderkey < 100 ORDER BY o_orderkey LIMIT 500")
sql("sql_pk_prefix_scan", "SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_regionkey = 2 ORDER BY n_regionkey, n_nationkey LIMIT 10")
sql("sql_pk_prefix_range", "SELECT n_nationkey, n_name FROM nation WHERE n_regionkey = 1 AND n_nationkey > 2 AND n_nationkey <= 20 ORDER BY n_regionkey, n_nationkey LIMIT 10")
sql("sql_row_comparison", "SELECT n_regionkey, n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) >= (1, 3) AND (n_regionkey, n_nationkey) < (3, 8) ORDER BY n_regionkey, n_nationkey LIMIT 25",
    "SELECT n_regionkey, n_nationkey FROM nation WHERE (n_regionkey > 1 OR n_regionkey = 1 AND n_nationkey >= 3) AND (n_regionkey < 3 OR n_regionkey = 3 AND n_nationkey < 8)")
sql("sql_row_comparison_null", "SELECT n_regionkey, n_nationkey FROM nation WHERE (n_regionkey, n_nationkey) > (?, ?) ORDER BY n_regionkey, n_nationkey LIMIT 25",
    "SELECT n_regionkey, n_nationkey FROM nation WHERE n_regionkey > 2 OR n_regionkey = 2 AND n_nationkey > NULL", (2, None))
sql("sql_secondary_lookup", "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 ORDER BY o_orderkey LIMIT 40")
sql("sql_secondary_range", "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey > 20 ORDER BY c_nationkey LIMIT 60",
    "SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey > 20 ORDER BY c_nationkey, c_custkey LIMIT 60")
sql("sql_secondary_prefix_range", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority >= '3' AND o_custkey > 5 LIMIT 70",
    "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderstatus = 'O' AND o_orderpriority >= '3' AND o_custkey > 5 ORDER BY o_orderkey LIMIT 70")
sql("sql_index_intersection", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3 AND c_custkey < 100000 ORDER BY c_custkey")
sql("sql_params_literals", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > ? AND o_orderstatus <> ? ORDER BY o_orderkey LIMIT 25",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.5 AND o_orderstatus <> 'it''s' ORDER BY o_orderkey LIMIT 25", (100000.5, "it's"))
sql("sql_quoted_names", 'SELECT "O_ORDERKEY" FROM "Orders" WHERE "o_custkey" = 3 ORDER BY O_OrderKey LIMIT 9', "SELECT o_orderkey FROM orders WHERE o_custkey = 3 ORDER BY o_orderkey LIMIT 9")
_JOIN = 'SELECT o.o_orderkey AS "orders.o_orderkey", c.c_custkey AS "customer.c_custkey", c.c_mktsegment AS "customer.c_mktsegment" FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey'
_HEAD = "SELECT orders.o_orderkey, customer.c_custkey, customer.c_mktsegment FROM orders INNER JOIN customer ON orders.o_custkey = customer.c_custkey"
sql("sql_join_exact", f"{_HEAD} WHERE o_orderkey = 33", f"{_JOIN} WHERE o_orderkey = 33")
sql("sql_join_bounded", f"{_HEAD} WHERE o_orderkey > 10 ORDER BY o_orderkey LIMIT 100", f"{_JOIN} WHERE o_orderkey > 10 ORDER BY o_orderkey LIMIT 100")
sql("sql_join_secondary_left", f"{_HEAD} WHERE o_orderstatus = 'P' AND o_custkey < 900 LIMIT 80", f"{_JOIN} WHERE o_orderstatus = 'P' AND o_custkey < 900 ORDER BY o_orderkey LIMIT 80")
sql("sql_join_whole", f"{_HEAD} ORDER BY o_orderkey LIMIT 2147483647", f"{_JOIN} ORDER BY o_orderkey LIMIT 2147483647")


@query("sql_join_null_keys", 'SELECT o_orderkey AS "wanting.o_orderkey", c_name AS "customer.c_name" FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 3 <> 0')
def _(spark, d):
    """Every third order has no customer; such keys meet nothing, a null customer key neither."""
    db = database(spark, d)
    db.register("wanting", table(spark, d, "orders").withColumn("o_custkey", F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey"))), ["o_orderkey"])
    return db.execute("SELECT wanting.o_orderkey, customer.c_name FROM wanting INNER JOIN customer ON wanting.o_custkey = customer.c_custkey ORDER BY o_orderkey LIMIT 2147483647")


sql("sql_join_unique_right", "SELECT country.n_name, nation.n_nationkey FROM nation INNER JOIN country ON nation.n_name = country.n_name ORDER BY n_regionkey, n_nationkey LIMIT 12",
    'SELECT n_name AS "country.n_name", n_nationkey AS "nation.n_nationkey" FROM nation ORDER BY n_regionkey, n_nationkey LIMIT 12')
sql("sql_join_composite_right", "SELECT country.n_name, nation.n_regionkey FROM country INNER JOIN nation ON country.n_regionkey = nation.n_regionkey AND country.n_nationkey = nation.n_nationkey ORDER BY n_nationkey LIMIT 20",
    'SELECT n_name AS "country.n_name", n_regionkey AS "nation.n_regionkey" FROM nation ORDER BY n_nationkey LIMIT 20')
sql("sql_cte", "WITH few AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey > 10 ORDER BY c_custkey LIMIT 30) SELECT c_name FROM few LIMIT 12")
sql("sql_row_number", "SELECT c_custkey, ROW_NUMBER() OVER (ORDER BY c_custkey) AS n FROM customer ORDER BY c_custkey LIMIT 64")
sql("sql_rank", "SELECT c_name, RANK() OVER (ORDER BY c_custkey) AS n FROM customer ORDER BY c_custkey LIMIT 64")
sql("sql_row_number_partition", "SELECT n_name, ROW_NUMBER() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS n FROM nation ORDER BY n_regionkey, n_nationkey LIMIT 25")

_PLANS = {
    "lookup": ("SELECT * FROM customer WHERE c_custkey = 1", "PrimaryKeyLookup(table=5)"),
    "scan": ("SELECT c_custkey FROM customer WHERE c_name IS NULL LIMIT 3", "PrimaryKeyScan(table=5,limit=3,residual=true)"),
    "range": ("SELECT o_orderkey FROM orders WHERE o_orderkey >= 1 LIMIT 3", "PrimaryKeyRangeScan(table=1,lower=inclusive,upper=unbounded,limit=3)"),
    "prefix": ("SELECT n_name FROM nation WHERE n_regionkey = 1 LIMIT 2", "PrimaryKeyPrefixScan(table=8,columns=1,limit=2)"),
    "intersection": ("SELECT c_custkey FROM customer WHERE c_mktsegment = 'a' AND c_nationkey = 3", "SecondaryIndexIntersection(table=5,indexes=[6,7])"),
    "join": (f"{_HEAD} WHERE o_orderkey = 33", "IndexedInnerJoin(left_table=1,left_access=primary-key,right_table=5,right_access=primary-key)"),
}


@query("sql_explain_labels", " UNION ALL ".join(f"SELECT '{k}' AS shape, '{label}' AS plan" for k, (_, label) in _PLANS.items()))
def _(spark, d):
    db = database(spark, d)
    return reduce(DataFrame.unionByName, [db.execute(f"EXPLAIN {text}").select(F.lit(k).alias("shape"), "plan") for k, (text, _) in _PLANS.items()])


@query("dml_insert_update_delete", "SELECT r_regionkey, CASE WHEN r_regionkey = 1 THEN 'renamed' ELSE r_name END AS r_name FROM region WHERE r_regionkey <> 2 UNION ALL SELECT 77, 'new'")
def _(spark, d):
    db = database(spark, d)
    b = db.begin()
    b.execute("INSERT INTO region (r_regionkey, r_name) VALUES (?, 'new')", [77])
    b.execute("UPDATE region SET r_name = 'renamed' WHERE r_regionkey = 1")
    b.execute("DELETE FROM region WHERE r_regionkey = 2")
    b.commit()
    return db.execute("SELECT * FROM region LIMIT 100")


@query("ddl_constraints", "SELECT * FROM (VALUES (1, 'SQL015'), (2, 'SQL012'), (3, 'SQL016'), (4, 'SQL007'), (5, 'SQL006'), (6, 'SQL013'), (7, 'SQL016'), (8, 'SQL017')) AS t(step, code)")
def _(spark, d):
    from strandix.errors import EngineError

    db = Database(spark)
    db.execute("CREATE TABLE parents (id BIGINT PRIMARY KEY, balance BIGINT NOT NULL CHECK (balance >= 0))")
    db.execute("CREATE TABLE children (id BIGINT PRIMARY KEY, parent_id BIGINT, CONSTRAINT fk FOREIGN KEY (parent_id) REFERENCES parents (id))")
    db.execute("INSERT INTO parents (id, balance) VALUES (1, 5)")
    db.execute("INSERT INTO children (id, parent_id) VALUES (1, 1)")
    tries = ["INSERT INTO parents (id, balance) VALUES (2, -1)", "INSERT INTO parents (id, balance) VALUES (1, 1)", "INSERT INTO children (id, parent_id) VALUES (2, 9)", "INSERT INTO parents (id) VALUES (3)", "INSERT INTO parents (id, balance) VALUES ('x', 1)", "UPDATE parents SET id = 4 WHERE id = 1", "DELETE FROM parents WHERE id = 1", "SELECT * FROM nowhere WHERE id = 1"]
    out = []
    for i, text in enumerate(tries, 1):
        try:
            db.execute(text)
        except EngineError as e:
            out.append((i, e.code))
    return spark.createDataFrame(out, "step int, code string")


@query("catalog_list", "SELECT * FROM (VALUES (1, 'orders', 'relation'), (2, 'orders_status', 'index'), (3, 'orders_status_priority', 'index'), (4, 'orders_customer', 'index'), (5, 'customer', 'relation'), (6, 'customer_segment', 'index')) AS t(object_id, name, kind)")
def _(spark, d):
    page, _ = database(spark, d).state.catalog.list(limit=6)
    return spark.createDataFrame([(o["object_id"], o["name"], o["kind"]) for o in page], "object_id int, name string, kind string")


# -- structured records


def _events(spark, d):
    k = sq.json_field("props", "k", "bigint")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value", "props", "ts")
    return e.withColumn("k", k.value).withColumn("k__present", k.present)


def _k() -> sq.Field:
    return sq.Field(F.col("k"), F.col("k__present"))


@query("sq_filter_tree", "SELECT event_id, event_type FROM events WHERE (event_type = 'click' OR user_id < 20) AND NOT (coalesce((props->>'$.k')::BIGINT >= 50, false))")
def _(spark, d):
    f = sq.All((sq.Any((sq.Compare(sq.field_of("event_type"), "=", "click"), sq.Compare(sq.field_of("user_id"), "<", 20))), sq.Not(sq.Compare(_k(), ">=", 50))))
    return sq.matched(_events(spark, d), sq.Query(f)).select("event_id", "event_type")


@query("sq_contains_prefix", "SELECT doc_id FROM documents WHERE contains(text, 'tion th') AND starts_with(source, 'src1')")
def _(spark, d):
    f = sq.All((sq.Contains(sq.field_of("text"), "tion th"), sq.Prefix(sq.field_of("source"), "src1")))
    return sq.matched(table(spark, d, "documents"), sq.Query(f)).select("doc_id")


@query("sq_missing_vs_null", "SELECT event_id, (user_id % 3 <> 0) AS there, coalesce(user_id % 3 <> 0 AND (user_id % 3 = 1 OR value <> 10.0), false) AS unequal FROM events")
def _(spark, d):
    # the field is missing for every third user, null for the next, else the value
    e = table(spark, d, "events").withColumn("x", F.when(F.col("user_id") % 3 == 2, F.col("value"))).withColumn("p", F.col("user_id") % 3 != 0)
    x = sq.Field(F.col("x"), F.col("p"))
    return e.select("event_id", sq.condition(sq.Exists(x)).alias("there"), sq.condition(sq.Compare(x, "!=", 10.0)).alias("unequal"))


@query("sq_sort_nulls", "SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS p FROM orders ORDER BY p DESC NULLS FIRST, o_custkey ASC, o_orderkey LIMIT 200")
def _(spark, d):
    o = table(spark, d, "orders").withColumn("p", F.expr("nullif(o_orderpriority, '5-LOW')"))
    return sq.page(o, sq.Query(sorts=[sq.Sort("p", True, True), sq.Sort("o_custkey")], limit=200), "o_orderkey").select("o_orderkey", "p")


@query("sq_cursor_page", "SELECT o_orderkey FROM (SELECT *, row_number() OVER (ORDER BY o_custkey DESC NULLS LAST, o_orderkey) AS n FROM orders) WHERE n BETWEEN 41 AND 80")
def _(spark, d):
    o, q = table(spark, d, "orders"), sq.Query(sorts=[sq.Sort("o_custkey", True)], limit=40)
    _, cursor = sq.page_with_cursor(o, q, "o_orderkey")
    return sq.page(o, sq.Query(sorts=q.sorts, limit=40, cursor=cursor), "o_orderkey").select("o_orderkey")


@query("sq_global_agg", "SELECT count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS total, min((props->>'$.k')::BIGINT) AS low, max((props->>'$.k')::BIGINT) AS high FROM events WHERE event_type <> 'view'")
def _(spark, d):
    q = sq.Query(sq.Compare(sq.field_of("event_type"), "!=", "view"), metrics=[sq.Metric("n", "count"), sq.Metric("total", "sum", _k()), sq.Metric("low", "min", _k()), sq.Metric("high", "max", _k())])
    return sq.aggregate(_events(spark, d), q).withColumn("total", F.col("total").cast("bigint"))


@query("sq_group_agg", "SELECT o_orderstatus, o_orderpriority, count(*) AS n, sum(o_custkey)::BIGINT AS total, max(o_custkey) AS high FROM orders WHERE o_orderkey >= 10 GROUP BY 1, 2")
def _(spark, d):
    c = sq.field_of("o_custkey")
    q = sq.Query(sq.Compare(sq.field_of("o_orderkey"), ">=", 10), groups=["o_orderstatus", "o_orderpriority"], metrics=[sq.Metric("n", "count"), sq.Metric("total", "sum", c), sq.Metric("high", "max", c)])
    return sq.aggregate(table(spark, d, "orders"), q).withColumn("total", F.col("total").cast("bigint"))


@query("sq_group_missing", "SELECT (user_id % 3 <> 0) AS x__present, CASE WHEN user_id % 3 = 2 THEN event_type END AS x, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, d):
    e = table(spark, d, "events").withColumn("x", F.when(F.col("user_id") % 3 == 2, F.col("event_type"))).withColumn("x__present", F.col("user_id") % 3 != 0)
    return sq.aggregate(e, sq.Query(groups=["x"], metrics=[sq.Metric("n", "count")]))


# -- document values

_DOCS = ("doc_id", "lang", "source", "n_chars")


@query("dv_filter_sort", "SELECT doc_id, lang, n_chars FROM documents WHERE lang <> 'en' AND n_chars >= 500 ORDER BY n_chars DESC, doc_id LIMIT 100")
def _(spark, d):
    docs = table(spark, d, "documents").select(*_DOCS).withColumn("score", F.lit(0.0))
    f = sq.All((sq.Compare(sq.field_of("lang"), "!=", "en"), sq.Compare(sq.field_of("n_chars"), ">=", 500)))
    return dv.hits(dv.filtered(docs, f), [dv.SortBy("n_chars", True)], 100).select("doc_id", "lang", "n_chars")


@query("dv_missing_sort", "SELECT doc_id, nullif(source, 'src3') AS source FROM documents ORDER BY nullif(source, 'src3') DESC NULLS FIRST, doc_id LIMIT 150")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.expr("nullif(source, 'src3')").alias("source"))
    return dv.hits(docs, [dv.SortBy("source", True, True)], 150)


@query("dv_facets", "SELECT source AS value, count(*) AS count FROM documents WHERE lang = 'en' GROUP BY 1 ORDER BY count DESC, value LIMIT 7")
def _(spark, d):
    return dv.facet(dv.filtered(table(spark, d, "documents").select(*_DOCS), sq.Compare(sq.field_of("lang"), "=", "en")), "source", 7)


@query("dv_metrics", "SELECT count(n_chars) AS count, sum(n_chars)::BIGINT AS sum, min(n_chars) AS min, max(n_chars) AS max FROM documents WHERE source = 'src2'")
def _(spark, d):
    m = dv.metrics(dv.filtered(table(spark, d, "documents").select(*_DOCS), sq.Compare(sq.field_of("source"), "=", "src2")), "n_chars")
    return m.withColumn("sum", F.col("sum").cast("bigint"))


# -- text

_TOK = r"regexp_extract_all(replace(lower(text), 'ß', 'ss'), '[\p{L}\p{N}]+')"
_BM25 = """
WITH d AS (SELECT doc_id, {tok} AS t FROM documents), l AS (SELECT doc_id, len(t) AS n FROM d),
q AS (SELECT unnest({terms}) AS term),
tf AS (SELECT doc_id, term, len(list_filter(t, lambda x: x = term)) AS tf FROM d, q),
c AS (SELECT count(*) AS n, avg(n) AS a FROM l), f AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY term),
s AS (SELECT tf.doc_id, sum(ln(1 + (c.n - f.df + 0.5) / (f.df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l.n / c.a))) AS score
      FROM tf JOIN l USING (doc_id) JOIN f USING (term), c WHERE tf > 0 GROUP BY tf.doc_id)
"""


def _analyzed(spark, d):
    return lx.analyzed(table(spark, d, "documents"))


_INDEXES: dict[tuple[str, str], TextIndex] = {}


def _text_index(spark, d):
    """The stored index of the documents, built once for a session and folder."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _INDEXES:
        import uuid

        from strandix.sources.shared import scratch

        empty = TextIndex(spark, f"{scratch(spark)}/text-{uuid.uuid4().hex}")
        _INDEXES[key] = empty.index(table(spark, d, "documents"))
    return _INDEXES[key]


@query("txt_tokens", f"SELECT doc_id, len({_TOK}) AS n, {_TOK}[1] AS first_token, len(list_distinct({_TOK})) AS distinct_tokens FROM documents")
def _(spark, d):
    a = _analyzed(spark, d)
    return a.select("doc_id", F.col("len").alias("n"), F.get("tokens", F.lit(0)).alias("first_token"), F.size(F.array_distinct("tokens")).alias("distinct_tokens"))


@query("txt_bm25", _BM25.format(tok=_TOK, terms="['that', 'the', 'thinble']") + "SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 25")
def _(spark, d):
    return lx.bm25(_text_index(spark, d), "The THAT thinble", 25).withColumn("score", F.round("score", 6))


@query("txt_bm25_filtered", _BM25.format(tok=_TOK, terms="['der', 'die']") + "SELECT doc_id, round(score, 6) AS score FROM s JOIN documents USING (doc_id) WHERE source = 'src4' ORDER BY s.score DESC, doc_id LIMIT 10")
def _(spark, d):
    allow = table(spark, d, "documents").filter("source = 'src4'").select("doc_id")
    return lx.bm25(_text_index(spark, d), "die der", 10, allow).withColumn("score", F.round("score", 6))


@query("txt_bm25_unindexed", _BM25.format(tok=_TOK, terms="['das', 'und']") + "SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 25")
def _(spark, d):
    return lx.bm25(_analyzed(spark, d), "und das", 25).withColumn("score", F.round("score", 6))


@query("txt_marks", "SELECT doc_id, 1::BIGINT AS score FROM documents WHERE doc_id % 10 = 0 ORDER BY doc_id LIMIT 100")
def _(spark, d):
    """A word with marks, which are letters of it, in every tenth document, and another in the rest."""
    docs = table(spark, d, "documents").select("doc_id", F.concat("text", F.when(F.col("doc_id") % 10 == 0, F.lit(" हिन्दी")).otherwise(F.lit(" தமிழ்"))).alias("text"))
    return lx.boolean_search(lx.analyzed(docs), lx.Phrase("हिन्दी"), 100)


@query("txt_lifecycle", _BM25.format(tok=_TOK, terms="['that', 'thinble', 'zebra']").replace("FROM documents)", "FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'zebra ' || lang ELSE text END AS text FROM documents WHERE doc_id % 7 <> 0 OR doc_id % 35 = 0))", 1) + "SELECT doc_id, round(score, 6) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, doc_id LIMIT 400")
def _(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    changed = _text_index(spark, d).delete(docs.filter("doc_id % 7 = 0")).replace(docs.filter("doc_id % 5 = 0").withColumn("text", F.concat(F.lit("zebra "), "lang")))
    return changed.consolidated().bm25("zebra thinble That", 400).withColumn("score", F.round("score", 6))


@query("txt_bm25f", f"""
WITH d AS (SELECT doc_id, {_TOK} AS a, regexp_extract_all(lower(source), '[\\p{{L}}\\p{{N}}]+') AS b FROM documents), q AS (SELECT unnest(['src5', 'tion']) AS term),
f AS (SELECT doc_id, term, len(list_filter(a, lambda x: x = term)) AS ta, len(list_filter(b, lambda x: x = term)) AS tb, len(a) AS la, len(b) AS lb FROM d, q),
v AS (SELECT count(*) AS n, avg(len(a)) AS aa, avg(len(b)) AS ab FROM d), g AS (SELECT term, count(*) FILTER (WHERE ta + tb > 0) AS df FROM f GROUP BY term),
w AS (SELECT f.doc_id, f.term, ln(1 + (v.n - g.df + 0.5) / (g.df + 0.5)) AS idf, ta / (0.25 + 0.75 * la / v.aa) + 2.5 * tb / (0.25 + 0.75 * lb / v.ab) AS tf FROM f JOIN g USING (term), v),
s AS (SELECT doc_id, sum(round(idf * tf * 2.2 / (tf + 1.2) * 1e9)::BIGINT) AS nanos FROM w GROUP BY doc_id)
SELECT doc_id, round(nanos / 1e9, 6) AS score FROM s WHERE nanos > 0 ORDER BY nanos DESC, doc_id LIMIT 30""")
def _(spark, d):
    fields = [lx.Weighted("text"), lx.Weighted("source", 2_500_000)]
    got = lx.bm25f(table(spark, d, "documents"), "SRC5 tion", fields, 30)
    return got.select("doc_id", F.round(F.col("score_nanos") / 1e9, 6).alias("score"))


def _bool(name: str, q, condition: str, score: str = "1") -> None:
    query(name, f"WITH d AS (SELECT doc_id, {_TOK} AS t FROM documents) SELECT doc_id, ({score})::BIGINT AS score FROM d WHERE {condition} ORDER BY score DESC, doc_id LIMIT 100")(lambda spark, d: lx.boolean_search(_analyzed(spark, d), q, 100))


_bool("txt_term", lx.Term("Einer"), "list_contains(t, 'einer')")
_bool("txt_phrase", lx.Phrase("of the, that"), "len(list_filter(range(1, len(t) - 1), lambda i: t[i] = 'of' AND t[i + 1] = 'the' AND t[i + 2] = 'that')) > 0")
_bool("txt_prefix", lx.StartsWith("thinth"), "len(list_filter(t, lambda x: starts_with(x, 'thinth'))) > 0")
_bool("txt_fuzzy", lx.Fuzzy("thinbla", 1), "len(list_filter(t, lambda x: levenshtein(x, 'thinbla') <= 1)) > 0")
_bool("txt_boolean", lx.Bool(must=(lx.Term("the"),), should=(lx.StartsWith("erth"), lx.Fuzzy("thes", 1)), must_not=(lx.Term("was"),)),
      "list_contains(t, 'the') AND NOT list_contains(t, 'was')", "1 + (len(list_filter(t, lambda x: starts_with(x, 'erth'))) > 0)::INT + (len(list_filter(t, lambda x: levenshtein(x, 'thes') <= 1)) > 0)::INT")


# -- vectors

_QUERY = [round(((i * 37) % 19 - 9) / 10, 1) for i in range(64)]
_Q = "[" + ", ".join(f"({x})::FLOAT::DOUBLE" for x in _QUERY) + "]"
_DIST = {"l2": f"list_distance(embedding::DOUBLE[], {_Q}) ** 2", "dot": f"-list_inner_product(embedding::DOUBLE[], {_Q})", "cosine": f"1 - list_cosine_similarity(embedding::DOUBLE[], {_Q})"}
for _m, _expr in _DIST.items():
    query(f"vec_exact_{_m}", f"SELECT vec_id AS id, round({_expr}, 6) AS distance FROM embeddings ORDER BY {_expr}, vec_id LIMIT 20")(
        lambda spark, d, m=_m: vx.exact(table(spark, d, "embeddings"), _QUERY, m, 20).withColumn("distance", F.round("distance", 6))
    )


@query("vec_filtered", f"SELECT vec_id AS id, round({_DIST['l2']}, 6) AS distance FROM embeddings WHERE label = 3 ORDER BY {_DIST['l2']}, vec_id LIMIT 10")
def _(spark, d):
    e = table(spark, d, "embeddings")
    return vx.exact(e, _QUERY, "l2", 10, e.filter("label = 3")).withColumn("distance", F.round("distance", 6))


@query("vec_batch", """
WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, list_distance(q.v, e.v) ** 2 AS d FROM e q, e WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS rank FROM p)
SELECT query_id, id, round(d, 6) AS distance, rank FROM r WHERE rank <= 10""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    near = vx.batch_exact(e, e.filter("id % 50 = 0").select(F.col("id").alias("query_id"), "v"), "l2", 10)
    return near.select("query_id", "id", F.abs(F.round("distance", 6)).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query("vec_abstain", f"SELECT CASE WHEN max(s) < 0.9 THEN 'below_threshold' ELSE 'matches' END AS outcome, 0::BIGINT AS n FROM (SELECT list_cosine_similarity(embedding::DOUBLE[], {_Q}) AS s FROM embeddings)")
def _(spark, d):
    outcome, hits = vx.cosine_with_abstention(table(spark, d, "embeddings"), _QUERY, 5, minimum_score=0.9)
    return spark.createDataFrame([(outcome, len(hits))], "outcome string, n long")


_Q15 = vx.q15([x / 10 for x in _QUERY])


@query("vec_q15", f"""
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: greatest(-32767, least(32767, round(x::DOUBLE * 3000)::BIGINT))) AS v, {_Q15}::BIGINT[] AS q FROM embeddings),
s AS (SELECT id, list_sum(list_transform(list_zip(v, q), lambda z: z[1] * z[2]))::HUGEINT AS dot, list_sum(list_transform(v, lambda x: x * x))::HUGEINT * list_sum(list_transform(q, lambda x: x * x))::HUGEINT AS square FROM v),
r AS (SELECT *, floor(sqrt(square::DOUBLE))::HUGEINT AS near FROM s),
e AS (SELECT id, dot, CASE WHEN near * near > square THEN near - 1 WHEN (near + 1) * (near + 1) <= square THEN near + 1 ELSE near END AS root FROM r),
n AS (SELECT id, dot * 2000000000 + root AS a, 2 * root AS b FROM e)
SELECT id, greatest(-1000000000, least(1000000000, (a - ((a % b + b) % b)) // b))::BIGINT AS score_nanos FROM n ORDER BY score_nanos DESC, id LIMIT 15""")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("q15", F.transform("embedding", lambda x: F.greatest(F.lit(-32767), F.least(F.lit(32767), F.round(x.cast("double") * 3000).cast("int")))))
    return vx.retrieve_q15(e, _Q15, 15)


@query("vec_ivf_recall")
def _(spark, d):
    e = table(spark, d, "embeddings")
    index = vx.build_cells(e)
    hits, receipt = vx.search_cells(index, _QUERY, 10)
    truth = [r["id"] for r in vx.exact(e, _QUERY, "l2", 10).collect()]
    return spark.createDataFrame([(vx.recall_ppm([h[0] for h in hits], truth), receipt["visited_cells"], receipt["cells"])], "recall_ppm int, visited_cells int, cells int")


@query("vec_upsert", "SELECT vec_id, (embedding::DOUBLE[])[1] AS x FROM embeddings WHERE vec_id % 7 > 1 UNION ALL SELECT vec_id, 1.0 FROM embeddings WHERE vec_id % 7 = 1")
def _(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    delta = e.filter("vec_id % 7 <= 1").select("vec_id", F.when(F.col("vec_id") % 7 == 1, F.array(F.lit(1.0).cast("float"))).alias("embedding"))
    return vx.upserted(e, delta).select("vec_id", F.get("embedding", F.lit(0)).cast("double").alias("x"))


# -- hybrid


def _branches(spark, d, allow=None):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    lexical = lx.bm25(_text_index(spark, d), "the that tion", 50).withColumnRenamed("doc_id", "id")
    return hy.ranked(lexical, "lexical", "score"), hy.ranked(vx.exact(e, _QUERY, "l2", 50, allow, "id", "v"), "vector", "distance", False), e


_RANKS = _BM25.format(tok=_TOK, terms="['that', 'the', 'tion']") + """,
lexical AS (SELECT doc_id AS id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT 50)),
vector AS (SELECT vec_id AS id, row_number() OVER (ORDER BY x, vec_id) AS rank FROM (SELECT vec_id, {l2} AS x FROM embeddings {where} ORDER BY x, vec_id LIMIT 50)),
m AS (SELECT id, l.rank AS lexical, v.rank AS vector FROM lexical l FULL JOIN vector v USING (id))
""".replace("{l2}", _DIST["l2"])


@query("hyb_rrf_int", _RANKS.replace("{where}", "") + "SELECT id, lexical, vector, coalesce(3000000000 // (60 + lexical), 0) + coalesce(2000000000 // (60 + vector), 0) AS score_nanos FROM m ORDER BY score_nanos DESC, id LIMIT 40")
def _(spark, d):
    lexical, vector, _ = _branches(spark, d)
    return hy.fuse_int({"lexical": lexical, "vector": vector}, {"lexical": 3, "vector": 2}, 40).select("id", "lexical", "vector", "score_nanos")


@query("hyb_rrf_f64", _RANKS.replace("{where}", "") + "SELECT id, round(coalesce(1.5 / (60 + lexical), 0) + coalesce(1.0 / (60 + vector), 0), 9) AS score FROM m ORDER BY coalesce(1.5 / (60 + lexical), 0) + coalesce(1.0 / (60 + vector), 0) DESC, id LIMIT 40")
def _(spark, d):
    lexical, vector, _ = _branches(spark, d)
    return hy.fuse_float({"lexical": lexical, "vector": vector}, {"lexical": 1.5, "vector": 1.0}, 40).select("id", F.round("score", 9).alias("score"))


@query("hyb_integrated", _RANKS.replace("{where}", "WHERE vec_id IN (SELECT doc_id FROM documents WHERE lang = 'en')") + """
SELECT id, lang, round(coalesce(1.0 / (60 + lexical), 0) + coalesce(1.0 / (60 + vector), 0), 9) AS score FROM m JOIN documents ON doc_id = id
WHERE lang = 'en' ORDER BY coalesce(1.0 / (60 + lexical), 0) + coalesce(1.0 / (60 + vector), 0) DESC, id LIMIT 20""")
def _(spark, d):
    values = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    _, _, e = _branches(spark, d)
    s = hy.Search("the that tion", candidates=50, vectors=[hy.VectorBranch("vector", e, _QUERY, k=50)], filter=sq.Compare(sq.field_of("lang"), "=", "en"), limit=20)
    return hy.integrated(values, _text_index(spark, d), s).hits.select("id", "lang", F.round("score", 9).alias("score"))


# -- convergence


@query("cnv_join_agg", f"""
WITH j AS (SELECT d.doc_id, d.n_chars::DOUBLE AS size, l.quality::DOUBLE AS quality, -({_DIST['l2']}) AS near FROM documents d JOIN labels l USING (doc_id) JOIN embeddings e ON e.vec_id = d.doc_id)
SELECT count(size) AS size_count, round(sum(size), 6) AS size_sum, min(size) AS size_min, max(size) AS size_max,
       round(sum(quality), 6) AS quality_sum, round(sum(near), 6) AS near_sum FROM j""")
def _(spark, d):
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("object_id"), vx.distance("l2", F.col("embedding"), _QUERY).alias("value"))
    sources = [
        cv.Source("size", table(spark, d, "documents").select(F.col("doc_id").alias("object_id"), F.col("n_chars").alias("value"))),
        cv.Source("quality", table(spark, d, "labels").select(F.col("doc_id").alias("object_id"), F.col("quality").alias("value"))),
        cv.Source("near", e, "distance"),
    ]
    agg = cv.aggregate(cv.converge(sources, check=False).rows, ["size", "quality", "near"])
    return agg.select("size_count", F.round("size_sum", 6).alias("size_sum"), "size_min", "size_max", F.round("quality_sum", 6).alias("quality_sum"), F.round("near_sum", 6).alias("near_sum"))


# -- keyed structures


def _hash_log(spark, d):
    """Every event puts its value under (user, type), or removes it, or makes the user's hash anew."""
    op = F.when(F.col("event_id") % 97 == 0, "delete").when(F.col("event_id") % 13 == 0, "remove").otherwise("put")
    return table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), op.alias("op"), F.col("event_type").alias("field"), F.col("value"), F.when(F.col("event_id") % 5 == 0, F.col("event_id") * 10).alias("expiry"))


_HASH = """
WITH o AS (SELECT user_id AS key, event_id AS seq, event_type AS field, value, CASE WHEN event_id % 5 = 0 THEN event_id * 10 END AS expiry,
  CASE WHEN event_id % 97 = 0 THEN 'delete' WHEN event_id % 13 = 0 THEN 'remove' ELSE 'put' END AS op FROM events),
c AS (SELECT key, max(seq) AS cut FROM o WHERE op = 'delete' GROUP BY key),
r AS (SELECT o.*, row_number() OVER (PARTITION BY o.key, field ORDER BY seq DESC) AS n FROM o LEFT JOIN c ON o.key = c.key WHERE op <> 'delete' AND (cut IS NULL OR seq > cut)),
h AS (SELECT key, field, value, expiry FROM r WHERE n = 1 AND op = 'put' AND (expiry IS NULL OR expiry > 40000))
"""


@query("str_hash_fold", _HASH + "SELECT * FROM h")
def _(spark, d):
    return st.fold_members(_hash_log(spark, d), 40_000)


@query("str_hash_scan", _HASH + "SELECT field, value FROM h WHERE key = 7 AND field > 'b' ORDER BY field LIMIT 3")
def _(spark, d):
    return st.scan(st.fold_members(_hash_log(spark, d), 40_000), 7, 3, "b").select("field", "value")


@query("str_hash_scan_reverse", _HASH + "SELECT field FROM h WHERE key = 11 AND field < 'v' ORDER BY field DESC LIMIT 3")
def _(spark, d):
    return st.scan(st.fold_members(_hash_log(spark, d), 40_000), 11, 3, "v", True).select("field")


@query("str_hash_get_many", _HASH + "SELECT position, field, value FROM (SELECT unnest(range(4))::INT AS position, unnest(['view', 'absent', 'click', 'view']) AS field) LEFT JOIN (SELECT field, value FROM h WHERE key = 5) USING (field)")
def _(spark, d):
    return st.get_many(st.fold_members(_hash_log(spark, d), 40_000), 5, ["view", "absent", "click", "view"])


@query("str_hash_match", _HASH + "SELECT key, field FROM h WHERE regexp_full_match(field, '[a-p].*[^x]c?.')")
def _(spark, d):
    from strandix.functions.text import glob

    h = st.fold_members(_hash_log(spark, d), 40_000)
    return h.filter(glob(F.col("field"), "[a-p]*[^x]?") | glob(F.col("field"), "[a-p]*[^x]c?")).select("key", "field")


@query("str_hash_ttl", _HASH + "SELECT key, field, CASE WHEN expiry IS NULL THEN 'persistent' ELSE (expiry - 40000)::VARCHAR END AS ttl FROM h")
def _(spark, d):
    return st.fold_members(_hash_log(spark, d), 40_000).select("key", "field", st.ttl("expiry", 40_000).alias("ttl"))


@query("str_hash_len", _HASH + ", e AS (SELECT key, arg_max(op, seq) AS op FROM o GROUP BY key) SELECT e.key, count(h.field) AS n FROM e LEFT JOIN h ON e.key = h.key WHERE e.op <> 'delete' GROUP BY e.key")
def _(spark, d):
    log = _hash_log(spark, d)
    # a hash has no expiry of its own here: only its fields do
    return st.cardinality(st.headers(log.withColumn("expiry", F.lit(None).cast("bigint")), 40_000), st.fold_members(log, 40_000))


def _sets(spark, d):
    return table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member")).distinct()


_SETS = "WITH s AS (SELECT DISTINCT event_type AS key, user_id * 100 + day(ts) AS member FROM events)"


def _rich(spark, d):
    """Sets of (user, day of the month) by event type, of all events: no two of them are equal."""
    return table(spark, d, "events").select(F.col("event_type").alias("key"), (F.col("user_id") * 100 + F.dayofmonth("ts")).alias("member")).distinct()


@query("str_set_union", _SETS + " SELECT DISTINCT member FROM s WHERE key IN ('click', 'view')")
def _(spark, d):
    return st.set_union(_rich(spark, d), ["click", "view", "click"], whole=True)


@query("str_set_intersect", _SETS + " SELECT member FROM s WHERE key = 'click' INTERSECT SELECT member FROM s WHERE key = 'view' INTERSECT SELECT member FROM s WHERE key = 'purchase'")
def _(spark, d):
    return st.set_intersection(_rich(spark, d), ["click", "view", "purchase"], whole=True)


@query("str_set_difference", _SETS + " SELECT member FROM s WHERE key = 'view' EXCEPT SELECT member FROM s WHERE key IN ('click', 'purchase')")
def _(spark, d):
    return st.set_difference(_rich(spark, d), ["view", "click", "purchase"], whole=True)


@query("str_set_scan", "SELECT DISTINCT user_id AS member FROM events WHERE event_type = 'view' AND user_id > 30 ORDER BY member LIMIT 25")
def _(spark, d):
    return _sets(spark, d).filter("key = 'view' AND member > 30").orderBy("member").limit(25).select("member")


@query("str_set_member", "SELECT unnest(range(3))::INT AS position, unnest(['3', 'x', '3']) AS member, unnest([(SELECT count(*) > 0 FROM events WHERE event_type = 'click' AND user_id = 3), false, (SELECT count(*) > 0 FROM events WHERE event_type = 'click' AND user_id = 3)]) AS present")
def _(spark, d):
    return st.is_member(_sets(spark, d).select("key", F.col("member").cast("string").alias("field")), "click", ["3", "x", "3"])


def _sorted_sets(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("member"), st.clean_score(F.round("c_acctbal", 0)).alias("score"))


_Z = "WITH z AS (SELECT c_nationkey AS key, c_name AS member, round(c_acctbal, 0) AS score FROM customer)"


@query("str_zrange", _Z + " SELECT member, score FROM z WHERE key = 4 ORDER BY score, member LIMIT 8 OFFSET 2")
def _(spark, d):
    return st.z_range(_sorted_sets(spark, d), 4, 2, 9)


@query("str_zrevrange", _Z + " SELECT member, score FROM z WHERE key = 4 ORDER BY score DESC, member DESC LIMIT 5")
def _(spark, d):
    return st.z_range(_sorted_sets(spark, d), 4, 0, 4, True)


@query("str_zrange_negative", _Z + " SELECT member, score FROM (SELECT * FROM z WHERE key = 6 ORDER BY score DESC, member DESC LIMIT 3)")
def _(spark, d):
    return st.z_range(_sorted_sets(spark, d), 6, -3, -1)


@query("str_zrange_by_score", _Z + " SELECT member, score FROM z WHERE key = 2 AND score > 0 AND score <= 5000 ORDER BY score DESC, member DESC LIMIT 6 OFFSET 1")
def _(spark, d):
    return st.z_range_by_score(_sorted_sets(spark, d), 2, 0.0, 5000.0, low_open=True, offset=1, limit=6, reverse=True)


@query("str_zrank", _Z + " SELECT key, member, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rev_rank FROM z")
def _(spark, d):
    return st.with_ranks(_sorted_sets(spark, d)).select("key", "member", "rank", "rev_rank")


@query("str_list_lrange", "SELECT key, index, value FROM (SELECT conv_id AS key, row_number() OVER w - 1 AS index, text AS value, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE index BETWEEN 1 AND n - 2")
def _(spark, d):
    log = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.lit("right").alias("side"), F.col("text").alias("value"))
    return st.l_range(st.pushed_list(log), 1, -2)


@query("str_list_pop", "SELECT conv_id::VARCHAR AS key, arg_min(text, turn) AS value FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("key"), "turn", "text")
    push = c.select("key", F.col("turn").alias("seq"), F.lit("rpush").alias("op"), F.col("text").alias("value"))
    pop = c.select("key").distinct().select("key", F.lit(1 << 40).alias("seq"), F.lit("lpop").alias("op"), F.lit(None).cast("string").alias("value"))
    return st.fold_list(push.unionByName(pop)).filter("popped").select("key", "value")


@query("str_stream_xrange", "SELECT entry_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS entry_id FROM events) WHERE user_id = 9 AND entry_id BETWEEN 3 AND 12")
def _(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").alias("key"), F.struct("ts", "event_id").alias("seq"), F.create_map(F.lit("type"), F.col("event_type")).alias("fields"))
    return st.x_range(st.appended(log), 9, 3, 12, 100).select("entry_id", F.col("fields")["type"].alias("event_type"))


@query("str_counter_fold", "SELECT event_type AS key, sum(event_id % 7 - 3)::BIGINT AS value FROM events GROUP BY 1")
def _(spark, d):
    return st.fold_counters(table(spark, d, "events").select(F.col("event_type").alias("key"), (F.col("event_id") % 7 - 3).alias("delta")))


_STR = "WITH o AS (SELECT user_id AS key, event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'delete' ELSE 'set' END AS op, event_type AS value, CASE WHEN event_id % 3 = 0 THEN event_id + 100 END AS expiry FROM events), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM o) WHERE n = 1)"


def _string_log(spark, d):
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 11 == 0, "delete").otherwise("set").alias("op"), F.col("event_type").alias("value"), F.when(F.col("event_id") % 3 == 0, F.col("event_id") + 100).alias("expiry"))


@query("str_ttl_state", _STR + " SELECT key, value, CASE WHEN expiry IS NULL THEN 'persistent' ELSE (expiry - 500)::VARCHAR END AS ttl FROM l WHERE op = 'set' AND (expiry IS NULL OR expiry > 500)")
def _(spark, d):
    return st.fold_strings(_string_log(spark, d), 500).select("key", "value", st.ttl("expiry", 500).alias("ttl"))


@query("str_expire_due", "SELECT user_id AS key, min(event_id) AS expiry FROM events GROUP BY 1 ORDER BY expiry, key LIMIT 20")
def _(spark, d):
    header = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.min("event_id").alias("expiry"))
    return st.expire_due(header, 1 << 50, 20)[0]


@query("str_hash_incrby", "SELECT user_id::VARCHAR AS key, event_type AS field, sum(event_id % 9 - 4)::BIGINT AS value FROM events GROUP BY ALL")
def _(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("field"), (F.col("event_id") % 9 - 4).alias("delta"))
    return st.fold_field_counters(log)


@query("str_hash_outcomes", """
WITH e AS (SELECT user_id::VARCHAR AS key, event_type AS field, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 'remove' ELSE 'put' END AS op FROM events),
p AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY key, field ORDER BY seq) = 'put', false) AS held FROM e)
SELECT key, count(*) FILTER (WHERE op = 'put' AND NOT held) AS added, count(*) FILTER (WHERE op = 'put' AND held) AS updated,
       count(*) FILTER (WHERE op = 'remove' AND held) AS removed FROM p GROUP BY key""")
def _(spark, d):
    op = F.when(F.col("event_id") % 3 == 0, "remove").otherwise("put").alias("op")
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("field"), F.col("event_id").alias("seq"), op, F.lit(None).cast("bigint").alias("expiry"), F.col("event_id").alias("at"))
    return st.outcomes(log).groupBy("key").agg(*[F.count(F.when(F.col(c), 1)).alias(c) for c in ("added", "updated", "removed")])


@query("vec_null_vectors", f"SELECT vec_id, round({_DIST['l2']}, 6) AS distance FROM embeddings WHERE vec_id % 3 <> 0 ORDER BY {_DIST['l2']}, vec_id LIMIT 30")
def _(spark, d):
    e = table(spark, d, "embeddings").withColumn("embedding", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")))
    return vx.exact(e, _QUERY, "l2", 30).select(F.col("id").alias("vec_id"), F.round("distance", 6).alias("distance"))


@query("ceilings", "SELECT * FROM (VALUES ('set keys', 'LIM010'), ('set output', 'LIM010'), ('set visits', 'LIM010'), ('another kind', 'STR001'), ('entry ids', 'STR002'), ('nested statement', 'SQL001'), ('query vectors', 'LIM007')) t(request, code)")
def _(spark, d):
    """What is refused, each with its code: nothing of these comes back in part."""
    from strandix.errors import EngineError

    many = spark.range(1_100_000).select(F.lit("a").alias("key"), F.col("id").alias("member"))
    kinds = spark.sql("SELECT 'a' AS key, 'hash' AS kind")
    entries = spark.sql("SELECT 'a' AS key, id AS seq, 5 - id AS entry_id, map('f', 'v') AS fields FROM range(3)")
    vectors = spark.range(100_001).select("id", F.col("id").alias("query_id"), F.array(F.lit(1.0)).alias("v"))
    asked = {
        "set keys": lambda: st.set_union(many, ["a"] * 65),
        "set output": lambda: st.set_union(many.filter("member < 70000"), ["a"]),
        "set visits": lambda: st.set_intersection(many, ["a"]),
        "another kind": lambda: st.check_kind(kinds, ["a"], "set"),
        "entry ids": lambda: st.check_entries(entries),
        "nested statement": lambda: database(spark, d).execute("SELECT o_orderkey FROM orders WHERE " + "(" * 5000 + "o_orderkey = 1" + ")" * 5000),
        "query vectors": lambda: vx.batch_exact(vectors, vectors, "l2", 1),
    }
    got = []
    for name, ask in asked.items():
        try:
            ask()
            got.append((name, "none"))
        except EngineError as e:
            got.append((name, e.code))
    return spark.createDataFrame(got, "request string, code string")


@query("str_conditional_set", """
WITH o AS (SELECT user_id::VARCHAR AS key, event_id AS seq, event_type AS value FROM events)
SELECT key, arg_min(value, seq) AS value FROM o GROUP BY key""")
def _(spark, d):
    log = table(spark, d, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("seq"), F.lit("set").alias("op"), F.col("event_type").alias("value"), F.lit(None).cast("bigint").alias("expiry"), F.lit("NX").alias("when"), F.col("event_id").alias("at"))
    return st.fold_conditional(log).select("key", "value")


@query("struct_batch", "SELECT n_regionkey, n_nationkey, upper(n_name) || '!' AS n_name FROM nation WHERE n_nationkey < 5 UNION ALL SELECT n_regionkey, n_nationkey, n_name FROM nation WHERE n_nationkey >= 5")
def _(spark, d):
    db = database(spark, d)
    b = db.begin()
    b.upsert("nation", table(spark, d, "nation").filter("n_nationkey < 5").withColumn("n_name", F.concat(F.upper("n_name"), F.lit("!"))))
    b.commit()
    return db.execute("SELECT n_regionkey, n_nationkey, n_name FROM nation LIMIT 100")


@query("kv_upsert_delete", "SELECT event_id, 'seen' AS event_type FROM events WHERE event_id % 4 = 1 UNION ALL SELECT event_id, event_type FROM events WHERE event_id % 4 IN (0, 2)")
def _(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type")
    db = Database(spark)
    db.register("records", e, ["event_id"])
    b = db.begin()
    b.upsert("records", e.filter("event_id % 4 = 1").withColumn("event_type", F.lit("seen")))
    b.commit()
    gone = e.filter("event_id % 4 = 3").select("event_id")
    return db.state.tables[1].join(gone, "event_id", "left_anti")


# -- store


def _store(spark):
    import uuid

    from strandix.sources.store import Store
    from strandix.sources.shared import scratch

    return Store(spark, f"{scratch(spark)}/store-{uuid.uuid4().hex}")


@query("store_time_travel", "SELECT 1 AS version, count(*) AS n FROM region UNION ALL SELECT 2, count(*) FROM nation")
def _(spark, d):
    s = _store(spark)
    s.commit({"t": table(spark, d, "region")})
    s.commit({"t": table(spark, d, "nation")})
    return reduce(DataFrame.unionByName, [s.table("t", v).agg(F.count(F.lit(1)).alias("n")).select(F.lit(v).alias("version"), "n") for v in (1, 2)])


@query("store_conflict", "SELECT 'TXN001' AS code, 2 AS newest")
def _(spark, d):
    from strandix.errors import EngineError

    s = _store(spark)
    base = s.commit({"t": table(spark, d, "region")})
    s.commit({"t": table(spark, d, "region").limit(2)}, base)
    try:
        s.commit({"t": table(spark, d, "region").limit(1)}, base)
        code = "none"
    except EngineError as e:
        code = e.code
    return spark.createDataFrame([(code, s.newest())], "code string, newest int")


@query("ingest_idempotent", "SELECT doc_id, source FROM documents")
def _(spark, d):
    from strandix.sources.store import digest_of

    s = _store(spark)
    docs = table(spark, d, "documents").select("doc_id", "source")
    for k in (0, 1, 1, 2):  # the batches cover all documents; one is sent twice
        part = docs.filter(F.pmod("doc_id", F.lit(3)) == k)
        s.upsert("docs", part, "doc_id", request=f"batch-{k}", digest=digest_of(part))
    return s.table("docs")
