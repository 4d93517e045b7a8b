"""Registered queries of the structures' outcomes and lives, their adapters for convergence, and relational pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandix.operators import convergence as cv
from strandix.operators import pages as pg
from strandix.operators import structures as st
from strandix.plans.catalog_queries import query
from strandix.sources.tables import table


def _no_expiry():
    return F.lit(None).cast("bigint").alias("expiry")


# -- lives of whole structures and of fields

_LIVES = """
WITH o AS (SELECT user_id AS key, event_id AS seq, event_type AS field, value,
  CASE WHEN event_id % 97 = 0 THEN 'delete' WHEN event_id % 31 = 0 THEN 'create' WHEN event_id % 29 = 0 THEN 'expire' ELSE 'put' END AS op FROM events),
x AS (SELECT *, CASE WHEN op = 'expire' THEN seq * 12 END AS expiry FROM o),
c AS (SELECT key, max(seq) AS cut FROM x WHERE op IN ('create', 'delete') GROUP BY key),
r AS (SELECT x.*, row_number() OVER (PARTITION BY x.key, field ORDER BY seq DESC) AS n FROM x LEFT JOIN c ON x.key = c.key WHERE op = 'put' AND (cut IS NULL OR seq > cut)),
e AS (SELECT key, expiry FROM (SELECT key, expiry, row_number() OVER (PARTITION BY key ORDER BY seq DESC) AS n FROM x WHERE op <> 'put') WHERE n = 1),
d AS (SELECT key, arg_max(op, seq) AS op FROM x WHERE op <> 'expire' GROUP BY key),
l AS (SELECT d.key, expiry FROM d LEFT JOIN e ON e.key = d.key WHERE d.op <> 'delete' AND (expiry IS NULL OR expiry > 60000))
"""


def _lives_log(spark, d):
    """Events that put, and now and then make a user's hash anew, delete it or give it an expiry."""
    i = F.col("event_id")
    op = F.when(i % 97 == 0, "delete").when(i % 31 == 0, "create").when(i % 29 == 0, "expire").otherwise("put")
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), i.alias("seq"), F.col("event_type").alias("field"), "value", op.alias("op"))
    return e.withColumn("expiry", F.when(F.col("op") == "expire", F.col("seq") * 12))


@query("str_structure_expiry", _LIVES + "SELECT r.key, r.field, r.value FROM r JOIN l ON l.key = r.key WHERE r.n = 1")
def _(spark, d):
    return st.live_members(_lives_log(spark, d), 60_000).select("key", "field", "value")


@query("str_structure_ttl", _LIVES + "SELECT key, CASE WHEN expiry IS NULL THEN 'persistent' ELSE (expiry - 60000)::VARCHAR END AS ttl FROM l")
def _(spark, d):
    return st.headers(_lives_log(spark, d), 60_000).select("key", st.ttl("expiry", 60_000).alias("ttl"))


@query("str_set_card", _LIVES + "SELECT l.key, count(r.field) AS n FROM l LEFT JOIN r ON r.key = l.key AND r.n = 1 GROUP BY l.key")
def _(spark, d):
    log = _lives_log(spark, d)
    return st.cardinality(st.headers(log, 60_000), st.live_members(log, 60_000))


@query("str_stream_lives", _LIVES + """, s AS (SELECT x.key, x.seq, x.field, row_number() OVER (PARTITION BY x.key ORDER BY x.seq) AS entry_id
  FROM x LEFT JOIN c ON x.key = c.key WHERE op = 'put' AND (cut IS NULL OR seq > cut))
SELECT s.key, s.entry_id, s.field AS event_type FROM s JOIN l ON l.key = s.key""")
def _(spark, d):
    log = _lives_log(spark, d).withColumn("op", F.when(F.col("op") == "put", "append").otherwise(F.col("op"))).withColumn("fields", F.create_map(F.lit("type"), F.col("field")))
    return st.live_entries(log, 60_000).select("key", "entry_id", F.col("fields")["type"].alias("event_type"))


@query("str_field_expiry", """
WITH o AS (SELECT user_id AS key, event_type AS field, event_id AS seq, value,
  CASE WHEN event_id % 13 = 0 THEN 'remove' WHEN event_id % 5 = 0 THEN 'expire' ELSE 'put' END AS op FROM events),
x AS (SELECT *, CASE WHEN op = 'expire' THEN seq + 2500 WHEN op = 'put' AND seq % 7 = 0 THEN seq + 1500 END AS expiry FROM o),
w AS (SELECT *, sum(CASE WHEN op = 'expire' THEN 0 ELSE 1 END) OVER p AS life, lag(expiry) OVER p AS before_it FROM x WINDOW p AS (PARTITION BY key, field ORDER BY seq)),
f AS (SELECT *, first_value(op) OVER q AS made, first_value(value) OVER q AS held, row_number() OVER (PARTITION BY key, field ORDER BY seq DESC) AS n,
  max(CASE WHEN op = 'expire' AND before_it <= seq THEN 1 ELSE 0 END) OVER (PARTITION BY key, field, life) AS late FROM w WINDOW q AS (PARTITION BY key, field, life ORDER BY seq))
SELECT key, field, held AS value, CASE WHEN expiry IS NULL THEN 'persistent' ELSE (expiry - 5000)::VARCHAR END AS ttl FROM f WHERE n = 1 AND made = 'put' AND late = 0 AND (expiry IS NULL OR expiry > 5000)""")
def _(spark, d):
    i = F.col("event_id")
    e = table(spark, d, "events").select(F.col("user_id").alias("key"), F.col("event_type").alias("field"), i.alias("seq"), i.alias("at"), "value", F.when(i % 13 == 0, "remove").when(i % 5 == 0, "expire").otherwise("put").alias("op"))
    log = e.withColumn("expiry", F.when(F.col("op") == "expire", F.col("seq") + 2500).when((F.col("op") == "put") & (F.col("seq") % 7 == 0), F.col("seq") + 1500))
    return st.fold_expiring(log, 5_000).select("key", "field", "value", st.ttl("expiry", 5_000).alias("ttl"))


@query("str_expire_sweep", "SELECT key, expiry, (row_number() OVER (ORDER BY expiry, key) - 1) // 7 AS round FROM (SELECT user_id AS key, min(event_id) // 10 AS expiry FROM events GROUP BY 1) WHERE expiry <= 50")
def _(spark, d):
    header = table(spark, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.floor(F.min("event_id") / 10).cast("bigint").alias("expiry"))
    return st.sweep(header, 50, 7)[0].select("key", "expiry", "round")


# -- what operations return


@query("str_set_outcomes", """
WITH e AS (SELECT event_type AS key, user_id::VARCHAR AS field, event_id AS seq, CASE WHEN event_id % 4 = 0 THEN 'remove' ELSE 'put' END AS op FROM events),
p AS (SELECT *, coalesce(lag(op) OVER (PARTITION BY key, field ORDER BY seq) = 'put', false) AS held FROM e)
SELECT key, count(*) FILTER (WHERE op = 'put' AND NOT held) AS added, count(*) FILTER (WHERE op = 'remove' AND held) AS removed FROM p GROUP BY key""")
def _(spark, d):
    op = F.when(F.col("event_id") % 4 == 0, "remove").otherwise("put").alias("op")
    log = table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("field"), F.col("event_id").alias("seq"), op, _no_expiry(), F.col("event_id").alias("at"))
    return st.outcomes(log).groupBy("key").agg(*[F.count(F.when(F.col(c), 1)).alias(c) for c in ("added", "removed")])


def _score_log(spark, d):
    i = F.col("event_id")
    return table(spark, d, "events").select(F.col("event_type").alias("key"), F.col("user_id").alias("member"), i.alias("seq"), F.when(i % 6 == 0, "remove").otherwise("add").alias("op"), (i % 4).cast("double").alias("score"))


_SCORES = "WITH o AS (SELECT event_type AS key, user_id AS member, event_id AS seq, CASE WHEN event_id % 6 = 0 THEN 'remove' ELSE 'add' END AS op, (event_id % 4)::DOUBLE AS score FROM events)"


@query("str_zset_outcomes", _SCORES + """, p AS (SELECT *, lag(op) OVER w AS was, lag(score) OVER w AS old FROM o WINDOW w AS (PARTITION BY key, member ORDER BY seq)),
q AS (SELECT key, CASE WHEN op = 'add' AND was IS DISTINCT FROM 'add' THEN 'added' WHEN op = 'add' AND old = score THEN 'unchanged' WHEN op = 'add' THEN 'updated' WHEN was = 'add' THEN 'removed' ELSE 'missing' END AS outcome FROM p)
SELECT key, outcome, count(*) AS n FROM q GROUP BY ALL""")
def _(spark, d):
    return st.z_outcomes(_score_log(spark, d)).groupBy("key", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("str_zset_fold", _SCORES + " SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key, member ORDER BY seq DESC) AS n FROM o) WHERE n = 1 AND op = 'add'")
def _(spark, d):
    return st.fold_scores(_score_log(spark, d))


@query("str_list_push_lengths", "SELECT conv_id AS key, turn AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS length FROM conversations")
def _(spark, d):
    return st.push_lengths(table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq")))


@query("str_list_len", "SELECT conv_id AS key, count(*) AS n FROM conversations GROUP BY 1")
def _(spark, d):
    log = table(spark, d, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.lit("right").alias("side"), F.col("text").alias("value"), F.lit("push").alias("op"), _no_expiry())
    return st.cardinality(st.headers(log, 0), st.pushed_list(log))


@query("str_list_rpop", "SELECT conv_id::VARCHAR AS key, last(text ORDER BY turn) AS value FROM conversations GROUP BY conv_id")
def _(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("key"), "turn", "text")
    push = c.select("key", F.col("turn").alias("seq"), F.lit("rpush").alias("op"), F.col("text").alias("value"))
    pop = c.select("key").distinct().select("key", F.lit(1 << 40).alias("seq"), F.lit("rpop").alias("op"), F.lit(None).cast("string").alias("value"))
    return st.fold_list(push.unionByName(pop)).filter("popped").select("key", "value")


@query("str_counter_get", "SELECT a.position, a.key, coalesce(o.o_custkey, 0) AS value FROM (SELECT unnest(range(4))::INT AS position, unnest(['2', 'absent', '1', '2']) AS key) a LEFT JOIN orders o ON o.o_orderkey::VARCHAR = a.key")
def _(spark, d):
    state = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("key"), F.col("o_custkey").cast("string").alias("value"))
    return st.counters_of(state, ["2", "absent", "1", "2"])


@query("str_hash_scan_match", """
WITH f AS (SELECT c_name AS field, row_number() OVER (ORDER BY c_name) AS n, c_custkey % 5 <> 0 AS alive FROM customer WHERE c_nationkey = 3),
h AS (SELECT *, row_number() OVER (ORDER BY n) AS k FROM f WHERE n <= 30 AND alive AND regexp_full_match(field, '.*[1-6].')),
s AS (SELECT (SELECT max(n) FROM h WHERE k = 8) AS eighth, (SELECT count(*) FROM f) AS total)
SELECT h.field, CASE WHEN eighth IS NOT NULL THEN (SELECT field FROM f WHERE n = eighth) WHEN total > 30 THEN (SELECT field FROM f WHERE n = 30) END AS cursor,
  CASE WHEN eighth IS NOT NULL THEN 'output' WHEN total > 30 THEN 'visit' ELSE 'exhausted' END AS stop FROM h, s WHERE k <= 8""")
def _(spark, d):
    fields = table(spark, d, "customer").select(F.col("c_nationkey").alias("key"), F.col("c_name").alias("field"), F.when(F.col("c_custkey") % 5 == 0, F.lit(10)).cast("bigint").alias("expiry"))
    got = st.scan_match(fields, 3, "*[1-6]?", 10, 8, 30)
    return spark.createDataFrame([(r["field"], got.cursor, got.stop) for r in got.rows], "field string, cursor string, stop string")


@query("str_scalar_filter", "SELECT doc_id FROM documents WHERE lang = 'en' AND doc_id % 4 <> 0")
def _(spark, d):
    strings = table(spark, d, "documents").select(F.concat(F.lit("lang:"), F.col("doc_id").cast("string")).alias("key"), F.col("lang").alias("value"), F.when(F.col("doc_id") % 4 == 0, F.lit(5)).cast("bigint").alias("expiry"))
    return st.allowed_by(strings, "lang:", "en", 5)


# -- convergence over structures


@query("cnv_structures", """
WITH z AS (SELECT n_nationkey, n_name, n_regionkey FROM nation)
SELECT n_name AS object_id, n_regionkey::VARCHAR AS hash, NULL::DOUBLE AS member, NULL::DOUBLE AS element, n_nationkey::DOUBLE AS score, n_nationkey::VARCHAR AS scalar, n_name AS entry
FROM z WHERE n_regionkey <> 2 AND n_nationkey % 5 <> 4""")
def _(spark, d):
    n = table(spark, d, "nation")
    one = F.lit("k").alias("key")
    name = F.col("n_name")
    sources = [
        cv.hash_source("hash", n.select(one, name.alias("field"), F.col("n_regionkey").cast("string").alias("value")), "k"),
        cv.set_source("member", n.filter("n_regionkey <> 2").select(one, name.alias("member")), "k"),
        cv.list_source("element", n.filter("n_nationkey % 5 <> 4").select(one, name.alias("value")), "k"),
        cv.sorted_set_source("score", n.select(one, name.alias("member"), F.col("n_nationkey").cast("double").alias("score")), "k"),
        cv.scalar_source("scalar", n.select(name.alias("key"), F.col("n_nationkey").cast("string").alias("value"))),
        cv.stream_source("entry", n.select(one, F.col("n_nationkey").alias("entry_id"), F.create_map(name, name).alias("fields")), "k"),
    ]
    return cv.converge(sources).rows


# -- relational pages


@query("src_relational_page", """
SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_orderkey > 10 OR (l_orderkey = 10 AND l_linenumber >= 2))
  AND (l_orderkey < 4000 OR (l_orderkey = 4000 AND l_linenumber < 3)) AND (l_orderkey > 37 OR (l_orderkey = 37 AND l_linenumber > 1)) ORDER BY l_orderkey, l_linenumber LIMIT 200""")
def _(spark, d):
    keys = ["l_orderkey", "l_linenumber"]
    return pg.page_rows(table(spark, d, "lineitem"), keys, 200, pg.Bound((10, 2)), pg.Bound((4000, 3), False), (37, 1)).select(*keys, "l_quantity")
