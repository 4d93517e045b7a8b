"""The SQL dialect: grammar, admission, three-valued logic, changes, constraints, transactions."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandix.database import Database
from strandix.errors import EngineError
from strandix.plans import sql_parser as P


@pytest.fixture
def db(spark):
    db = Database(spark)
    db.register("t", spark.createDataFrame([(1, 1, "a", True), (1, 2, None, False), (2, 1, "b", None), (3, 5, "a", True)], "p long, q long, s string, b boolean"), ["p", "q"], {"t_s": ["s"], "t_b": ["b"]})
    return db


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("text", [
    "SELECT", "SELECT * FROM t", "SELECT p FROM t WHERE q > 3", "SELECT p FROM t WHERE 3 = q LIMIT 1", "SELECT p, FROM t LIMIT 1", "SELECT * FROM t LIMIT -1",
    "SELECT * FROM t LIMIT 1; SELECT", "SELECT t.p FROM t LIMIT 1", "DELETE FROM t", "CREATE TABLE x (a BIGINT)", "CREATE TABLE x (a BIGINT PRIMARY KEY, b BIGINT PRIMARY KEY)",
    "SELECT * FROM t ORDER BY p DESC LIMIT 1", "SELECT * FROM t LIMIT 1 OFFSET 2", "INSERT INTO t (p) VALUES (1, 2)", "EXPLAIN DELETE FROM t WHERE p = 1", "SELECT p FROM t WHERE (p, q) > (1) LIMIT 1",
])
def test_outside_the_grammar(text):
    with pytest.raises(EngineError, match="SQL001"):
        P.parse(text)


def test_precedence_is_not_and_or():
    s, _ = P.parse("SELECT * FROM t WHERE NOT p = 1 AND q = 2 OR q = 3 LIMIT 1")
    assert isinstance(s.where, P.Or) and isinstance(s.where.left, P.And) and isinstance(s.where.left.left, P.Not)


def test_three_valued_logic(db):
    assert rows(db.execute("SELECT p, q FROM t WHERE NOT s = 'a' LIMIT 9")) == [(2, 1)]
    assert rows(db.execute("SELECT p, q FROM t WHERE s = 'a' OR q = 2 LIMIT 9")) == [(1, 1), (1, 2), (3, 5)]
    assert rows(db.execute("SELECT p FROM t WHERE s = NULL LIMIT 9")) == []
    assert rows(db.execute("SELECT q FROM t WHERE s IS NULL LIMIT 9")) == [(2,)]


def test_row_comparison_is_unknown_after_an_unknown(db):
    assert rows(db.execute("SELECT p, q FROM t WHERE (p, q) > (1, 1) LIMIT 9")) == [(1, 2), (2, 1), (3, 5)]
    assert rows(db.execute("SELECT p, q FROM t WHERE (p, q) > (?, ?) LIMIT 9", [1, None])) == [(2, 1), (3, 5)]
    assert rows(db.execute("SELECT p, q FROM t WHERE (p, q) > (?, ?) LIMIT 9", [None, 1])) == []


@pytest.mark.parametrize("text,code", [
    ("SELECT x FROM t LIMIT 1", "SQL004"), ("SELECT p, P FROM t LIMIT 1", "SQL005"), ("SELECT p FROM t WHERE p = 'x' LIMIT 1", "SQL006"),
    ("SELECT p FROM t WHERE p = 1", "SQL008"), ("SELECT * FROM t ORDER BY q LIMIT 1", "SQL008"), ("SELECT * FROM u LIMIT 1", "SQL017"), ("SELECT * FROM t_s LIMIT 1", "SQL010"),
    ("SELECT p FROM t WHERE p = 1 AND q = 1 LIMIT 2", "SQL001"), ("SELECT p FROM t WHERE q = 1 AND q = 2", "SQL008"), ("SELECT p FROM t WHERE (p, q) = (1, 2) LIMIT 1", "SQL008"),
    ("SELECT p FROM t WHERE p = 1 AND q > 1 AND q > 2 LIMIT 1", "SQL008"), ("SELECT p FROM t WHERE s > 'a' AND s > 'b' LIMIT 1", "SQL014"),
])
def test_refusals(db, text, code):
    with pytest.raises(EngineError, match=code):
        db.execute(text)


@pytest.mark.parametrize("text,label", [
    ("SELECT * FROM t WHERE p = 1 AND q = 2", "PrimaryKeyLookup(table=1)"),
    ("SELECT * FROM t WHERE p = 1 AND q = 2 AND s = 'a'", "PrimaryKeyLookup(table=1,residual=true)"),
    ("SELECT * FROM t WHERE p = 1 LIMIT 4", "PrimaryKeyPrefixScan(table=1,columns=1,limit=4)"),
    ("SELECT * FROM t WHERE p = 1 AND q >= 2 LIMIT 4", "PrimaryKeyPrefixRangeScan(table=1,prefix_columns=1,range_column=2,lower=inclusive,upper=unbounded,limit=4)"),
    ("SELECT * FROM t WHERE (p, q) < (2, 2) LIMIT 4", "PrimaryKeyRangeScan(table=1,lower=unbounded,upper=exclusive,limit=4)"),
    ("SELECT * FROM t WHERE s = 'a'", "SecondaryIndexLookup(table=1,index=2)"),
    ("SELECT * FROM t WHERE s = 'a' AND b = TRUE LIMIT 3", "SecondaryIndexIntersection(table=1,indexes=[2,3],limit=3)"),
    ("SELECT * FROM t WHERE s > 'a' ORDER BY s LIMIT 3", "SecondaryIndexRangeScan(table=1,index=2,lower=exclusive,upper=unbounded,limit=3)"),
    ("SELECT * FROM t WHERE s IS NULL LIMIT 3", "PrimaryKeyScan(table=1,limit=3,residual=true)"),
])
def test_access_paths(db, text, label):
    assert rows(db.execute("EXPLAIN " + text)) == [(label,)]


def test_parameters_and_prepared_plans(db):
    p = db.prepare("SELECT p FROM t WHERE s = ?")
    assert rows(db.execute(p, ["b"])) == [(2,)] and p.statement_class == P.READ
    with pytest.raises(EngineError, match="SQL002"):
        db.execute(p, [])
    db.execute("CREATE INDEX t_q ON t (q)")
    with pytest.raises(EngineError, match="SQL003"):
        db.execute(p, ["b"])


def test_inverted_range_is_empty(db):
    assert rows(db.execute("SELECT p FROM t WHERE p = 1 AND q > 5 AND q < 2 LIMIT 4")) == []


def test_windows_and_cte(db):
    assert rows(db.execute("SELECT s, ROW_NUMBER() OVER (PARTITION BY p ORDER BY q) AS n FROM t ORDER BY p, q LIMIT 3")) == [("a", 1), (None, 2), ("b", 1)]
    assert rows(db.execute("WITH x AS (SELECT q, s FROM t WHERE p = 1 LIMIT 5) SELECT s FROM x LIMIT 1")) == [("a",)]
    with pytest.raises(EngineError, match="SQL008"):
        db.execute("SELECT s, RANK() OVER (ORDER BY q) AS n FROM t ORDER BY q LIMIT 3")


def test_changes_and_constraints(spark):
    db = Database(spark)
    db.execute("CREATE TABLE n (id BIGINT PRIMARY KEY, up BIGINT, name TEXT NOT NULL CHECK (name <> ''), FOREIGN KEY (up) REFERENCES n (id))")
    db.execute("CREATE UNIQUE INDEX n_name ON n (name)")
    assert db.execute("INSERT INTO n (id, up, name) VALUES (1, 1, 'root')") == 1
    assert db.execute("INSERT INTO n (id, up, name) VALUES (2, 1, 'leaf')") == 1
    for text, code in [("INSERT INTO n (id, name) VALUES (3, '')", "SQL015"), ("INSERT INTO n (id, name) VALUES (3, 'leaf')", "SQL012"), ("INSERT INTO n (id, up, name) VALUES (3, 9, 'x')", "SQL016"), ("DELETE FROM n WHERE id = 1", "SQL016"), ("INSERT INTO n (id) VALUES (3)", "SQL007"), ("UPDATE n SET id = 5 WHERE id = 2", "SQL013"), ("DROP TABLE n", "SQL016")]:
        with pytest.raises(EngineError, match=code):
            db.execute(text)
    assert db.execute("UPDATE n SET name = 'twig' WHERE id = 2") == 1
    assert db.execute("DELETE FROM n WHERE id = 7") == 0 and db.execute("DELETE FROM n WHERE id = 2") == 1
    assert rows(db.execute("SELECT * FROM n LIMIT 9")) == [(1, 1, "root")]
    db.execute("DROP INDEX n_name")
    db.execute("ALTER TABLE n RENAME TO m")
    assert rows(db.execute("SELECT id FROM m LIMIT 9")) == [(1,)]


def test_snapshots_and_first_committer_wins(spark):
    db = Database(spark)
    db.execute("CREATE TABLE a (id BIGINT PRIMARY KEY, v BIGINT NOT NULL)")
    db.execute("INSERT INTO a (id, v) VALUES (1, 10)")
    db.execute("INSERT INTO a (id, v) VALUES (2, 20)")
    old = db.state.csn
    one, two, other = db.begin(), db.begin(), db.begin()
    one.execute("UPDATE a SET v = 11 WHERE id = 1")
    two.execute("UPDATE a SET v = 12 WHERE id = 1")
    other.execute("UPDATE a SET v = 22 WHERE id = 2")
    assert rows(two.execute("SELECT v FROM a WHERE id = 1")) == [(12,)]
    one.commit()
    with pytest.raises(EngineError, match="TXN001"):
        two.commit()
    other.commit()
    assert rows(db.execute("SELECT v FROM a LIMIT 5")) == [(11,), (22,)]
    assert rows(db.begin(as_of=old).execute("SELECT v FROM a LIMIT 5")) == [(10,), (20,)]


def test_bounded_queries_only(db):
    with pytest.raises(EngineError, match="LIM001"):
        db.query("SELECT * FROM t WHERE s = 'a'")
    with pytest.raises(EngineError, match="LIM001"):
        db.query("SELECT * FROM t LIMIT 2000")
    assert len(db.query("SELECT * FROM t LIMIT 3")) == 3


def test_catalog_pages(db):
    page, cursor = db.state.catalog.list(limit=2)
    assert [o["name"] for o in page] == ["t", "t_s"] and cursor == 2
    rest, cursor = db.state.catalog.list(after=2)
    assert [o["name"] for o in rest] == ["t_b"] and cursor is None
    assert db.state.catalog.dependencies(1) == [2, 3]


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=60))
def test_parser_never_fails_otherwise(text):
    try:
        P.parse("SELECT * FROM t WHERE a = 1 AND " + text)
    except EngineError as e:
        assert e.code.startswith("SQL")
