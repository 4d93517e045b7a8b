"""Lexical retrieval: BM25, field-weighted BM25, and boolean matching of terms, phrases, prefixes and near spellings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandix.errors import EngineError
from strandix.functions.text import fold, query_terms, query_tokens, tokens
from strandix.operators.inverted import TextIndex
from strandix.sources.shared import written

K1, B = 1.2, 0.75
#: Ceilings of a boolean search.
MAX_HITS, MAX_CLAUSES, MAX_DEPTH, MAX_DISTANCE = 100, 64, 8, 2


def analyzed(docs: DataFrame, text: str = "text", doc: str = "doc_id", folder=fold) -> DataFrame:
    """(doc, tokens, len) of every document; the analysis of a corpus is worth writing as a table."""
    df = docs.select(F.col(doc).alias("doc_id"), tokens(folder(F.coalesce(F.col(text), F.lit("")))).alias("tokens"))
    return df.withColumn("len", F.size("tokens"))


def _count(toks: str | Column, term: str) -> Column:
    return F.size(F.filter(toks, lambda t: t == term))


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id, len, tf), a written table: tf has one count for each query term, in order. One pass without a shuffle.

    The tokens are bound once in each row, so that they are not cut anew for every term.
    """
    each = F.transform(F.array("tokens"), lambda t: F.struct(F.size(t).alias("len"), F.array(*[_count(t, q) for q in terms]).alias("tf")))
    return written(docs.select("doc_id", F.get(each, F.lit(0)).alias("c")).select("doc_id", "c.len", "c.tf"), "counts")


def bm25(docs: DataFrame | TextIndex, query: str, limit: int, allow: Column | DataFrame | None = None, k1: float = K1, b: float = B) -> DataFrame:
    """(doc_id, score) of the best matches: score descending, then document.

    `docs` is what `analyzed` gives, which is read whole, or a stored index, of which the terms' buckets are. The corpus statistics come from all of it; `allow` restricts the hits only.
    Contributions are added in byte order of the terms, so that scores do not depend on partitioning.
    """
    if isinstance(docs, TextIndex):
        return docs.bm25(query, limit, allow, k1, b)
    terms = query_terms(query)
    if not terms or limit <= 0:
        return docs.select("doc_id", F.lit(0.0).alias("score")).limit(0)
    counts = term_counts(docs, terms)
    stats = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("len").alias("total"), *[F.sum(F.when(F.get("tf", F.lit(i)) > 0, 1).otherwise(0)).alias(f"df{i}") for i in range(len(terms))])
    rows = counts.filter(F.exists("tf", lambda x: x > 0))
    if isinstance(allow, DataFrame):
        rows = rows.join(allow, "doc_id", "left_semi")
    elif allow is not None:
        rows = rows.filter(allow)
    rows = rows.crossJoin(F.broadcast(stats))  # one row of statistics
    norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("len") / (F.col("total") / F.col("n")))
    score = F.lit(0.0)
    for i in range(len(terms)):
        tf = F.get("tf", F.lit(i)).cast("double")
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        score = score + F.when(tf > 0, idf * tf * (k1 + 1) / (tf + norm)).otherwise(0.0)
    return rows.select("doc_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(limit)


@dataclass(frozen=True)
class Weighted:
    """A field of a field-weighted index: the column and its weight in millionths."""

    column: str
    weight_micros: int = 1_000_000


def bm25f(docs: DataFrame, query: str, fields: list[Weighted], limit: int, doc: str = "doc_id", folder=fold, k1: float = K1, b: float = B, explain: bool = False) -> DataFrame:
    """(doc_id, score_nanos): term counts of the fields are length-normalised and weighted before one saturation; each term's score is rounded to nanos.

    With explain, a column `terms` tells (term, df, score_nanos) and each field's count and length.
    """
    terms = query_terms(query)
    if not fields or len(fields) > 64:
        raise EngineError("LEX001", "one to 64 fields are needed")
    if not terms or limit <= 0:
        return docs.select(F.col(doc).alias("doc_id"), F.lit(0).cast("bigint").alias("score_nanos")).limit(0)
    df = docs.select(F.col(doc).alias("doc_id"), *[tokens(folder(F.coalesce(F.col(f.column).cast("string"), F.lit("")))).alias(f"f{j}") for j, f in enumerate(fields)])
    df = df.select("doc_id", *[F.size(f"f{j}").alias(f"len{j}") for j in range(len(fields))], *[_count(f"f{j}", q).alias(f"tf{i}_{j}") for i, q in enumerate(terms) for j in range(len(fields))])
    has = [reduce(lambda a, c: a | c, [F.col(f"tf{i}_{j}") > 0 for j in range(len(fields))]) for i in range(len(terms))]
    stats = df.agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"len{j}").alias(f"avg{j}") for j in range(len(fields))], *[F.sum(h.cast("int")).alias(f"df{i}") for i, h in enumerate(has)])
    df = df.filter(reduce(lambda a, c: a | c, has)).crossJoin(F.broadcast(stats))
    nanos = []
    for i in range(len(terms)):
        tf = F.lit(0.0)
        for j, f in enumerate(fields):
            norm = F.lit(1.0 - b) + F.lit(b) * F.col(f"len{j}") / F.greatest(F.col(f"avg{j}"), F.lit(1e-12))
            tf = tf + F.when(F.col(f"tf{i}_{j}") > 0, F.lit(f.weight_micros / 1e6) * F.col(f"tf{i}_{j}") / norm).otherwise(0.0)
        idf = F.log(1 + (F.col("n") - F.col(f"df{i}") + 0.5) / (F.col(f"df{i}") + 0.5))
        nanos.append(F.round(idf * tf * (k1 + 1) / (tf + k1) * 1e9).cast("bigint"))
    cols = ["doc_id", reduce(lambda a, c: a + c, nanos).alias("score_nanos")]
    if explain:
        parts = [F.struct(F.lit(q).alias("term"), F.col(f"df{i}").alias("df"), nanos[i].alias("score_nanos"), F.array(*[F.struct(F.col(f"tf{i}_{j}").alias("tf"), F.col(f"len{j}").alias("len")) for j in range(len(fields))]).alias("fields")) for i, q in enumerate(terms)]
        cols.append(F.array(*parts).alias("terms"))
    return df.select(*cols).filter("score_nanos > 0").orderBy(F.desc("score_nanos"), "doc_id").limit(limit)


@dataclass(frozen=True)
class Outcome:
    """A result, or why there is none."""

    hits: list
    reason: str | None
    scanned: int
    tokens: int


def retrieve(docs: DataFrame, query: str, limit: int) -> Outcome:
    """BM25 hits; without any, the reason with what was scanned."""
    hits = bm25(docs, query, limit).collect()
    n, total = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum("len"), F.lit(0))).first()
    return Outcome(hits, None if hits else "no_candidates", n, total)


# -- boolean matching: each clause is an integer score, 0 if it does not match


@dataclass(frozen=True)
class Term:
    text: str


@dataclass(frozen=True)
class Phrase:
    text: str


@dataclass(frozen=True)
class StartsWith:
    text: str


@dataclass(frozen=True)
class Fuzzy:
    text: str
    distance: int


@dataclass(frozen=True)
class Bool:
    must: tuple = ()
    should: tuple = ()
    must_not: tuple = ()


def _one(text: str) -> str:
    terms = query_terms(text)
    if len(terms) != 1:
        raise EngineError("LEX002", "exactly one token is needed")
    return terms[0]


def clause_score(q, toks: Column) -> Column:
    if isinstance(q, Term):
        return F.array_contains(toks, _one(q.text)).cast("int")
    if isinstance(q, StartsWith):
        p = _one(q.text)
        return F.exists(toks, lambda t: t.startswith(F.lit(p))).cast("int")
    if isinstance(q, Fuzzy):
        if not 0 <= q.distance <= MAX_DISTANCE:
            raise EngineError("LEX002", "distance over 2")
        w = _one(q.text)
        near = F.filter(toks, lambda t: F.abs(F.length(t) - len(w)) <= q.distance)
        return F.exists(near, lambda t: F.levenshtein(t, F.lit(w)) <= q.distance).cast("int")
    if isinstance(q, Phrase):
        words = query_tokens(q.text)
        if not words:
            raise EngineError("LEX002", "empty phrase")
        starts = F.filter(F.transform(toks, lambda t, i: F.when(t == words[0], i)), lambda i: i.isNotNull())
        hit = F.exists(starts, lambda i: reduce(lambda a, c: a & c, [F.coalesce(F.get(toks, i + k) == w, F.lit(False)) for k, w in enumerate(words[1:], 1)], F.lit(True)))
        return hit.cast("int")
    must = [clause_score(c, toks) for c in q.must]
    should = [clause_score(c, toks) for c in q.should]
    ok = reduce(lambda a, c: a & c, [m > 0 for m in must] + [clause_score(c, toks) == 0 for c in q.must_not], F.lit(True))
    if not must:
        ok = ok & reduce(lambda a, c: a | c, [s > 0 for s in should], F.lit(False))
    total = reduce(lambda a, c: a + c, must + should, F.lit(0))
    return F.when(ok, F.greatest(total, F.lit(1))).otherwise(0)


def clauses(q) -> tuple[int, int]:
    if not isinstance(q, Bool):
        return 1, 1
    kids = [clauses(c) for c in (*q.must, *q.should, *q.must_not)]
    return sum(k[0] for k in kids), 1 + max([0, *(k[1] for k in kids)])


def boolean_search(docs: DataFrame, q, limit: int) -> DataFrame:
    """(doc_id, score): matches by score descending, then document."""
    n, depth = clauses(q)
    if limit > MAX_HITS or n > MAX_CLAUSES or depth > MAX_DEPTH:
        raise EngineError("LIM006", "boolean search over its limits")
    scored = docs.select("doc_id", clause_score(q, F.col("tokens")).cast("bigint").alias("score"))
    return scored.filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(limit)
