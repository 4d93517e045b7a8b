"""Fusion of ranked branches by reciprocal rank, and integrated search over text, vectors and document values."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandix.errors import EngineError
from strandix.operators import docvalues
from strandix.operators.lexical import bm25
from strandix.operators.structured import condition
from strandix.operators.vectors import METRICS, exact

RANK_BIAS, MAX_WEIGHT, MAX_BRANCHES, MAX_CANDIDATES = 60, 1_000_000, 16, 10_000


def ranked(hits: DataFrame, name: str, by: str, descending: bool = True, id: str = "id") -> DataFrame:
    """(id, rank) with ranks from 1. The hits are a branch's top-k, so the one partition of this window is small by contract."""
    order = F.col(by).desc() if descending else F.col(by).asc()
    return hits.select(F.col(id).alias("id"), F.row_number().over(Window.orderBy(order, F.col(id))).cast("bigint").alias(name))


def _merged(branches: dict[str, DataFrame]) -> DataFrame:
    parts = [b.select("id", *[(F.col(n) if n == name else F.lit(None).cast("bigint")).alias(n) for n in branches]) for name, b in branches.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(*[F.max(n).alias(n) for n in branches])


def fuse_int(branches: dict[str, DataFrame], weights: dict[str, int], limit: int, explain: bool = False) -> DataFrame:
    """(id, score_nanos, ranks): contributions floor(w * 10^9 / (60 + rank)), summed; score descending, then id."""
    if any(not 1 <= w <= MAX_WEIGHT for w in weights.values()):
        raise EngineError("HYB001", "weight out of range")
    parts = {n: F.expr(f"coalesce(({weights[n]} * 1000000000L) div ({RANK_BIAS} + `{n}`), 0L)") for n in branches}
    df = _merged(branches).withColumn("score_nanos", reduce(lambda a, c: a + c, parts.values()))
    for n, c in parts.items() if explain else ():
        df = df.withColumn(f"{n}_nanos", c)
    return df.orderBy(F.desc("score_nanos"), "id").limit(limit)


def fuse_float(branches: dict[str, DataFrame], weights: dict[str, float], limit: int | None) -> DataFrame:
    """(id, score, ranks): contributions w / (60 + rank), added in the order of the branches."""
    score = F.lit(0.0)
    for n in branches:
        score = score + F.coalesce(F.lit(float(weights[n])) / (RANK_BIAS + F.col(n)), F.lit(0.0))
    df = _merged(branches).withColumn("score", score).orderBy(F.desc("score"), "id")
    return df if limit is None else df.limit(limit)


@dataclass(frozen=True)
class VectorBranch:
    name: str
    table: DataFrame  # id, v
    query: list[float]
    metric: str = "l2"
    weight: float = 1.0
    k: int = 100


@dataclass
class Search:
    """An integrated request. `filter` is over document values; the lexical branch keeps ranks of the unfiltered list."""

    text: str | None = None
    text_weight: float = 1.0
    candidates: int = 100
    vectors: list[VectorBranch] = field(default_factory=list)
    filter: object = None
    sorts: list[docvalues.SortBy] = field(default_factory=list)
    facets: dict[str, int] = field(default_factory=dict)
    metrics: list[str] = field(default_factory=list)
    limit: int = 10


@dataclass
class Found:
    hits: DataFrame
    candidates: DataFrame
    facets: dict[str, DataFrame]
    metrics: dict[str, DataFrame]
    approximate: bool


def integrated(values: DataFrame, analyzed: DataFrame | None, s: Search) -> Found:
    """values: (id, document values). Facets, metrics and sorts are over the retrieved candidates.

    Vector branches search the eligible documents. The lexical branch is ranked first and filtered after, so that a
    hit keeps the rank that it has among all documents.
    """
    if len(s.vectors) > MAX_BRANCHES or s.candidates > MAX_CANDIDATES or s.limit > docvalues.HITS:
        raise EngineError("LIM008", "search over its limits")
    eligible = values if s.filter is None else values.filter(condition(s.filter, strict_types=True))
    ids = eligible.select("id")
    branches, weights = {}, {}
    if s.text is not None:
        top = ranked(bm25(analyzed, s.text, s.candidates).withColumnRenamed("doc_id", "id"), "lexical", "score")
        branches["lexical"], weights["lexical"] = (top if s.filter is None else top.join(ids, "id", "left_semi")), s.text_weight
    for b in s.vectors:
        if b.metric not in METRICS:
            raise EngineError("VEC001", b.metric)
        near = exact(b.table, b.query, b.metric, b.k, allow=ids if s.filter is not None else None, vid="id", col="v")
        branches[b.name], weights[b.name] = ranked(near, b.name, "distance", False), b.weight
    if branches:
        fused = fuse_float(branches, weights, None).join(eligible, "id")
    else:
        fused = eligible.withColumn("score", F.lit(0.0))
    hits = docvalues.hits(fused, s.sorts, s.limit, doc="id")
    return Found(hits, fused, {f: docvalues.facet(fused, f, n) for f, n in s.facets.items()}, {f: docvalues.metrics(fused, f) for f in s.metrics}, False)


def vector_policy(policy: str, count: int, threshold: int, requested: str | None = None) -> str:
    """exact or ann: a request overrides an adaptive policy; a fixed policy refuses another request."""
    if policy == "adaptive":
        return requested or ("exact" if count <= threshold else "ann")
    if requested is not None and requested != policy:
        raise EngineError("HYB002", f"the policy is {policy}")
    return policy
