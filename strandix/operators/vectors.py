"""Vector search: exact distances and top-k, abstention, fixed-point retrieval, partitioned search with certified results."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandix.errors import EngineError

METRICS = ("cosine", "dot", "l2")
#: Queries of one batch, which the driver sends to every task.
QUERIES = 100_000


def _left_fold(terms: Column) -> Column:
    """A sum from left to right, so that it is the same bits everywhere."""
    return F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)


def distance(metric: str, v: Column, query: list[float]) -> Column:
    """Distance of a float array column to a query: 1 - cosine, negative dot product, or squared L2, in double precision."""
    if metric not in METRICS or not query or not all(math.isfinite(x) for x in query):
        raise EngineError("VEC001", "metric or query")
    q = F.array(*[F.lit(float(np.float32(x))) for x in query])
    if metric == "l2":
        return _left_fold(F.zip_with(v, q, lambda a, b: (a.cast("double") - b) * (a.cast("double") - b)))
    dot = _left_fold(F.zip_with(v, q, lambda a, b: a.cast("double") * b))
    if metric == "dot":
        return -dot
    norm = 0.0
    for x in query:
        norm += float(np.float32(x)) ** 2
    if norm == 0:
        raise EngineError("VEC002", "zero vector")
    own = _left_fold(F.transform(v, lambda a: a.cast("double") * a.cast("double")))
    return 1.0 - dot / (F.sqrt(own) * F.lit(math.sqrt(norm)))


def comparable(vectors: DataFrame, size: int, metric: str) -> DataFrame:
    """The rows whose vector v has a distance to others of its size: not null, of that size, all components finite, for cosine not zero."""
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))  # NaN is above every number
    ok = F.col("v").isNotNull() & (F.size("v") == size) & finite
    return vectors.filter(ok & F.exists("v", lambda x: x != 0) if metric == "cosine" else ok)


def exact(vectors: DataFrame, query: list[float], metric: str, k: int, allow: DataFrame | None = None, vid: str = "vec_id", col: str = "embedding") -> DataFrame:
    """(id, distance) of the nearest, by distance and id. With `allow` (a table with the id column), among those only."""
    df = comparable(vectors.select(F.col(vid).alias("id"), F.col(col).alias("v")), len(query), metric)
    if allow is not None:
        df = df.join(allow.select(F.col(vid).alias("id")), "id", "left_semi")
    return df.select("id", distance(metric, F.col("v"), query).alias("distance")).orderBy("distance", "id").limit(k)


def batch_exact(vectors: DataFrame, queries: DataFrame, metric: str, k: int, block: int = 4096) -> DataFrame:
    """(query_id, id, distance): many queries at once. queries: (query_id, v), a stated and bounded set that is broadcast.

    Each block of vectors meets the query matrix in one product and keeps k candidates a query; the rest is top-k.
    """
    rows = queries.limit(QUERIES + 1).collect()
    if len(rows) > QUERIES:
        raise EngineError("LIM007", "too many queries for one batch")
    if not rows:
        return vectors.select(F.lit(0).cast("bigint").alias("query_id"), F.col("id").cast("bigint"), F.lit(0.0).alias("distance"), F.lit(0).alias("rank")).limit(0)
    rows.sort(key=lambda r: r["query_id"])
    size = len(rows[0]["v"] or ())
    if any(r["v"] is None or len(r["v"]) != size or not all(x is not None and math.isfinite(x) for x in r["v"]) or metric == "cosine" and not any(r["v"]) for r in rows):
        raise EngineError("VEC001", "a query of the batch is no vector of its size")
    ids = np.array([r["query_id"] for r in rows], np.int64)
    q = np.array([r["v"] for r in rows], np.float64).reshape(len(rows), -1)
    held = vectors.sparkSession.sparkContext.broadcast((ids, q))

    def near(batches):
        ids, q = held.value
        qn = (q * q).sum(1)
        for pdf in batches:
            for lo in range(0, len(pdf), block):
                part = pdf.iloc[lo : lo + block]
                v = np.stack(part["v"].to_numpy()).astype(np.float64)
                dot = q @ v.T
                vn = (v * v).sum(1)
                d = -dot if metric == "dot" else qn[:, None] + vn[None, :] - 2 * dot if metric == "l2" else 1 - dot / np.sqrt(qn[:, None] * vn[None, :])
                n = min(k, d.shape[1])
                at = np.argpartition(d, n - 1, 1)[:, :n]
                # ties at the edge: all that are as near as the k-th stay
                edge = np.take_along_axis(d, at, 1).max(1)
                i, j = np.nonzero(d <= edge[:, None])
                yield pd.DataFrame({"query_id": ids[i], "id": part["id"].to_numpy()[j], "distance": d[i, j]})

    from pyspark.sql import Window

    found = comparable(vectors.select("id", "v"), size, metric).mapInPandas(near, "query_id long, id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def abstaining(hits: list, minimum_score: float, minimum_margin: float, limit: int) -> tuple[str, list]:
    """matches, no_candidates, below_threshold or ambiguous, checked in that order, for hits (id, score) from best to worst, one more than needed."""
    if not hits:
        return "no_candidates", []
    if hits[0][1] < minimum_score:
        return "below_threshold", []
    if len(hits) > 1 and hits[0][1] - hits[1][1] < minimum_margin:
        return "ambiguous", []
    return "matches", hits[:limit]


def cosine_with_abstention(vectors: DataFrame, query: list[float], limit: int, minimum_score: float = -1.0, minimum_margin: float = 0.0, vid: str = "vec_id", col: str = "embedding") -> tuple[str, list]:
    top = exact(vectors, query, "cosine", max(limit, 2), vid=vid, col=col).collect()
    return abstaining([(r["id"], 1.0 - r["distance"]) for r in top], minimum_score, minimum_margin, limit)


def q15(values: list[float]) -> list[int]:
    """Fixed-point components in -32767..32767."""
    return [max(-32767, min(32767, round(x * 32767))) for x in values]


def q15_nanos(a: list[int], b: list[int]) -> int:
    """Cosine of two fixed-point vectors in nanos: exact integers, integer square root, half rounded up, clamped."""
    if any(not -32767 <= x <= 32767 for x in (*a, *b)):
        raise EngineError("VEC003", "component out of range")
    norm = math.isqrt(sum(x * x for x in a) * sum(x * x for x in b))
    if norm == 0:
        raise EngineError("VEC002", "zero vector")
    dot = sum(x * y for x, y in zip(a, b))
    return max(-(10**9), min(10**9, (2 * dot * 10**9 + norm) // (2 * norm)))


def retrieve_q15(vectors: DataFrame, query: list[int], limit: int, vid: str = "vec_id", col: str = "q15") -> DataFrame:
    """(id, score_nanos) by score descending and id, as q15_nanos scores: exact integers of up to 38 digits throughout.

    Null vectors and those of another length or with a null component are never found; a zero vector or a component out
    of range is an error. The root is that of double precision, corrected by one where its square says so.
    """
    if any(not -32767 <= x <= 32767 for x in query):
        raise EngineError("VEC003", "component out of range")
    if not any(query):
        raise EngineError("VEC002", "zero vector")
    wide = lambda c: c.cast("decimal(38,0)")
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    v = F.transform(F.col(col), lambda x: x.cast("bigint"))
    rows = vectors.filter((F.size(col) == len(query)) & ~F.exists(col, lambda x: x.isNull())).select(F.col(vid).alias("id"), v.alias("v"))
    rows = rows.withColumn("v", F.when(F.exists("v", lambda x: F.abs(x) > 32767), F.raise_error(F.lit("component out of range")).cast("array<bigint>")).otherwise(F.col("v")))
    given = F.array(*[F.lit(x).cast("bigint") for x in query])
    rows = rows.select("id", wide(total(F.zip_with("v", given, lambda x, y: x * y))).alias("dot"), (wide(total(F.transform("v", lambda x: x * x))) * F.lit(sum(x * x for x in query)).cast("decimal(18,0)")).alias("square"))
    rows = rows.withColumn("square", wide(F.when(F.col("square") == 0, F.raise_error(F.lit("zero vector")).cast("decimal(38,0)")).otherwise(F.col("square"))))
    rows = rows.withColumn("root", wide(F.floor(F.sqrt(F.col("square").cast("double")))))
    rows = rows.withColumn("root", wide(F.expr("root + CASE WHEN root * root > square THEN -1 WHEN (root + 1) * (root + 1) <= square THEN 1 ELSE 0 END")))
    rows = rows.withColumn("over", wide(F.expr("2 * dot * 1000000000 + root"))).withColumn("under", wide(F.expr("2 * root")))
    rows = rows.withColumn("score", F.expr("(over - pmod(over, under)) div under"))
    score = F.greatest(F.lit(-(10**9)), F.least(F.lit(10**9), F.col("score"))).cast("bigint")
    return rows.select("id", score.alias("score_nanos")).orderBy(F.desc("score_nanos"), "id").limit(limit)


@dataclass
class Cells:
    """A partitioned index: the centres are bounded in number and fitted on a bounded sample; every vector is in a cell."""

    rows: DataFrame  # id, v, cell
    centres: np.ndarray
    radius: dict[int, float]
    metric: str


def build_cells(vectors: DataFrame, metric: str = "l2", cells: int = 16, sample: int = 20_000, rounds: int = 8, vid: str = "vec_id", col: str = "embedding") -> Cells:
    """Assigns every vector to its nearest centre. For cosine, vectors are normalised, where order by L2 is the same."""
    if metric not in ("l2", "cosine"):
        raise EngineError("VEC001", "cells need l2 or cosine")
    df = vectors.select(F.col(vid).alias("id"), F.transform(F.col(col), lambda x: x.cast("double")).alias("v"))
    if metric == "cosine":
        df = df.withColumn("v", F.transform("v", lambda x: x / F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, y: a + y * y))))
    got = np.array([r["v"] for r in df.orderBy(F.xxhash64("id")).limit(sample).collect()])
    if not len(got):
        raise EngineError("VEC004", "no vectors")
    centres = got[np.random.default_rng(7).choice(len(got), min(cells, len(got)), replace=False)]
    for _ in range(rounds):
        near = ((got[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        centres = np.stack([got[near == c].mean(0) if (near == c).any() else centres[c] for c in range(len(centres))])
    held = vectors.sparkSession.sparkContext.broadcast(centres)

    @F.pandas_udf("struct<cell:int,far:double>")
    def assign(v: pd.Series) -> pd.DataFrame:
        x, c = np.stack(v.to_numpy()), held.value
        d = np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * x @ c.T, 0)
        return pd.DataFrame({"cell": d.argmin(1).astype(np.int32), "far": np.sqrt(d.min(1))})

    rows = df.withColumn("a", assign("v")).select("id", "v", F.col("a.cell").alias("cell"), F.col("a.far").alias("far"))
    radius = {r["cell"]: r["far"] for r in rows.groupBy("cell").agg(F.max("far").alias("far")).collect()}
    return Cells(rows.drop("far"), centres, radius, metric)


def search_cells(index: Cells, query: list[float], k: int, probe: int = 1) -> tuple[list, dict]:
    """The k nearest and a receipt. Cells come by lower bound of distance, in groups that double; the search ends when
    the k-th distance is under the next cell's bound, so that the result is certified exact."""
    q = np.array(query, float)
    if index.metric == "cosine":
        q = q / np.sqrt((q * q).sum())
    d = np.sqrt(((index.centres - q) ** 2).sum(1))
    order = sorted(index.radius, key=lambda c: (max(0.0, d[c] - index.radius[c]), d[c], c))
    bound = [max(0.0, d[c] - index.radius[c]) - 1e-9 for c in order]
    best: list[tuple[float, int]] = []
    at, step = 0, probe
    while at < len(order):
        part = index.rows.filter(F.col("cell").isin([int(c) for c in order[at : at + step]]))
        for r in exact(part, list(q), "l2", k, vid="id", col="v").collect():
            best.append((r["distance"], r["id"]))
        best = sorted(set(best))[:k]
        at += step
        step *= 2
        if len(best) == k and at < len(order) and math.sqrt(best[-1][0]) < bound[at]:
            break
    hits = [(i, x / 2 if index.metric == "cosine" else x) for x, i in best]
    return hits, {"strategy": "cells", "visited_cells": min(at, len(order)), "cells": len(order), "certified": True}


def filtered_search(index: Cells, query: list[float], k: int, allow: DataFrame, few: int = 256) -> tuple[list, dict]:
    """Among the allowed ids: exactly over them if they are few, else through the cells with a semi join."""
    n = allow.limit(few + 1).count()
    rows = index.rows.join(allow.select(F.col(allow.columns[0]).alias("id")), "id", "left_semi")
    hits, receipt = search_cells(Cells(rows, index.centres, index.radius, index.metric), query, k, len(index.radius) if n <= few else 1)
    return hits, receipt | {"strategy": "eligible-exact" if n <= few else "eligible-cells"}


def upserted(base: DataFrame, delta: DataFrame, vid: str = "vec_id") -> DataFrame:
    """The effective vectors: base rows without a delta row, and the delta's rows that are not deletions (null vector)."""
    col = next(c for c in base.columns if c != vid)
    return base.select(vid, col).join(delta.select(vid), vid, "left_anti").unionByName(delta.filter(F.col(col).isNotNull()).select(vid, col))


def recall_ppm(found: list, exact_ids: list) -> int:
    """Share of the exact ids that were found, in millionths; an empty exact result counts as complete."""
    return 1_000_000 if not exact_ids else 1_000_000 * len(set(found) & set(exact_ids)) // len(exact_ids)
