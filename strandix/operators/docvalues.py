"""Document values of search hits: filters, sorts with missing placement, facets and metrics. Values are missing or there; none is null."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandix.errors import EngineError
from strandix.operators.structured import condition, measure

#: Ceilings of one request.
CANDIDATES, HITS, NODES, DEPTH, SORTS, FACETS, METRICS, TERMS = 100_000, 1_024, 128, 32, 8, 8, 16, 10_000


@dataclass(frozen=True)
class SortBy:
    field: str | None  # None: by score
    descending: bool = False
    missing_first: bool = False


def filtered(df: DataFrame, f) -> DataFrame:
    nodes, depth = measure(f)
    if nodes > NODES or depth > DEPTH:
        raise EngineError("LIM004", "filter too large")
    return df.filter(condition(f, strict_types=True))


def hits(df: DataFrame, sorts: list[SortBy], limit: int, doc: str = "doc_id", score: str = "score") -> DataFrame:
    """The first hits; where missing values stand does not depend on the direction; ties by document."""
    if len(sorts) > SORTS or limit > HITS:
        raise EngineError("LIM004", "too many sorts or hits")
    order: list[Column] = []
    for s in sorts or [SortBy(None, True)]:
        c = F.col(s.field or score)
        order.append((c.desc_nulls_first() if s.missing_first else c.desc_nulls_last()) if s.descending else (c.asc_nulls_first() if s.missing_first else c.asc_nulls_last()))
    return df.orderBy(*order, F.col(doc).asc()).limit(limit)


def facet(df: DataFrame, field: str, limit: int) -> DataFrame:
    """(value, count) of the most frequent values; missing values count nowhere."""
    if limit > TERMS:
        raise EngineError("LIM004", "too many facet terms")
    return df.filter(F.col(field).isNotNull()).groupBy(F.col(field).alias("value")).agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "value").limit(limit)


def metrics(df: DataFrame, field: str) -> DataFrame:
    """count, sum, min and max of one integer field over the matched documents."""
    c = F.col(field)
    return df.agg(F.count(c).alias("count"), F.sum(c.cast("decimal(38,0)")).alias("sum"), F.min(c).alias("min"), F.max(c).alias("max"))
