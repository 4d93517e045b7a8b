"""Convergence: sources of every model joined on one object id, with exact aggregates."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandix.errors import EngineError

MAX_SOURCES, MAX_ROWS, MAX_AGGREGATES = 16, 10_000, 32
#: Rows that a source may give unless it says otherwise.
DEFAULT_ROWS = 1_000


@dataclass
class Source:
    """rows: (object_id, value). kind tells what the value is: bytes, missing, score, or distance (negated)."""

    name: str
    rows: DataFrame
    kind: str = "score"
    cap: int = DEFAULT_ROWS
    strategy: str = "scan"


@dataclass
class Converged:
    rows: DataFrame
    explain: list[dict] = field(default_factory=list)


def scalar_source(name: str, strings: DataFrame, cap: int = DEFAULT_ROWS) -> Source:
    """Every string: (key, its bytes)."""
    return Source(name, strings.select(F.col("key").alias("object_id"), "value"), "bytes", cap, "scalar")


def hash_source(name: str, state: DataFrame, key, cap: int = DEFAULT_ROWS) -> Source:
    """The fields of one hash: (field, its bytes)."""
    return Source(name, state.filter(F.col("key") == key).select(F.col("field").alias("object_id"), "value"), "bytes", cap, "hash")


def stream_source(name: str, entries: DataFrame, key, cap: int = DEFAULT_ROWS) -> Source:
    """The fields of one stream's entries, exploded: (field, its bytes). A field in two entries is a repeated id."""
    rows = entries.filter(F.col("key") == key).select(F.explode("fields").alias("object_id", "value"))
    return Source(name, rows, "bytes", cap, "stream")


def set_source(name: str, state: DataFrame, key, cap: int = DEFAULT_ROWS) -> Source:
    """The members of one set; they carry no value."""
    return Source(name, state.filter(F.col("key") == key).select(F.col("member").alias("object_id"), F.lit(None).alias("value")), "missing", cap, "set")


def list_source(name: str, state: DataFrame, key, cap: int = DEFAULT_ROWS) -> Source:
    """The elements of one list; they carry no value, and one that is there twice is a repeated id."""
    return Source(name, state.filter(F.col("key") == key).select(F.col("value").alias("object_id"), F.lit(None).alias("value")), "missing", cap, "list")


def sorted_set_source(name: str, state: DataFrame, key, cap: int = DEFAULT_ROWS) -> Source:
    """The members of one sorted set: (member, score)."""
    return Source(name, state.filter(F.col("key") == key).select(F.col("member").alias("object_id"), F.col("score").alias("value")), "score", cap, "sorted set")


def source_column(s: Source):
    v = F.col("value")
    if s.kind == "missing":
        return F.lit(None).cast("double")
    if s.kind == "bytes":
        return v.cast("string")
    return -v.cast("double") if s.kind == "distance" else v.cast("double")


def converge(sources: list[Source], check: bool = True) -> Converged:
    """One row for every object that all sources hold, by id; columns in the sources' order. Caps and repeated ids are errors."""
    if not 1 <= len(sources) <= MAX_SOURCES or any(s.cap > MAX_ROWS for s in sources):
        raise EngineError("CNV001", "sources over their limits")
    parts, explain = [], []
    for s in sources:
        rows = s.rows.select("object_id", source_column(s).alias(s.name))
        if check:
            n, ids = rows.limit(s.cap + 1).agg(F.count(F.lit(1)), F.countDistinct("object_id")).first()
            if n > s.cap:
                raise EngineError("CNV002", f"{s.name} has more than {s.cap} rows")
            if n != ids:
                raise EngineError("CNV003", f"{s.name} repeats an object id")
            explain.append({"source": s.name, "strategy": s.strategy, "rows": n})
        parts.append(rows)
    return Converged(reduce(lambda a, b: a.join(b, "object_id"), parts).orderBy("object_id"), explain)


_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def aggregate(rows: DataFrame, columns: list[str], text: tuple[str, ...] = ()) -> DataFrame:
    """count, sum, min and max of each column in double precision; the sum is folded in id order, so it is the same bits everywhere.

    Columns in `text` hold decimal text. The input is a converged table, bounded by its sources' caps. A value or
    result that is not finite is an error; an empty input gives null.
    """
    if len(columns) > MAX_AGGREGATES:
        raise EngineError("CNV001", "too many aggregates")
    out = []
    for c in columns:
        v = F.when(F.col(c).rlike(_NUMBER), F.col(c).cast("double")).when(F.col(c).isNotNull(), F.raise_error(F.lit(f"{c}: not a number"))) if c in text else F.col(c)
        v = v.cast("double")
        v = F.when(F.isnan(v) | (F.abs(v) == float("inf")), F.raise_error(F.lit(f"{c}: not finite")).cast("double")).otherwise(v)
        ordered = F.array_sort(F.collect_list(F.when(v.isNotNull(), F.struct("object_id", v.alias("v")))))
        out += [F.count(v).alias(f"{c}_count"), F.when(F.count(v) > 0, F.aggregate(ordered, F.lit(0.0), lambda a, x: a + x["v"])).alias(f"{c}_sum"), F.min(v).alias(f"{c}_min"), F.max(v).alias(f"{c}_max")]
    return rows.agg(*out)


def number_text(text: str) -> bool:
    return re.match(_NUMBER, text) is not None
