"""Pages of a relation in primary-key order, between bounds and strictly after a cursor."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandix.errors import EngineError

MAX_PAGE = 4_096


@dataclass(frozen=True)
class Bound:
    """A complete key and whether it belongs to the page; no bound at all is None."""

    key: tuple
    included: bool = True


@dataclass(frozen=True)
class Page:
    rows: list
    #: Key of the last row if more rows follow, else None.
    cursor: tuple | None


def beyond(keys: list[str], value: tuple, up: bool, equal: bool) -> Column:
    """(k1, k2, ...) > value, or < value, as a chain that filters on the leading column reach the scan with."""
    if len(keys) != len(value):
        raise EngineError("SQL007", "a bound is a complete key")
    cols = [F.col(f"`{k}`") for k in keys]
    out = reduce(lambda a, b: a & b, [c == v for c, v in zip(cols, value)]) if equal else F.lit(False)
    for i, (c, v) in enumerate(zip(cols, value)):
        step = c > v if up else c < v
        out = out | reduce(lambda a, b: a & b, [x == y for x, y in zip(cols[:i], value[:i])] + [step])
    first = (cols[0] >= value[0]) if up else (cols[0] <= value[0])
    return first & out


def page_rows(df: DataFrame, keys: list[str], limit: int, low: Bound | None = None, high: Bound | None = None, after: tuple | None = None) -> DataFrame:
    """At most `limit` rows by key: a keyset page, so its cost does not grow with the pages before it."""
    if not 1 <= limit <= MAX_PAGE:
        raise EngineError("LIM009", "one to 4096 rows")
    return _ordered(df, keys, low, high, after).limit(limit)


def page(df: DataFrame, keys: list[str], limit: int, low: Bound | None = None, high: Bound | None = None, after: tuple | None = None) -> Page:
    """The rows of a page, owned by the caller, and the cursor of the next one."""
    if not 1 <= limit <= MAX_PAGE:
        raise EngineError("LIM009", "one to 4096 rows")
    rows = _ordered(df, keys, low, high, after).limit(limit + 1).collect()
    more, rows = len(rows) > limit, rows[:limit]
    return Page(rows, tuple(rows[-1][k] for k in keys) if more else None)


def _ordered(df: DataFrame, keys: list[str], low: Bound | None, high: Bound | None, after: tuple | None) -> DataFrame:
    if low is not None:
        df = df.filter(beyond(keys, low.key, True, low.included))
    if high is not None:
        df = df.filter(beyond(keys, high.key, False, high.included))
    if after is not None:
        df = df.filter(beyond(keys, after, True, False))
    return df.orderBy(*keys)
