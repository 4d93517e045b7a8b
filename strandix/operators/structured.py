"""Structured record queries: filter trees, sorts with explicit null placement, keyset cursors, groups and metrics.

A field is (presence, value): a field that is missing differs from one that is null. Filters have two truth values:
a comparison with a missing field is false, also for !=, and NOT turns false into true.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandix.errors import EngineError


@dataclass(frozen=True)
class Limits:
    scanned: int = 1_000_000
    matched: int = 100_000
    returned: int = 1_000
    groups: int = 10_000
    filter_nodes: int = 256
    filter_depth: int = 64
    sorts: int = 16
    group_fields: int = 8
    metrics: int = 32


@dataclass(frozen=True)
class Field:
    """A resolved path: a column, and a column that tells whether the path is there (always, if None)."""

    value: Column
    present: Column | None = None

    @property
    def there(self) -> Column:
        return F.lit(True) if self.present is None else F.coalesce(self.present, F.lit(False))


def field_of(name: str) -> Field:
    if not name or any(not part for part in name.split(".")):
        raise EngineError("QRY001", f"field path {name!r} has an empty part")
    return Field(F.col(name))


def json_field(column: str, path: str, kind: str) -> Field:
    """A path inside a JSON text: present if the key is there, even with null."""
    field_of(path)
    doc = F.try_parse_json(F.col(column))
    return Field(F.try_variant_get(doc, f"$.{path}", kind), F.try_variant_get(doc, f"$.{path}", "variant").isNotNull())


@dataclass(frozen=True)
class Exists:
    field: Field


@dataclass(frozen=True)
class Compare:
    field: Field
    op: str
    value: object
    same_type: bool = True  # whether the value is of the field's type; else = is false and != is true


@dataclass(frozen=True)
class Prefix:
    field: Field
    value: str | bytes


@dataclass(frozen=True)
class Contains:
    field: Field
    value: object
    array: bool = False


@dataclass(frozen=True)
class All:
    terms: tuple


@dataclass(frozen=True)
class Any:
    terms: tuple


@dataclass(frozen=True)
class Not:
    term: object


def condition(f, strict_types: bool = False) -> Column:
    """A filter as a column that is never null. strict_types: != also needs the same type (document values)."""
    if isinstance(f, All):
        return reduce(lambda a, b: a & b, [condition(t, strict_types) for t in f.terms], F.lit(True))
    if isinstance(f, Any):
        return reduce(lambda a, b: a | b, [condition(t, strict_types) for t in f.terms], F.lit(False))
    if isinstance(f, Not):
        return ~condition(f.term, strict_types)
    there = f.field.there
    if isinstance(f, Exists):
        return there
    v = f.field.value
    if isinstance(f, Prefix):
        return there & F.coalesce(v.startswith(F.lit(f.value)), F.lit(False))
    if isinstance(f, Contains):
        hit = F.array_contains(v, f.value) if f.array else v.contains(F.lit(f.value))
        return there & F.coalesce(hit, F.lit(False))
    if not f.same_type:
        return there & F.lit(f.op == "!=" and not strict_types)
    if f.value is None:
        same = v.isNull()
        return there & {"=": same, "!=": ~same, "<=": same, ">=": same}.get(f.op, F.lit(False))
    # A present null is of another type than any value: unequal to it, and in no order with it.
    unequal = F.coalesce(v != F.lit(f.value), F.lit(not strict_types))
    ops = {"=": v == F.lit(f.value), "!=": unequal, "<": v < F.lit(f.value), "<=": v <= F.lit(f.value), ">": v > F.lit(f.value), ">=": v >= F.lit(f.value)}
    return there & F.coalesce(ops[f.op], F.lit(False))


def measure(f, depth: int = 1) -> tuple[int, int]:
    """(nodes, depth) of a filter."""
    kids = f.terms if isinstance(f, (All, Any)) else (f.term,) if isinstance(f, Not) else ()
    sizes = [measure(k, depth + 1) for k in kids]
    return 1 + sum(s[0] for s in sizes), max([depth, *(s[1] for s in sizes)])


@dataclass(frozen=True)
class Sort:
    name: str
    descending: bool = False
    nulls_first: bool = False


def ordering(sorts: list[Sort], key: str) -> list[Column]:
    out = []
    for s in sorts:
        c = F.col(s.name)
        out.append((c.desc_nulls_first() if s.nulls_first else c.desc_nulls_last()) if s.descending else (c.asc_nulls_first() if s.nulls_first else c.asc_nulls_last()))
    return [*out, F.col(key).asc()]


def after(sorts: list[Sort], key: str, cursor: tuple) -> Column:
    """Rows strictly after the cursor's (sort values..., key) in the order of `sorts` and then key, ascending."""

    def steps(c: Column, v, descending: bool, nulls_first: bool) -> tuple[Column, Column]:
        """(strictly after, equal) on one field."""
        if v is None:
            return (c.isNotNull() if nulls_first else F.lit(False)), c.isNull()
        beyond = F.coalesce(c < F.lit(v) if descending else c > F.lit(v), F.lit(False))
        return (beyond if nulls_first else beyond | c.isNull()), F.coalesce(c == F.lit(v), F.lit(False))

    out = F.col(key) > F.lit(cursor[-1])
    for s, v in list(zip(sorts, cursor[:-1], strict=True))[::-1]:
        beyond, same = steps(F.col(s.name), v, s.descending, s.nulls_first)
        out = beyond | (same & out)
    return out


@dataclass(frozen=True)
class Metric:
    name: str
    op: str  # count, sum, min, max
    field: Field | None = None


def metric_column(m: Metric) -> Column:
    """Missing and null values are ignored; sums are exact to 38 digits; without inputs the result is null."""
    if m.op == "count":
        return F.count(F.lit(1)).alias(m.name)
    v = F.when(m.field.there, m.field.value)
    if m.op == "sum":
        return F.sum(v.cast("decimal(38,0)")).alias(m.name)
    return (F.min(v) if m.op == "min" else F.max(v)).alias(m.name)


@dataclass
class Query:
    filter: object = field(default_factory=lambda: All(()))
    sorts: list[Sort] = field(default_factory=list)
    limit: int = 100
    cursor: tuple | None = None
    groups: list[str] = field(default_factory=list)
    metrics: list[Metric] = field(default_factory=list)


def check(q: Query, limits: Limits) -> None:
    nodes, depth = measure(q.filter)
    for what, n, most in (("filter nodes", nodes, limits.filter_nodes), ("filter depth", depth, limits.filter_depth), ("sorts", len(q.sorts), limits.sorts), ("group fields", len(q.groups), limits.group_fields), ("metrics", len(q.metrics), limits.metrics), ("limit", q.limit, limits.returned)):
        if n > most:
            raise EngineError("LIM003", f"{what}: {n} of {most}")


def matched(df: DataFrame, q: Query) -> DataFrame:
    return df.filter(condition(q.filter))


def within(df: DataFrame, most: int, what: str) -> DataFrame:
    """df, if it has at most `most` rows; more are an error, never a partial result."""
    if df.limit(most + 1).count() > most:
        raise EngineError("LIM003", f"more than {most} {what}")
    return df


def page(df: DataFrame, q: Query, key: str, limits: Limits = Limits()) -> DataFrame:
    """The page of matched records after the cursor."""
    check(q, limits)
    hits = matched(df, q)
    if q.cursor is not None:
        hits = hits.filter(after(q.sorts, key, q.cursor))
    return hits.orderBy(*ordering(q.sorts, key)).limit(q.limit)


def page_with_cursor(df: DataFrame, q: Query, key: str, limits: Limits = Limits()) -> tuple[list, tuple | None]:
    """Rows of a page, and the cursor of the next one if there is any. One row more than the page is read."""
    check(q, limits)
    more = Query(q.filter, q.sorts, q.limit + 1, q.cursor)
    rows = page(df, more, key, Limits(returned=limits.returned + 1)).collect()
    rows, rest = rows[: q.limit], rows[q.limit :]
    return rows, tuple(rows[-1][s.name] for s in q.sorts) + (rows[-1][key],) if rest and rows else None


def aggregate(df: DataFrame, q: Query, limits: Limits = Limits()) -> DataFrame:
    """Groups and metrics over all matched records, before cursor and limit, in order of the groups' keys.

    A group field may have a column `<name>__present`: then missing and null are different groups, missing first.
    """
    check(q, limits)
    hits = matched(df, q)
    metrics = [metric_column(m) for m in q.metrics] or [F.count(F.lit(1)).alias("count")]
    if not q.groups:
        return hits.agg(*metrics)
    keys = [k for g in q.groups for k in ([f"{g}__present"] if f"{g}__present" in df.columns else []) + [g]]
    return hits.groupBy(*keys).agg(*metrics).orderBy(*[F.col(k).asc_nulls_first() for k in keys])


#: A value of any kind as a struct whose order is null < boolean < integer < string < bytes.
TAGGED = T.StructType([T.StructField("tag", T.ByteType()), T.StructField("b", T.BooleanType()), T.StructField("i", T.LongType()), T.StructField("s", T.StringType()), T.StructField("y", T.BinaryType())])


def tagged(c: Column, kind: str) -> Column:
    """A column of one kind (boolean, integer, string, bytes) as tagged values, so that kinds can be mixed and sorted."""
    tags = {"boolean": (1, "b"), "integer": (2, "i"), "string": (3, "s"), "bytes": (4, "y")}
    tag, name = tags[kind]
    parts = [F.when(c.isNull(), F.lit(0)).otherwise(F.lit(tag)).cast("tinyint").alias("tag")]
    return F.struct(*parts, *[(c if f.name == name else F.lit(None)).cast(f.dataType).alias(f.name) for f in TAGGED.fields[1:]])
