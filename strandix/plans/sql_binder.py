"""Binding of queries: which access path a query takes, whether it is admitted, and its DataFrame."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandix.catalog import Catalog, Index, Relation
from strandix.errors import sql_error
from strandix.plans import sql_parser as P

#: A LIMIT of this or more asks for all rows: they are sorted by range, with no top-k that one task would hold.
NO_LIMIT = 2**31 - 1
_FLIP = {"<": "upper", "<=": "upper", ">": "lower", ">=": "lower"}


@dataclass
class Access:
    """How rows are found: the label's head and fields, and the order of the rows (column places)."""

    kind: str
    fields: list[tuple[str, object]]
    order: list[int]
    used: int
    limit: int | None = None
    index: Index | None = None

    def label(self, table: int, residual: bool) -> str:
        parts = [("table", table), *self.fields] + ([("limit", self.limit)] if self.limit is not None else []) + ([("residual", "true")] if residual else [])
        return f"{self.kind}({','.join(f'{k}={v}' for k, v in parts)})"


class Binder:
    """Binds statements against a catalog, with the values of their parameters."""

    def __init__(self, catalog: Catalog, params: tuple = ()):
        self.catalog, self.params = catalog, params

    # -- values and predicates
    def value(self, s, column):
        """The checked value that a scalar has for a column."""
        v = self.params[s.place] if isinstance(s, P.Param) else s.value
        return column.type.check(v)

    def literal(self, s, column) -> Column:
        v = self.value(s, column)
        if column.type.name == "interval" and v is not None:
            return F.struct(*[F.lit(x).alias(n) for x, n in zip(v, ("months", "days", "nanos"))]).cast(column.type.spark)
        return F.lit(v).cast(column.type.spark)

    def predicate(self, f, rel: Relation, col) -> Column:
        """A three-valued column for a filter; col gives the column of a name."""
        if isinstance(f, P.And):
            return self.predicate(f.left, rel, col) & self.predicate(f.right, rel, col)
        if isinstance(f, P.Or):
            return self.predicate(f.left, rel, col) | self.predicate(f.right, rel, col)
        if isinstance(f, P.Not):
            return ~self.predicate(f.term, rel, col)
        if isinstance(f, P.IsNull):
            c = col(rel.columns[rel.at(f.column)].name)
            return c.isNotNull() if f.negated else c.isNull()
        if isinstance(f, P.Compare):
            c = rel.columns[rel.at(f.column)]
            if not c.type.comparable:
                raise sql_error(6, f"{c.name} has no order")
            return compare(col(c.name), f.op, self.literal(f.value, c))
        cols = [rel.columns[rel.at(x)] for x in f.columns]
        return row_compare([col(c.name) for c in cols], f.op, [self.literal(v, c) for v, c in zip(f.values, cols)])

    # -- access paths
    @staticmethod
    def _equal(terms: list, rel: Relation, at: int) -> list:
        return [t for t in terms if isinstance(t, P.Compare) and t.op == "=" and rel.at(t.column) == at]

    def _covered(self, terms: list, rel: Relation, cols: tuple[int, ...]) -> bool:
        """Every column bound by exactly one equality; a column that is bound twice disqualifies its key."""
        return all(len(self._equal(terms, rel, c)) == 1 for c in cols)

    def _prefix(self, terms: list, rel: Relation, cols: tuple[int, ...]) -> int:
        n = 0
        while n < len(cols) and len(self._equal(terms, rel, cols[n])) == 1:
            n += 1
        return n

    def _bounds(self, terms: list, rel: Relation, cols: tuple[int, ...], error: int) -> tuple[dict, int] | None:
        """Lower and upper bounds on all the given columns together: {side: op}, and the terms they take."""
        found: dict[str, str] = {}
        used = 0
        for t in terms:
            if isinstance(t, P.Compare) and len(cols) == 1 and t.op in _FLIP and rel.at(t.column) == cols[0] or isinstance(t, P.RowCompare) and t.op in _FLIP and tuple(rel.at(c) for c in t.columns) == cols:
                side = _FLIP[t.op]
                if side in found:
                    raise sql_error(error, "two bounds on one side")
                found[side] = t.op
                used += 1
        return (found, used) if found else None

    @staticmethod
    def _names(found: dict) -> list[tuple[str, str]]:
        name = {None: "unbounded", "<": "exclusive", ">": "exclusive", "<=": "inclusive", ">=": "inclusive"}
        return [(side, name[found.get(side)]) for side in ("lower", "upper")]

    def _key_order(self, rel: Relation, order: list[str]) -> list[int]:
        if order and [rel.at(c) for c in order] != list(rel.key):
            raise sql_error(8, "ORDER BY must be the complete primary key")
        return list(rel.key)

    def access(self, q: P.Select, rel: Relation) -> Access:
        terms = P.conjuncts(q.where)
        indexes = self.catalog.indexes(rel.id)
        for t in terms:
            if isinstance(t, P.RowCompare):
                at = tuple(rel.at(c) for c in t.columns)
                if t.op in ("=", "<>") or at != rel.key and at not in [i.columns for i in indexes]:
                    raise sql_error(8, "a row comparison is a range over the primary key or an index")
        if q.where is None:
            return Access("PrimaryKeyScan", [], self._key_order(rel, q.order), 0, self._limit(q))
        if self._covered(terms, rel, rel.key):
            if q.order or q.limit is not None:
                raise sql_error(1, "a complete key takes neither ORDER BY nor LIMIT")
            return Access("PrimaryKeyLookup", [], list(rel.key), len(rel.key))
        exact = [i for i in indexes if self._covered(terms, rel, i.columns)]
        if exact:
            order = self._key_order(rel, q.order)
            picked: list[Index] = []
            for i in sorted(exact, key=lambda i: (-len(i.columns), i.id)):
                if not any(set(i.columns) & set(p.columns) for p in picked):
                    picked.append(i)
            used = sum(len(i.columns) for i in picked)
            if len(picked) == 1:
                return Access("SecondaryIndexLookup", [("index", picked[0].id)], order, used, q.limit, picked[0])
            return Access("SecondaryIndexIntersection", [("indexes", f"[{','.join(str(i.id) for i in picked)}]")], order, used, q.limit)
        if got := self._bounds(terms, rel, rel.key, 8):
            return Access("PrimaryKeyRangeScan", self._names(got[0]), self._key_order(rel, q.order), got[1], self._limit(q))
        n = self._prefix(terms, rel, rel.key)
        if n and n < len(rel.key):
            if got := self._bounds(terms, rel, (rel.key[n],), 8):
                c = rel.columns[rel.key[n]].id
                return Access("PrimaryKeyPrefixRangeScan", [("prefix_columns", n), ("range_column", c), *self._names(got[0])], self._key_order(rel, q.order), n + got[1], self._limit(q))
            if q.limit is not None:
                return Access("PrimaryKeyPrefixScan", [("columns", n)], self._key_order(rel, q.order), n, self._limit(q))
        for i in sorted(indexes, key=lambda i: (-len(i.columns), i.id)):
            if not set(i.columns) & set().union(*[self._columns(t, rel) for t in terms]):
                continue
            got, n, name = self._bounds(terms, rel, i.columns, 14), 0, "SecondaryIndexRangeScan"
            fields = [("index", i.id)]
            if not got:
                n = self._prefix(terms, rel, i.columns)
                got = self._bounds(terms, rel, (i.columns[n],), 14) if 0 < n < len(i.columns) else None
                name = "SecondaryIndexPrefixRangeScan"
                fields += [("prefix_columns", n), ("range_column", rel.columns[i.columns[n]].id)] if got else []
            if got:
                if q.order and [rel.at(c) for c in q.order] != list(i.columns):
                    raise sql_error(14, "ORDER BY must be the index's columns")
                order = [*i.columns, *[k for k in rel.key if k not in i.columns]]
                return Access(name, fields + self._names(got[0]), order, n + got[1], self._limit(q), i)
        if q.limit is None:
            touched = any(isinstance(t, P.Compare) and rel.at(t.column) in rel.key for t in terms)
            raise sql_error(8 if touched else 11)
        return Access("PrimaryKeyScan", [], self._key_order(rel, q.order), 0, self._limit(q))

    @staticmethod
    def _columns(t, rel: Relation) -> set[int]:
        return {rel.at(t.column)} if isinstance(t, P.Compare) else {rel.at(c) for c in t.columns} if isinstance(t, P.RowCompare) else set()

    @staticmethod
    def _limit(q) -> int:
        if q.limit is None:
            raise sql_error(1, "a scan or range needs LIMIT")
        return q.limit

    # -- queries
    def explain(self, q) -> str:
        if isinstance(q, P.Join):
            return self.join(q)[0]
        rel = self.catalog.relation(q.table)
        a = self.access(q, rel)
        return a.label(rel.id, a.used < self._leaves(q.where))

    def _leaves(self, f) -> int:
        """Predicates of a filter; those that the access path uses up leave no residual."""
        return self._leaves(f.left) + self._leaves(f.right) if isinstance(f, (P.And, P.Or)) else int(f is not None)

    def projection(self, q: P.Select, rel: Relation) -> list[str]:
        names = [c.name for c in rel.columns] if q.columns is None else [rel.columns[rel.at(c)].name for c in q.columns]
        if len(set(names)) != len(names):
            raise sql_error(5)
        return names

    def select(self, q: P.Select, df: DataFrame) -> DataFrame:
        rel = self.catalog.relation(q.table)
        names = self.projection(q, rel)
        a = self.access(q, rel)
        if q.where is not None:
            df = df.filter(self.predicate(q.where, rel, quoted))
        df = df.orderBy(*[quoted(rel.columns[i].name).asc_nulls_first() for i in a.order])
        df = df.limit(a.limit) if a.limit is not None and a.limit < NO_LIMIT else df
        return df.select(*[quoted(n) for n in names])

    def join(self, q: P.Join):
        """(label, function of the two tables)."""
        left, right = self.catalog.relation(q.left), self.catalog.relation(q.right)
        sides = {q.left.lower(): left, q.right.lower(): right}
        if left.id == right.id:
            raise sql_error(1, "a table can't join itself")
        pairs: list[tuple[int, int]] = []
        for a, b in q.on:
            if a[0].lower() == q.right.lower():
                a, b = b, a
            if a[0].lower() != q.left.lower() or b[0].lower() != q.right.lower():
                raise sql_error(17, f"{a[0]} or {b[0]}")
            pairs.append((left.at(a[1]), right.at(b[1])))
        for i, j in pairs:
            if left.columns[i].type != right.columns[j].type:
                raise sql_error(6, "join columns of different types")
        if len({j for _, j in pairs}) != len(pairs):
            raise sql_error(5, "a right column is compared twice")
        cover = {j for _, j in pairs}
        if cover == set(right.key):
            right_access = "primary-key"
        else:
            unique = next((i for i in self.catalog.indexes(right.id) if i.unique and set(i.columns) == cover), None)
            if unique is None:
                raise sql_error(11, "the right side needs its primary key or a unique index")
            right_access = f"unique-secondary(index={unique.id})"
        one = P.Select(None, q.left, q.where, q.order, q.limit)
        terms = P.conjuncts(q.where)
        if q.where is not None and self._covered(terms, left, left.key):
            one = P.Select(None, q.left, q.where)  # at most one row; LIMIT counts joined rows
            left_access = "primary-key"
            a = self.access(one, left)
        else:
            a = self.access(one, left)
            if a.kind == "SecondaryIndexLookup":
                if a.index.unique:
                    left_access = f"unique-secondary(index={a.index.id})"
                elif q.limit is None:
                    raise sql_error(1, "a join from a non-unique index needs LIMIT")
                else:
                    left_access = f"secondary(index={a.index.id},limit={q.limit})"
            elif a.kind == "PrimaryKeyRangeScan":
                left_access = "primary-key-range(" + ",".join(f"{k}={v}" for k, v in a.fields) + f",limit={q.limit})"
            elif a.kind.startswith("PrimaryKey"):
                left_access = f"primary-key-scan(limit={q.limit})"
            else:
                raise sql_error(11, "this left access is not admitted in a join")
        wanted = []
        for t, c in q.columns:
            rel = sides.get(t.lower())
            if rel is None:
                raise sql_error(17, t)
            wanted.append((rel is left, rel.columns[rel.at(c)].name, f"{t}.{rel.columns[rel.at(c)].name}"))
        if len({n for _, _, n in wanted}) != len(wanted):
            raise sql_error(5)

        def run(ldf: DataFrame, rdf: DataFrame) -> DataFrame:
            ldf = ldf.select(*[quoted(c.name).alias(f"l{i}") for i, c in enumerate(left.columns)])
            rdf = rdf.select(*[quoted(c.name).alias(f"r{i}") for i, c in enumerate(right.columns)])
            if q.where is not None:
                ldf = ldf.filter(self.predicate(q.where, left, lambda n: F.col(f"l{left.at(n)}")))
            on = None
            for i, j in pairs:
                term = F.col(f"l{i}") == F.col(f"r{j}")
                on = term if on is None else on & term
            out = ldf.join(rdf, on).orderBy(*[F.col(f"l{i}") for i in left.key])
            out = out.limit(q.limit) if q.limit is not None and q.limit < NO_LIMIT else out
            return out.select(*[F.col(f"{'l' if is_left else 'r'}{(left if is_left else right).at(n)}").alias(alias) for is_left, n, alias in wanted])

        label = f"IndexedInnerJoin(left_table={left.id},left_access={left_access},right_table={right.id},right_access={right_access})"
        return label, run

    def window(self, q: P.WindowSelect, df: DataFrame) -> DataFrame:
        """Ordinals by primary key. LIMIT comes before the ordinal: the order is the key's, so the first rows are the same."""
        rel = self.catalog.relation(q.table)
        if q.function not in ("ROW_NUMBER", "RANK"):
            raise sql_error(1, q.function)
        by, part = rel.at(q.by), rel.at(q.partition) if q.partition else None
        key = [by] if part is None else [part, by]
        if list(rel.key) != key or [rel.at(c) for c in q.order] != key:
            raise sql_error(8, "partition and order must be the primary key, and ORDER BY both")
        names = [quoted(rel.columns[i].name) for i in key]
        page = df.orderBy(*names).limit(q.limit)
        w = Window.partitionBy(*names[:-1]).orderBy(names[-1])
        f = F.row_number() if q.function == "ROW_NUMBER" else F.rank()
        out = page.withColumn("__ordinal", f.over(w).cast("bigint")).orderBy(*names)
        return out.select(quoted(rel.columns[rel.at(q.column)].name), F.col("__ordinal").alias(q.alias))

    def cte(self, q: P.Cte, df: DataFrame) -> DataFrame:
        """The inner query's rows in its order, then projection and LIMIT; the order is carried through by the key."""
        rel = self.catalog.relation(q.inner.table)
        inner = self.projection(q.inner, rel)
        outer = inner if q.outer.columns is None else []
        for c in q.outer.columns or []:
            match = [n for n in inner if n.lower() == c.lower()]
            if not match:
                raise sql_error(4, c)
            outer.append(match[0])
        if len(set(outer)) != len(outer):
            raise sql_error(5)
        return self.select(q.inner, df).limit(q.outer.limit).select(*[quoted(n) for n in outer])


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def compare(a: Column, op: str, b: Column) -> Column:
    return {"=": a == b, "<>": a != b, "<": a < b, "<=": a <= b, ">": a > b, ">=": a >= b}[op]


def row_compare(cols: list[Column], op: str, values: list[Column]) -> Column:
    """Left to right, unknown where the first deciding pair is unknown. Struct comparison would not be three-valued."""
    if op in ("=", "<>"):
        same = cols[0] == values[0]
        for c, v in zip(cols[1:], values[1:]):
            same = same & (c == v)
        return same if op == "=" else ~same
    strict = op[0]
    out = compare(cols[-1], op, values[-1])
    for c, v in zip(cols[-2::-1], values[-2::-1]):
        out = compare(c, strict, v) | ((c == v) & out)
    return out
