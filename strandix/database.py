"""A database: a catalog and immutable versions of its tables, changed by SQL statements and atomic batches."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandix.catalog import Catalog, Column, Entry, ForeignKey, Index, Relation
from strandix.errors import EngineError, sql_error
from strandix.plans import sql_parser as P
from strandix.plans.sql_binder import Binder, compare, quoted
from strandix.types import of_spark, parse_type

MAX_PARAMETERS, MAX_ROWS, MAX_OPERATIONS = 1_024, 1_024, 1_024
_parse = lru_cache(256)(P.parse)


@dataclass
class State:
    """One version of everything; never changed in place once it is committed."""

    catalog: Catalog = field(default_factory=Catalog)
    tables: dict[int, DataFrame] = field(default_factory=dict)
    csn: int = 0
    writes: dict[tuple, int] = field(default_factory=dict)


@dataclass(frozen=True)
class Prepared:
    text: str
    statement: object
    parameters: int
    catalog_version: int

    @property
    def statement_class(self) -> str:
        return P.statement_class(self.statement)


class Database:
    """Statements run against the newest version; `begin` opens a batch that commits all its changes or none."""

    def __init__(self, spark: SparkSession):
        self.spark, self.state = spark, State()
        self.history: dict[int, State] = {0: self.state}

    # -- definitions from existing tables
    def register(self, name: str, df: DataFrame, key: list[str], indexes: dict[str, list[str]] | None = None, unique: tuple[str, ...] = ()) -> None:
        """Declares an existing table. Its key and unique indexes are declared here, not checked: `verify` checks them."""
        cat = self.state.catalog
        cols = tuple(Column(i + 1, f.name, of_spark(f.dataType), f.name not in key) for i, f in enumerate(df.schema))
        rel = Relation(cat.new_id(), name, cols, ())
        rel = Relation(rel.id, name, cols, tuple(rel.at(k) for k in key))
        cat.put(rel)
        self.state.tables[rel.id] = df
        for index, on in (indexes or {}).items():
            cat.put(Index(cat.new_id(), index, rel.id, tuple(rel.at(c) for c in on), index in unique))

    def verify(self, name: str) -> None:
        """Checks a registered table's key and unique indexes by one aggregation each."""
        rel = self.state.catalog.relation(name)
        df = self.state.tables[rel.id]
        for cols in [rel.key, *[i.columns for i in self.state.catalog.indexes(rel.id) if i.unique]]:
            _unique(df, [rel.columns[c].name for c in cols])

    # -- statements
    def prepare(self, text: str) -> Prepared:
        s, n = _parse(text)
        return Prepared(text, s, n, self.state.catalog.version)

    def execute(self, text: str | Prepared, params: tuple | list = ()) -> DataFrame | int:
        """Rows of a query as a DataFrame, or the number of rows that a change touched."""
        b = self.begin()
        out = b.execute(text, params)
        if b.changed:
            b.commit()
        return out

    def query(self, text: str | Prepared, params: tuple | list = ()) -> list:
        """The rows of a bounded query; refused if more than MAX_ROWS could come."""
        s = text.statement if isinstance(text, Prepared) else _parse(text)[0]
        q = s.outer if isinstance(s, P.Cte) else s
        limit = getattr(q, "limit", None)
        if isinstance(q, (P.Select, P.Join)) and limit is None:
            rel = self.state.catalog.relation(q.table if isinstance(q, P.Select) else q.left)
            a = Binder(self.state.catalog, tuple(params)).access(P.Select(None, rel.name, q.where), rel)
            limit = 1 if a.kind == "PrimaryKeyLookup" or a.index is not None and a.index.unique else None
            if limit is None:
                raise EngineError("LIM001", "the number of rows is not bounded")
        if limit is not None and limit > MAX_ROWS:
            raise EngineError("LIM001", f"more than {MAX_ROWS} rows")
        return self.execute(text, params).collect()

    def begin(self, as_of: int | None = None) -> Batch:
        return Batch(self, self.history[self.state.csn if as_of is None else as_of])

    def as_of(self, csn: int) -> State:
        if csn not in self.history:
            raise EngineError("TXN002", f"version {csn} is not retained")
        return self.history[csn]


class Batch:
    """Changes on top of one version. First committer wins: a batch fails if a row it wrote changed since it began."""

    def __init__(self, db: Database, base: State):
        self.db, self.base = db, base
        self.state = State(base.catalog.copy(), dict(base.tables), base.csn, dict(base.writes))
        self.keys: set[tuple] = set()
        self.changed, self.open, self.operations = False, True, 0

    def execute(self, text: str | Prepared, params: tuple | list = ()) -> DataFrame | int:
        if not self.open:
            raise EngineError("TXN003", "the batch is closed")
        if isinstance(text, Prepared):
            if text.catalog_version != self.state.catalog.version:
                raise sql_error(3)
            s, n = text.statement, text.parameters
        else:
            s, n = _parse(text)
        if n != len(params) or n > MAX_PARAMETERS:
            raise sql_error(2, f"{n} needed, {len(params)} given")
        b = Binder(self.state.catalog, tuple(params))
        cat = self.state.catalog
        if isinstance(s, P.Select):
            return b.select(s, self._table(s.table))
        if isinstance(s, P.Join):
            _, run = b.join(s)
            return run(self._table(s.left), self._table(s.right))
        if isinstance(s, P.WindowSelect):
            if n:
                raise sql_error(1, "a window query takes no parameters")
            return b.window(s, self._table(s.table))
        if isinstance(s, P.Cte):
            return b.cte(s, self._table(s.inner.table))
        if isinstance(s, P.Explain):
            return self.db.spark.createDataFrame([(b.explain(s.query),)], "plan string")
        self.operations += 1
        if self.operations > MAX_OPERATIONS:
            raise EngineError("LIM002", "too many operations in one batch")
        before = (cat.copy(), dict(self.state.tables))
        try:
            out = getattr(self, f"_{type(s).__name__.lower()}")(s, b)
        except EngineError:
            self.state.catalog, self.state.tables = before
            raise
        self.changed = True
        return out

    def _table(self, name: str) -> DataFrame:
        return self.state.tables[self.state.catalog.relation(name).id]

    # -- definitions
    def _createtable(self, s: P.CreateTable, b: Binder) -> int:
        cat = self.state.catalog
        if cat.resolve(s.name) is not None:
            raise sql_error(12, s.name)
        if len({c.name.lower() for c in s.columns}) != len(s.columns):
            raise sql_error(5)
        key = [k.lower() for k in s.primary_key]
        cols = []
        for i, c in enumerate(s.columns):
            kind = parse_type(c.type)
            cols.append(Column(i + 1, c.name, kind, c.nullable and c.name.lower() not in key, tuple((op, kind.check(v)) for op, v in c.checks)))
        rel = Relation(cat.new_id(), s.name, tuple(cols), ())
        places = tuple(rel.at(k) for k in s.primary_key)
        foreign = []
        for f in s.foreign_keys:
            target = rel if f.table.lower() == s.name.lower() else cat.relation(f.table)
            at = tuple(target.at(c) for c in f.target)
            own = tuple(rel.at(c) for c in f.columns)
            is_key = at == (places if target is rel else target.key)
            if not is_key and not any(i.unique and i.columns == at for i in cat.indexes(target.id)) or [rel.columns[c].type for c in own] != [target.columns[c].type for c in at]:
                raise sql_error(16, "a foreign key needs the key or a unique index of the same types")
            foreign.append(ForeignKey(f.name, own, rel.id, at) if target is rel else ForeignKey(f.name, own, target.id, at))
        cat.put(Relation(rel.id, s.name, tuple(cols), places, tuple(foreign)))
        self.state.tables[rel.id] = self.db.spark.createDataFrame([], T.StructType([T.StructField(c.name, c.type.spark, True) for c in cols]))
        return 0

    def _createindex(self, s: P.CreateIndex, b: Binder) -> int:
        cat = self.state.catalog
        if cat.resolve(s.name) is not None:
            raise sql_error(12, s.name)
        rel = cat.relation(s.table)
        cols = tuple(rel.at(c) for c in s.columns)
        if len(set(cols)) != len(cols):
            raise sql_error(5)
        if s.unique:
            _unique(self.state.tables[rel.id], [rel.columns[c].name for c in cols])
        cat.put(Index(cat.new_id(), s.name, rel.id, cols, s.unique))
        return 0

    def _dropindex(self, s: P.DropIndex, b: Binder) -> int:
        obj = self.state.catalog.resolve(s.name)
        if not isinstance(obj, Index):
            raise sql_error(10 if obj else 17, s.name)
        self.state.catalog.drop(obj)
        return 0

    def _droptable(self, s: P.DropTable, b: Binder) -> int:
        cat = self.state.catalog
        rel = cat.relation(s.name)
        if cat.dependencies(rel.id):
            raise sql_error(16, "indexes or foreign keys depend on it")
        cat.drop(rel)
        del self.state.tables[rel.id]
        return 0

    def _renametable(self, s: P.RenameTable, b: Binder) -> int:
        self.state.catalog.rename(s.name, s.to)
        return 0

    def create_entry(self, name: str, kind: str, options: dict[str, str] | None = None, uses: tuple[int, ...] = ()) -> int:
        """Catalogs an object that has no SQL form: keyspace, search-collection, analyzer, link."""
        cat = self.state.catalog
        if cat.resolve(name) is not None:
            raise EngineError("CAT002", f"{name} exists")
        e = Entry(cat.new_id(), name, kind, tuple(sorted((options or {}).items())), uses)
        cat.put(e)
        self.changed = True
        return e.id

    # -- changes
    def _values(self, rel: Relation, pairs, b: Binder) -> dict[int, object]:
        out = {}
        for name, v in pairs:
            at = rel.at(name)
            if at in out:
                raise sql_error(5, name)
            out[at] = b.value(v, rel.columns[at])
        return out

    def _check(self, rel: Relation, at: int, value) -> None:
        c = rel.columns[at]
        if value is None:
            if not c.nullable:
                raise sql_error(7, c.name)
            return
        ops = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
        for op, literal in c.checks:
            if literal is not None and not ops[op](value, literal):
                raise sql_error(15, c.name)

    def _at_key(self, rel: Relation, key: dict[int, object]):
        terms = [compare(quoted(rel.columns[i].name), "=", F.lit(v).cast(rel.columns[i].type.spark)) for i, v in key.items()]
        return reduce(lambda a, c: a & c, terms)

    def _row(self, rel: Relation, values: dict[int, object]) -> DataFrame:
        return self.db.spark.range(1).select(*[F.lit(values.get(i)).cast(c.type.spark).alias(c.name) for i, c in enumerate(rel.columns)])

    def _held(self, rel: Relation, cols: tuple[int, ...], values: list, but: dict[int, object] | None = None) -> bool:
        """Whether a row (other than the one with key `but`) has these values; a null value matches nothing."""
        if any(v is None for v in values):
            return False
        df = self.state.tables[rel.id].filter(self._at_key(rel, dict(zip(cols, values))))
        if but is not None:
            df = df.filter(~self._at_key(rel, but))
        return not df.isEmpty()

    def _constraints(self, rel: Relation, row: dict[int, object], but: dict[int, object] | None) -> None:
        for i in self.state.catalog.indexes(rel.id):
            if i.unique and self._held(rel, i.columns, [row.get(c) for c in i.columns], but):
                raise sql_error(12, i.name)
        for f in rel.foreign_keys:
            values = [row.get(c) for c in f.columns]
            own = f.table == rel.id and values == [row.get(c) for c in f.target]
            parent = self.state.catalog.objects[f.table]
            if not any(v is None for v in values) and not own and not self._held(parent, f.target, values):
                raise sql_error(16, f.name or "")

    def _referenced(self, rel: Relation, old: dict[int, object], new: dict[int, object] | None) -> None:
        """No action: a row that others refer to keeps the values that they refer to."""
        for child in [o for o in self.state.catalog.objects.values() if isinstance(o, Relation)]:
            for f in child.foreign_keys:
                values = [old.get(c) for c in f.target]
                if f.table == rel.id and (new is None or values != [new.get(c) for c in f.target]):
                    but = {k: old[k] for k in rel.key} if child.id == rel.id else None
                    if self._held(child, f.columns, values, but):
                        raise sql_error(16, f.name or child.name)

    def _insert(self, s: P.Insert, b: Binder) -> int:
        rel = self.state.catalog.relation(s.table)
        row = self._values(rel, zip(s.columns, s.values), b)
        for i in range(len(rel.columns)):
            self._check(rel, i, row.get(i))
        key = {k: row.get(k) for k in rel.key}
        if self._held(rel, rel.key, list(key.values())):
            raise sql_error(12, "primary key")
        self._constraints(rel, row, None)
        self._write(rel, key, self.state.tables[rel.id].unionByName(self._row(rel, row)))
        return 1

    def _keyed(self, rel: Relation, where, b: Binder) -> dict[int, object]:
        key = self._values(rel, where, b)
        if set(key) != set(rel.key) or any(v is None for v in key.values()):
            raise sql_error(8, "the complete primary key is needed")
        return {k: key[k] for k in rel.key}

    def _old(self, rel: Relation, key: dict[int, object]) -> dict[int, object] | None:
        got = self.state.tables[rel.id].filter(self._at_key(rel, key)).limit(1).collect()
        return {i: got[0][c.name] for i, c in enumerate(rel.columns)} if got else None

    def _update(self, s: P.Update, b: Binder) -> int:
        rel = self.state.catalog.relation(s.table)
        new = self._values(rel, s.assign, b)
        key = self._keyed(rel, s.where, b)
        if set(new) & set(rel.key):
            raise sql_error(13)
        for i, v in new.items():
            self._check(rel, i, v)
        old = self._old(rel, key)
        if old is None:
            return 0
        self._constraints(rel, old | new, key)
        self._referenced(rel, old, old | new)
        hit = self._at_key(rel, key)
        df = self.state.tables[rel.id].select(*[F.when(hit, F.lit(new[i]).cast(c.type.spark)).otherwise(quoted(c.name)).alias(c.name) if i in new else quoted(c.name) for i, c in enumerate(rel.columns)])
        self._write(rel, key, df)
        return 1

    def _delete(self, s: P.Delete, b: Binder) -> int:
        rel = self.state.catalog.relation(s.table)
        key = self._keyed(rel, s.where, b)
        old = self._old(rel, key)
        if old is None:
            return 0
        self._referenced(rel, old, None)
        self._write(rel, key, self.state.tables[rel.id].filter(~self._at_key(rel, key)))
        return 1

    def _write(self, rel: Relation, key: dict[int, object], df: DataFrame) -> None:
        self.state.tables[rel.id] = df
        self.keys.add((rel.id, *map(str, key.values())))

    def upsert(self, name: str, rows: DataFrame) -> None:
        """Whole-table form for bulk changes: rows replace those of the same key and are added otherwise."""
        rel = self.state.catalog.relation(name)
        cols = [c.name for c in rel.columns]
        on = [rel.columns[k].name for k in rel.key]
        _unique(rows, on)
        self.state.tables[rel.id] = self.state.tables[rel.id].join(rows.select(*on), on, "left_anti").select(*cols).unionByName(rows.select(*cols))
        self.keys.add((rel.id, "*"))
        self.changed = True

    # -- the end
    def commit(self) -> int:
        """The new version's number."""
        now = self.db.state
        if not self.open:
            raise EngineError("TXN003", "the batch is closed")
        self.open = False
        if now.csn != self.base.csn:
            tables = {k[0] for k in self.keys}
            for k, at in now.writes.items():
                if at > self.base.csn and (k in self.keys or k[0] in tables and (k[-1] == "*" or (k[0], "*") in self.keys)):
                    raise EngineError("TXN001", "a row of this batch was changed by a later commit")
            if now.catalog.version != self.base.catalog.version or self.state.catalog.version != self.base.catalog.version:
                raise EngineError("TXN001", "the catalog was changed by a later commit")
            self._rebase(now)
        self.state.csn = now.csn + 1
        self.state.writes |= dict.fromkeys(self.keys, self.state.csn)
        self.db.state = self.state
        self.db.history[self.state.csn] = self.state
        return self.state.csn

    def _rebase(self, now: State) -> None:
        """The rows that this batch wrote go over the newest tables; a bulk change of a table goes over it whole."""
        written = {k[0] for k in self.keys}
        for tid in written:
            touched = [k[1:] for k in self.keys if k[0] == tid]
            if ("*",) not in touched:
                on = [quoted(self.state.catalog.objects[tid].columns[i].name).cast("string") for i in self.state.catalog.objects[tid].key]
                hit = reduce(lambda a, c: a | c, [reduce(lambda a, c: a & c, [n == v for n, v in zip(on, k)]) for k in touched])
                self.state.tables[tid] = now.tables[tid].filter(~hit).unionByName(self.state.tables[tid].filter(hit))
        for tid, df in now.tables.items():
            if tid not in written:
                self.state.tables[tid] = df
        self.state.writes = dict(now.writes)

    def rollback(self) -> None:
        self.open = False


def _unique(df: DataFrame, cols: list[str]) -> None:
    """Fails if two rows have equal, wholly non-null values in cols."""
    keys = [quoted(c) for c in cols]
    whole = reduce(lambda a, c: a & c, [k.isNotNull() for k in keys])
    if not df.filter(whole).groupBy(*keys).count().filter("count > 1").isEmpty():
        raise sql_error(12, ", ".join(cols))
