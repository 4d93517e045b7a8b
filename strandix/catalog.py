"""The catalog: relations, indexes, keyspaces and collections, with a version that every change raises."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from strandix.errors import EngineError, sql_error
from strandix.types import Logical


@dataclass(frozen=True)
class Column:
    id: int
    name: str
    type: Logical
    nullable: bool = True
    checks: tuple[tuple[str, object], ...] = ()


@dataclass(frozen=True)
class ForeignKey:
    name: str | None
    columns: tuple[int, ...]
    table: int
    target: tuple[int, ...]


@dataclass(frozen=True)
class Relation:
    id: int
    name: str
    columns: tuple[Column, ...]
    key: tuple[int, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()

    def at(self, name: str) -> int:
        """The place of a column, by a name in any ASCII case."""
        for i, c in enumerate(self.columns):
            if c.name.lower() == name.lower():
                return i
        raise sql_error(4, name)


@dataclass(frozen=True)
class Index:
    id: int
    name: str
    table: int
    columns: tuple[int, ...]
    unique: bool


@dataclass(frozen=True)
class Entry:
    """An object that is only described: keyspace, collection, analyzer, link, schema."""

    id: int
    name: str
    kind: str
    options: tuple[tuple[str, str], ...] = ()
    uses: tuple[int, ...] = ()


@dataclass
class Catalog:
    version: int = 0
    objects: dict[int, Relation | Index | Entry] = field(default_factory=dict)
    last_id: int = 0

    def copy(self) -> Catalog:
        return Catalog(self.version, dict(self.objects), self.last_id)

    def new_id(self) -> int:
        self.last_id += 1
        return self.last_id

    def put(self, obj) -> None:
        self.objects[obj.id] = obj
        self.version += 1

    def drop(self, obj) -> None:
        del self.objects[obj.id]
        self.version += 1

    @staticmethod
    def kind(obj) -> str:
        return "relation" if isinstance(obj, Relation) else "index" if isinstance(obj, Index) else obj.kind

    def resolve(self, name: str):
        return next((o for o in self.objects.values() if o.name.lower() == name.lower()), None)

    def relation(self, name: str) -> Relation:
        obj = self.resolve(name)
        if obj is None:
            raise sql_error(17, name)
        if not isinstance(obj, Relation):
            raise sql_error(10, name)
        return obj

    def indexes(self, table: int) -> list[Index]:
        return [o for o in self.objects.values() if isinstance(o, Index) and o.table == table]

    def rename(self, name: str, to: str) -> None:
        r = self.relation(name)
        if self.resolve(to) is not None:
            raise sql_error(12, to)
        self.put(replace(r, name=to))

    def describe(self, oid: int) -> dict:
        obj = self.objects.get(oid)
        if obj is None:
            raise EngineError("CAT001", f"no object {oid}")
        return {"object_id": oid, "kind": self.kind(obj), "name": obj.name, "catalog_version": self.version}

    def dependencies(self, oid: int) -> list[int]:
        """Ids of the objects that depend on this one, in order."""
        out = set()
        for o in self.objects.values():
            if isinstance(o, Index) and o.table == oid or isinstance(o, Entry) and oid in o.uses or isinstance(o, Relation) and any(f.table == oid for f in o.foreign_keys):
                out.add(o.id)
        return sorted(out - {oid})

    def list(self, after: int = 0, limit: int = 1_000, kind: str | None = None) -> tuple[list[dict], int | None]:
        """A page of objects by id, strictly after the cursor, and the next cursor if there are more."""
        ids = [i for i in sorted(self.objects) if i > after and (kind is None or self.kind(self.objects[i]) == kind)]
        page = ids[:limit]
        return [self.describe(i) for i in page], page[-1] if len(ids) > limit and page else None
