"""A versioned store: immutable Parquet tables and a manifest per version, committed by creating the next manifest.

A version's manifest names each table's folder and row count and holds its own checksum. Committing writes the
changed tables first and then creates the manifest file of the next number, which fails if it is there: the first
committer wins, and a reader sees all of a version or none. All files go through the session's file system.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.errors import EngineError


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
        self._fs.mkdirs(self._path(f"{self.root}/versions"))

    # -- manifests
    def _file(self, version: int) -> str:
        return f"{self.root}/versions/{version:012d}.json"

    def _read(self, path: str) -> bytes:
        with_ = self._fs.open(self._path(path))
        try:
            return bytes(with_.readAllBytes())
        finally:
            with_.close()

    def versions(self) -> list[int]:
        return sorted(int(s.getPath().getName()[:-5]) for s in self._fs.listStatus(self._path(f"{self.root}/versions")) if s.getPath().getName().endswith(".json"))

    def newest(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int) -> dict:
        if version == 0:
            return {"version": 0, "tables": {}, "ledger": {}}
        if version not in self.versions():
            raise EngineError("TXN002", f"version {version} is not retained")
        body, checksum = self._read(self._file(version)).decode().rsplit("\n", 1)
        if hashlib.sha256(body.encode()).hexdigest() != checksum:
            raise EngineError("STO001", f"manifest {version} is damaged")
        return json.loads(body)

    # -- reads
    def table(self, name: str, version: int | None = None) -> DataFrame:
        m = self.manifest(self.newest() if version is None else version)
        if name not in m["tables"]:
            raise EngineError("STO002", f"no table {name} in version {m['version']}")
        return self.spark.read.parquet(m["tables"][name]["path"])

    # -- commits
    def commit(self, tables: dict[str, DataFrame], base: int | None = None, request: str | None = None, digest: str = "") -> int:
        """Writes the tables as the version after `base` and returns its number.

        A request id makes it idempotent: the same id and digest returns the first commit's version, another digest is
        an error.
        """
        head = self.newest()
        m = self.manifest(head)
        if request is not None and request in m["ledger"]:
            if m["ledger"][request]["digest"] != digest:
                raise EngineError("ING001", "the request id was used for other data")
            return m["ledger"][request]["version"]
        base = head if base is None else base
        if base != head:
            changed = {n for n, t in m["tables"].items() if t["since"] > base}
            if changed & set(tables):
                raise EngineError("TXN001", "a table of this commit was changed by a later version")
        new = {"version": head + 1, "tables": dict(m["tables"]), "ledger": dict(m["ledger"])}
        for name, df in tables.items():
            path = f"{self.root}/data/{name}-{uuid.uuid4().hex}"
            df.write.parquet(path)
            new["tables"][name] = {"path": path, "rows": self.spark.read.parquet(path).count(), "since": head + 1}
        if request is not None:
            new["ledger"][request] = {"digest": digest, "version": head + 1}
        body = json.dumps(new, sort_keys=True)
        data = f"{body}\n{hashlib.sha256(body.encode()).hexdigest()}".encode()
        try:
            out = self._fs.create(self._path(self._file(head + 1)), False)
        except Exception as e:
            raise EngineError("TXN001", "another commit came first") from e
        try:
            out.write(bytearray(data))
        finally:
            out.close()
        return head + 1

    # -- documents
    def upsert(self, name: str, rows: DataFrame, key: str, request: str | None = None, digest: str = "") -> int:
        """Rows replace those with the same key and are added otherwise; a repeated key in one batch is an error."""
        if not rows.groupBy(key).count().filter("count > 1").isEmpty():
            raise EngineError("ING002", "a key is repeated in the batch")
        head = self.newest()
        old = self.manifest(head)["tables"].get(name)
        if old:
            kept = self.table(name, head).join(rows.select(key), key, "left_anti")
            rows = kept.unionByName(rows)
        return self.commit({name: rows}, head, request, digest)

    def delete(self, name: str, keys: DataFrame, key: str) -> int:
        head = self.newest()
        return self.commit({name: self.table(name, head).join(keys.select(key), key, "left_anti")}, head)

    # -- backup
    def backup(self, to: str, version: int | None = None) -> str:
        """Copies a version's tables, checks their row counts, then writes the manifest: returns its checksum."""
        m = self.manifest(self.newest() if version is None else version)
        target = Store(self.spark, to)
        target.commit({n: self.spark.read.parquet(t["path"]) for n, t in m["tables"].items()})
        copied = target.manifest(target.newest())["tables"]
        if {n: t["rows"] for n, t in copied.items()} != {n: t["rows"] for n, t in m["tables"].items()}:
            raise EngineError("STO003", "row counts of the copy differ")
        return hashlib.sha256(json.dumps({n: t["rows"] for n, t in copied.items()}, sort_keys=True).encode()).hexdigest()

    def restore(self, source: str) -> int:
        """Makes the newest version of a backup the next version here."""
        other = Store(self.spark, source)
        m = other.manifest(other.newest())
        return self.commit({n: self.spark.read.parquet(t["path"]) for n, t in m["tables"].items()})


def digest_of(df: DataFrame) -> str:
    """A digest of a batch that does not depend on row order."""
    cols = sorted(df.columns)
    n, a, b = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(38,0)")), F.bit_xor(F.xxhash64(F.lit(1), *cols))).first()
    return f"{n}:{a}:{b}"
