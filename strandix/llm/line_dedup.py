"""Reversible incremental line dedup: sharded cuckoo filters in front of exact reference-count tables.

State of an index, three tables:
  refs    one row per (line key, document): shard, k1, k2, doc_id        -- what makes deletion exact
  counts  one row per line key:             shard, k1, k2, n_docs, last_doc
  filters one row per shard:                shard, filter                -- cuckoo filter of keys in `min_docs` documents or more

A line's key is the line with space and control characters 9 to 13 stripped at both ends and A-Z lower-cased; keys
of fewer than `min_chars` code points are never counted. Keys are held as 128-bit hashes. Inserting documents adds
references and recounts only the keys they touch; deleting documents removes their references and takes the
fingerprints of keys that fall below `min_docs` out of their filter, so the index returns to what it was.

To decide on lines, references meet the filter of their shard first; only those that the filter lets through are
joined to the exact counts. Rows of one key are spread by a salt of the document, so that a line that a third of
all documents hold is dealt over many tasks.

Defined results: null or empty text is one empty line; null doc_id ranks below every other (its copy goes first);
repeated rows count one reference per doc_id; empty tables give empty results; other columns are carried along.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from strandix.llm.common import materialize, table

MIN_CHARS, MIN_DOCS = 20, 3
#: Line keys of a shard at most, on average, and the ways in which rows of one key are dealt.
SHARD_KEYS, SALTS = 200_000, 16
STRIP = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """The key of a line in UTF-8, or None if it is too short to count. bytes.lower changes A-Z only."""
    key = line.strip(STRIP).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode()) < min_chars):
        return None
    return key


class CuckooFilter:
    """A partial-key cuckoo filter: buckets of four 16-bit fingerprints; deletion is exact for inserted keys."""

    SLOTS, KICKS = 4, 500

    def __init__(self, capacity: int):
        self._clear(1 << max(1, int(np.ceil(np.log2(max(1, capacity) / (self.SLOTS * 0.85))))))

    def _clear(self, n_buckets: int) -> None:
        self.table = np.zeros((n_buckets, self.SLOTS), np.uint16)

    @staticmethod
    def _fingerprint(k: np.ndarray) -> np.ndarray:
        return ((k >> np.uint64(48)) % np.uint64(65535) + np.uint64(1)).astype(np.uint16)

    def _first(self, k: np.ndarray) -> np.ndarray:
        return (k & np.uint64(len(self.table) - 1)).astype(np.int64)

    def _other(self, bucket: np.ndarray, fp: np.ndarray) -> np.ndarray:
        return bucket ^ ((fp.astype(np.int64) * 0x5BD1E995) & (len(self.table) - 1))

    def contains(self, k: np.ndarray) -> np.ndarray:
        fp, a = self._fingerprint(k), self._first(k)
        b = self._other(a, fp)
        return (self.table[a] == fp[:, None]).any(1) | (self.table[b] == fp[:, None]).any(1)

    def insert(self, keys: np.ndarray) -> bool:
        """Adds distinct keys; False if one found no place, in which case the caller rebuilds at twice the size."""
        rng = np.random.default_rng(len(keys))
        fps, firsts = self._fingerprint(keys).tolist(), self._first(keys).tolist()
        tab, mask = self.table, len(self.table) - 1
        fill = (tab != 0).sum(1)
        for fp, at in zip(fps, firsts):
            other = at ^ ((fp * 0x5BD1E995) & mask)
            for bucket in (at, other):
                if fill[bucket] < self.SLOTS:
                    tab[bucket, np.flatnonzero(tab[bucket] == 0)[0]] = fp
                    fill[bucket] += 1
                    break
            else:
                bucket = other
                for _ in range(self.KICKS):
                    slot = int(rng.integers(self.SLOTS))
                    fp, tab[bucket, slot] = int(tab[bucket, slot]), fp
                    bucket ^= (fp * 0x5BD1E995) & mask
                    if fill[bucket] < self.SLOTS:
                        tab[bucket, np.flatnonzero(tab[bucket] == 0)[0]] = fp
                        fill[bucket] += 1
                        break
                else:
                    return False
        return True

    def delete(self, keys: np.ndarray) -> None:
        """Takes out one fingerprint for each key; the keys must have been inserted."""
        for fp, at in zip(self._fingerprint(keys).tolist(), self._first(keys).tolist()):
            for bucket in (at, int(self._other(np.int64(at), np.uint16(fp)))):
                hit = np.flatnonzero(self.table[bucket] == fp)
                if len(hit):
                    self.table[bucket, hit[0]] = 0
                    break

    @classmethod
    def of(cls, keys: np.ndarray) -> CuckooFilter:
        out = cls(len(keys))
        while not out.insert(keys):
            out._clear(2 * len(out.table))
        return out

    def to_bytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.table = np.frombuffer(data, np.uint16).reshape(-1, cls.SLOTS).copy()
        return out


def _line_keys(text: str | None, min_chars: int) -> list[bytes]:
    """Distinct 16-byte hashes of the countable line keys of a text."""
    keys = (line_key(x, min_chars) for x in (text or "").encode("utf-8", "surrogatepass").split(b"\n"))
    return list({xxhash.xxh3_128_digest(k) for k in keys if k is not None})


def references(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, k1, k2) for each distinct countable key of each row of docs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [_line_keys(t, min_chars) for t in b.column(1).to_pylist()]
            k = np.frombuffer(b"".join(x for f in found for x in f), "<i8").reshape(-1, 2)
            ids = b.column(0).take(pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]), pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(k[:, 0]), pa.array(k[:, 1])], ["doc_id", "k1", "k2"])

    return docs.select(F.col("doc_id").cast("bigint"), F.col("text")).mapInArrow(emit, "doc_id long, k1 long, k2 long")


def _counts(refs: DataFrame) -> DataFrame:
    """Exact counts; references are distinct per document already, so that the sum needs no distinct pass."""
    return refs.groupBy("shard", "k1", "k2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc"))


def _filters(keys: DataFrame) -> DataFrame:
    """One filter per shard. A shard holds about SHARD_KEYS keys by choice of the shard count, whatever one line's frequency."""

    def build(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None
        for b in rows:
            shard, k = b.column(0).to_numpy(), b.column(1).to_numpy()
            for at in np.split(np.arange(len(k)), np.flatnonzero(np.diff(shard)) + 1):
                if len(at) and last is not None and shard[at[0]] != last:
                    yield _filter_row(last, held)
                    held = []
                if len(at):
                    last = shard[at[0]]
                    held.append(k[at])
        if held:
            yield _filter_row(last, held)

    return keys.select("shard", "k1").repartition("shard").sortWithinPartitions("shard").mapInArrow(build, "shard long, filter binary")


def _filter_row(shard: int, held: list[np.ndarray]) -> pa.RecordBatch:
    keys = np.unique(np.concatenate(held).view(np.uint64))
    return pa.RecordBatch.from_arrays([pa.array([int(shard)], pa.int64()), pa.array([CuckooFilter.of(keys).to_bytes()], pa.binary())], ["shard", "filter"])


def _probe(refs: DataFrame, filters: DataFrame, salts: int) -> DataFrame:
    """The references that the filter of their shard may hold. A filter row leads the rows of its (shard, salt)."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for b in batches:
            shard, salt, isref = (b.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            k1, keep = b.column(3).to_numpy(zero_copy_only=False), np.zeros(b.num_rows, bool)
            edges = np.flatnonzero((np.diff(shard) != 0) | (np.diff(salt) != 0) | (np.diff(isref) != 0)) + 1
            for lo, hi in zip([0, *edges], [*edges, b.num_rows]):
                if hi == lo:
                    continue
                if not isref[lo]:
                    at, held = (shard[lo], salt[lo]), CuckooFilter.from_bytes(b.column(6)[lo].as_py())
                elif at == (shard[lo], salt[lo]):
                    keep[lo:hi] = held.contains(k1[lo:hi].astype(np.int64).view(np.uint64))
            got = b.filter(pa.array(keep))
            yield pa.RecordBatch.from_arrays([got.column(i) for i in (1, 3, 4, 5)], ["salt", "k1", "k2", "doc_id"])

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int")
    rows = refs.select("shard", salt.alias("salt"), F.lit(1).alias("isref"), "k1", "k2", "doc_id", F.lit(None).cast("binary").alias("filter"))
    heads = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"), F.lit(0).alias("isref"), F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"), F.lit(None).cast("bigint").alias("doc_id"), "filter")
    both = rows.unionByName(heads).repartition("shard", "salt").sortWithinPartitions("shard", "salt", "isref")
    return both.mapInArrow(probe, "salt int, k1 long, k2 long, doc_id long")


class LineIndex:
    """An index over inserted documents. Each change returns a new index; the old one stays readable."""

    def __init__(self, refs: DataFrame, counts: DataFrame, filters: DataFrame, shards: int, min_chars: int, min_docs: int):
        self.refs, self.counts, self.filters, self.shards, self.min_chars, self.min_docs = refs, counts, filters, shards, min_chars, min_docs

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, shard_keys: int = SHARD_KEYS) -> LineIndex:
        refs = references(docs, min_chars)
        refs = materialize(refs, "line-refs")
        shards = max(8, -(-refs.count() // shard_keys))
        refs = refs.withColumn("shard", F.pmod("k2", F.lit(shards)))
        counts = materialize(_counts(cls._distinct(refs)), "line-counts")
        filters = materialize(_filters(counts.filter(F.col("n_docs") >= min_docs)), "line-filters")
        return cls(refs, counts, filters, shards, min_chars, min_docs)

    @staticmethod
    def _distinct(refs: DataFrame) -> DataFrame:
        return refs.groupBy("shard", "k1", "k2", "doc_id").agg(F.lit(1).alias("one")).drop("one")

    def _changed(self, refs: DataFrame, touched: DataFrame) -> LineIndex:
        """Recounts the touched keys and brings the filters of their shards up to date by insertion and deletion."""
        keys = touched.select("shard", "k1", "k2").distinct()
        on = ["shard", "k1", "k2"]
        fresh = _counts(self._distinct(refs.join(keys, on, "left_semi")))
        counts = materialize(self.counts.join(keys, on, "left_anti").unionByName(fresh), "line-counts")
        was, now = (c.join(keys, on, "left_semi").filter(F.col("n_docs") >= self.min_docs).select(*on) for c in (self.counts, counts))
        steps = was.join(now, on, "left_anti").select("shard", "k1", F.lit(False).alias("add")).unionByName(now.join(was, on, "left_anti").select("shard", "k1", F.lit(True).alias("add")))

        def step(key, held, change):
            k = change["k1"].to_numpy(np.int64).view(np.uint64)
            up = change["add"].to_numpy(bool)
            f = CuckooFilter.from_bytes(held["filter"].iloc[0]) if len(held) else CuckooFilter(len(k))
            f.delete(k[~up])
            while not f.insert(k[up]):  # full: this shard's filter grows; its keys are inserted anew from the counts below
                return held.iloc[:0]
            return held.assign(filter=[f.to_bytes()]) if len(held) else held.reindex(range(1)).assign(shard=int(key[0]), filter=[f.to_bytes()])

        moved = materialize(self.filters.groupBy("shard").cogroup(steps.groupBy("shard")).applyInPandas(step, "shard long, filter binary"), "line-filters")
        lost = counts.filter(F.col("n_docs") >= self.min_docs).join(moved.select("shard"), "shard", "left_anti")
        return LineIndex(refs, counts, materialize(moved.unionByName(_filters(lost)), "line-filters"), self.shards, self.min_chars, self.min_docs)

    def insert(self, docs: DataFrame) -> LineIndex:
        new = materialize(references(docs, self.min_chars).withColumn("shard", F.pmod("k2", F.lit(self.shards))), "line-refs")
        return self._changed(self.refs.unionByName(new), new)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Forgets the documents with these doc_ids, as if they had never been inserted."""
        ids = doc_ids.select("doc_id").distinct()
        gone = self.refs.join(ids, "doc_id", "left_semi")
        return self._changed(materialize(self.refs.join(ids, "doc_id", "left_anti"), "line-refs"), gone)

    def drops(self, salts: int = SALTS) -> DataFrame:
        """(doc_id, keys): for each document with lines to lose, the sorted key hashes of those lines."""
        maybe = _probe(self.refs, self.filters, salts)
        many = self.counts.filter(F.col("n_docs") >= self.min_docs).select("k1", "k2", "last_doc", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
        gone = maybe.join(many, ["k1", "k2", "salt"]).filter(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
        return gone.groupBy("doc_id").agg(F.collect_set(F.struct("k1", "k2")).alias("keys"))


def _kept_lines(text: str | None, drop: np.ndarray | None, min_chars: int) -> tuple[bytes, int, int]:
    lines = (text or "").encode("utf-8", "surrogatepass").split(b"\n")
    if drop is None:
        return b"\n".join(lines), len(lines), 0
    gone = {drop[i : i + 16] for i in range(0, len(drop), 16)}
    kept = [x for x in lines if (k := line_key(x, min_chars)) is None or xxhash.xxh3_128_digest(k) not in gone]
    return b"\n".join(kept), len(lines), len(lines) - len(kept)


def rewrite(docs: DataFrame, index: LineIndex, text_out: bool = True) -> DataFrame:
    """(row, text (if text_out), n_lines, n_dropped, sha) of every row of docs, which must be in the index; row holds all columns but text."""
    drops = index.drops().select("doc_id", "keys")
    given = docs.select(F.col("doc_id").cast("bigint").alias("id"), "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    df = given.join(drops, F.col("id").eqNullSafe(F.col("doc_id")), "left").select("text", "keys", "row")
    min_chars = index.min_chars
    more = [("text", pa.string())] * text_out + [("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("sha", pa.string())]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys = b.column(1)
            flat = np.stack([keys.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1)], 1).astype("<i8").tobytes() if len(keys.values) else b""
            off, ok = keys.offsets.to_numpy(), keys.is_valid().to_numpy(zero_copy_only=False)
            rows = [_kept_lines(t, flat[16 * off[i] : 16 * off[i + 1]] if ok[i] else None, min_chars) for i, t in enumerate(b.column(0).to_pylist())]
            out = [[r[0].decode("utf-8", "surrogatepass") for r in rows]] * text_out + [[r[1] for r in rows], [r[2] for r in rows], [hashlib.sha256(r[0]).hexdigest() for r in rows]]
            yield pa.RecordBatch.from_arrays([*b.columns[2:], *(pa.array(v, t) for v, (_, t) in zip(out, more))], [*b.schema.names[2:], *(n for n, _ in more)])

    kinds = [("row", df.schema["row"].dataType)] + [("text", StringType())] * text_out + [("n_lines", LongType()), ("n_dropped", LongType()), ("sha", StringType())]
    return df.mapInArrow(emit, StructType([StructField(name, kind) for name, kind in kinds]))


def dedup_documents(docs: DataFrame) -> DataFrame:
    """docs with repeated lines taken out of their texts; n_chars, where docs have it, is counted anew."""
    out = rewrite(docs, LineIndex.build(docs))
    new = {"text": F.col("text"), "n_chars": F.length("text").cast("bigint")}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = rewrite(docs, LineIndex.build(docs), text_out=False)
    return out.select("row.doc_id", "n_lines", "n_dropped", F.col("sha").alias("kept_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i FROM documents),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, max(doc_id) AS last_doc FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.i, k.line, (c.key IS NOT NULL AND k.doc_id <> c.last_doc) AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
