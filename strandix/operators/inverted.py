"""A stored inverted index: postings dealt by term, written once, with insertion, replacement and deletion of documents.

The index is a folder of generations. A generation holds rows (doc_id, term, tf, len), partitioned by a bucket of the
term and sorted by term, so that a query reads its terms' buckets and, within them, the row groups of its terms. One
row with an empty term marks each document that the generation holds; a marker of length -1 is a deletion. A
document's live identity is its last marker: postings of older generations are passed over by a join with the markers
of the later ones, which are few until the index is consolidated into one generation.

Defined results: null text is a document without terms; a null doc_id is no document; a change
holds a doc_id once (keys of a table); an empty change changes nothing.
"""

from __future__ import annotations

import uuid
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.errors import EngineError
from strandix.functions.text import fold, query_terms, tokens

#: Buckets of terms, and the tasks that write one, so that a frequent term is not one task's.
BUCKETS, DEAL = 64, 4
MARKER, BROADCAST_ROWS = -1, 100_000


class TextIndex:
    """One state of an index. Each change returns the next state; earlier ones stay readable."""

    def __init__(self, spark: SparkSession, path: str, generations: tuple[str, ...] = (), kind: str = "bigint"):
        self.spark, self.path, self.generations, self.kind = spark, path, generations, kind

    # -- changes

    def _write(self, rows: DataFrame) -> TextIndex:
        name = f"g{len(self.generations):06d}-{uuid.uuid4().hex}"
        bucket = F.when(F.col("term") == "", F.lit(MARKER)).otherwise((F.crc32(F.col("term").cast("binary")) % BUCKETS).cast("int"))
        rows = rows.withColumn("bucket", bucket)
        dealt = rows.repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(DEAL))).sortWithinPartitions("bucket", "term", "doc_id")
        dealt.write.partitionBy("bucket").parquet(f"{self.path}/{name}")
        return TextIndex(self.spark, self.path, (*self.generations, name), rows.schema["doc_id"].dataType.simpleString())

    def index(self, docs: DataFrame, text: str = "text", doc: str = "doc_id", folder=fold) -> TextIndex:
        """Inserts the documents; those that the index has already are replaced."""
        toks = tokens(folder(F.coalesce(F.col(text), F.lit(""))))
        each = docs.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("doc_id"), toks.alias("t"))
        each = each.select("doc_id", F.size("t").alias("len"), F.explode(F.concat(F.array(F.lit("")), F.col("t"))).alias("term"))
        rows = each.groupBy("doc_id", "term", "len").agg(F.count(F.lit(1)).cast("int").alias("tf"))
        return self._write(rows.select("doc_id", "term", "tf", "len"))

    replace = index

    def delete(self, ids: DataFrame, doc: str = "doc_id") -> TextIndex:
        """Documents that the index does not have may be named; they stay absent."""
        gone = ids.filter(F.col(doc).isNotNull()).select(F.col(doc).alias("doc_id")).distinct()
        return self._write(gone.select("doc_id", F.lit("").alias("term"), F.lit(0).alias("tf"), F.lit(-1).alias("len")))

    def consolidated(self) -> TextIndex:
        """The live rows as one generation of a new index beside this one."""
        path = f"{self.path}-{uuid.uuid4().hex}"
        return TextIndex(self.spark, path)._write(self._live(self._rows()).select("doc_id", "term", "tf", "len"))

    # -- reads

    def _rows(self, buckets: list[int] | None = None) -> DataFrame:
        """(doc_id, term, tf, len, gen) of the given buckets of all generations, live or not."""
        if not self.generations:
            raise EngineError("LEX003", "the index has no generation")
        out = None
        for g, name in enumerate(self.generations):
            part = self.spark.read.schema(f"doc_id {self.kind}, term string, tf int, len int, bucket int").parquet(f"{self.path}/{name}")
            part = part if buckets is None else part.filter(F.col("bucket").isin(buckets))
            part = part.select("doc_id", "term", "tf", "len", F.lit(g).alias("gen"))
            out = part if out is None else out.unionByName(part)
        return out

    def _live(self, rows: DataFrame) -> DataFrame:
        if len(self.generations) == 1:
            return rows.filter("len >= 0")
        later = self._rows([MARKER]).filter("gen > 0").groupBy("doc_id").agg(F.max("gen").alias("last"))
        later = F.broadcast(later) if later.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else later
        return rows.join(later, "doc_id", "left").filter("gen = coalesce(last, 0) AND len >= 0").drop("last")

    def documents(self) -> DataFrame:
        """(doc_id, len) of the live documents."""
        return self._live(self._rows([MARKER])).select("doc_id", "len")

    def postings(self, terms: list[str]) -> DataFrame:
        """(doc_id, term, tf, len) of the live documents that hold the terms."""
        buckets = sorted({zlib.crc32(t.encode()) % BUCKETS for t in terms})
        return self._live(self._rows(buckets).filter(F.col("term").isin(terms)))

    def bm25(self, query: str, limit: int, allow: Column | DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
        """(doc_id, score) as `lexical.bm25` gives it; the corpus statistics are those of all live documents."""
        terms = query_terms(query)
        if not terms or limit <= 0:
            return self.documents().select("doc_id", F.lit(0.0).alias("score")).limit(0)
        tf = [F.sum(F.when(F.col("term") == t, F.col("tf")).otherwise(0)).alias(f"tf{i}") for i, t in enumerate(terms)]
        hits = self.postings(terms).groupBy("doc_id").agg(F.first("len").alias("len"), *tf)
        df = hits.agg(*[F.count(F.when(F.col(f"tf{i}") > 0, 1)).alias(f"df{i}") for i in range(len(terms))]).first()
        n, total = self._live(self._rows([MARKER])).agg(F.count(F.lit(1)), F.sum("len")).first()
        if isinstance(allow, DataFrame):
            hits = hits.join(allow, "doc_id", "left_semi")
        elif allow is not None:
            hits = hits.filter(allow)
        norm = F.lit(k1) * (F.lit(1.0 - b) + F.lit(b) * F.col("len") / F.lit(max(total or 0, 1) / max(n, 1)))
        score = F.lit(0.0)
        for i in range(len(terms)):
            c, d = F.col(f"tf{i}").cast("double"), F.lit(float(df[i]))
            score = score + F.when(c > 0, F.log(1 + (F.lit(float(n)) - d + 0.5) / (d + 0.5)) * c * (k1 + 1) / (c + norm)).otherwise(0.0)
        return hits.select("doc_id", score.alias("score")).filter("score > 0").orderBy(F.desc("score"), "doc_id").limit(limit)
