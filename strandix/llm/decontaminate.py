"""Benchmark decontamination: size-partitioned MinHash containment search, in DataFrame operations only.

Texts are lower-cased and cut into words of letters and digits; a test item is the set of its five-word shingles
(an item of fewer words is one shingle of all its words). A document holds an item if it contains at least
`num`/`den` = 0.8 of the item's distinct shingles, however long the document is.

Items are partitioned by set size into powers of two. All items of a partition get the same number of bottom-k
MinHash values, floor((1 - 0.8) * largest size) + 1 of them: a document that holds 0.8 of an item lacks fewer
shingles than that, so it holds one of the values at least, and the search misses nothing. Each document's
shingle hashes meet the values in one hash join; the candidates are verified by counting exact shingle strings.

The items' values are broadcast only while their checked count is at most `broadcast_rows`; beyond it the same
join is shuffled. Defined results: null or wordless texts and items match nothing; repeated documents give one row
per (doc_id, item_id); empty tables give an empty result; other columns are ignored or carried along.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.llm.common import bounded_broadcast, fresh, materialize, table

WORDS, NUM, DEN = 5, 4, 5
BROADCAST_ROWS = 1_000_000


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _grams(w: str, size: int | Column, make) -> Column:
    """make(i) for each start i of a run of `size` words of the array column w; null if it has fewer words."""
    last = F.size(w) - size
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), make))


def _exact(w: str, size: int | Column) -> Column:
    return F.array_distinct(_grams(w, size, lambda i: F.array_join(F.slice(w, i + 1, size), " ")))


def item_shingles(items: DataFrame, words: int = WORDS) -> DataFrame:
    """(item_id, len, n, shingles): exact distinct shingles of every item that has a word."""
    df = items.select("item_id", _tokens(F.col("text")).alias("w")).filter(F.size("w") > 0)
    df = df.withColumn("len", F.least(F.size("w"), F.lit(words))).withColumn("shingles", _exact("w", F.col("len")))
    return df.select("item_id", "len", F.size("shingles").alias("n"), "shingles")


def minhash_index(shingles: DataFrame, num: int = NUM, den: int = DEN) -> DataFrame:
    """(part, len, h, item_id, n): the bottom-k MinHash values of every item, k fixed by its size partition."""
    df = shingles.withColumn("part", F.ceil(F.log2(F.col("n").cast("double"))).cast("int"))
    k = F.floor(F.pow(F.lit(2.0), F.col("part")) * (den - num) / den).cast("int") + 1
    # The hash runs over the words one by one, as it does for the documents.
    values = F.sort_array(F.transform("shingles", lambda s: F.aggregate(F.split(s, " "), F.lit(42).cast("bigint"), lambda a, x: F.xxhash64(a, x))))
    return df.select("part", "len", "item_id", "n", F.explode(F.slice(values, 1, k)).alias("h"))


def _hash(w: str, size: int, i: Column) -> Column:
    h = F.lit(42).cast("bigint")
    for k in range(size):
        h = F.xxhash64(h, F.get(w, i + k))
    return h


def candidates(docs: DataFrame, index: DataFrame, lengths: list[int], num: int = NUM, den: int = DEN, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id) pairs where the document has one of the item's values and shingles enough for the item."""
    w = docs.select("doc_id", _tokens(F.col("text")).alias("w"))
    parts = []
    for size in lengths:
        h = _grams("w", size, partial(_hash, "w", size))
        parts.append(w.select("doc_id", (F.size("w") - size + 1).alias("most"), F.lit(size).alias("len"), F.explode(h).alias("h")))
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    hit = rows.join(bounded_broadcast(index, broadcast_rows), ["h", "len"]).filter(den * F.col("most") >= num * F.col("n"))
    return hit.select("doc_id", "item_id").distinct()


def contaminated(docs: DataFrame, items: DataFrame, words: int = WORDS, num: int = NUM, den: int = DEN, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_found): every document that holds num/den of an item's shingles."""
    docs = docs.select("doc_id", "text")
    shingles = materialize(item_shingles(items, words), "items")
    lengths = sorted(r[0] for r in shingles.select("len").distinct().collect()) or [words]  # at most `words` values
    found = materialize(candidates(docs, minhash_index(shingles, num, den), lengths, num, den, broadcast_rows), "candidates")
    ids = bounded_broadcast(found.select(F.col("doc_id").alias("__id")).distinct(), broadcast_rows)
    near = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi").select("doc_id", _tokens(F.col("text")).alias("w"))
    exact = shingles.select("item_id", "len", "n", F.explode("shingles").alias("s"))
    rows = None
    for size in lengths:
        part = near.select("doc_id", F.lit(size).alias("len"), F.explode(_exact("w", size)).alias("s"))
        rows = part if rows is None else rows.unionByName(part)
    counts = rows.join(bounded_broadcast(exact, broadcast_rows), ["s", "len"]).groupBy("doc_id", "item_id").agg(F.first("n").alias("n_shingles"), F.countDistinct("s").alias("n_found"))
    pairs = found.select(F.col("doc_id").alias("__id"), F.col("item_id").alias("__item"))
    held = counts.filter(den * F.col("n_found") >= num * F.col("n_shingles"))
    return held.join(pairs, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("item_id") == F.col("__item")), "left_semi")


def drop_contaminated(docs: DataFrame, items: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """The rows of docs that hold no item."""
    (bad_id,) = fresh(docs, "bad")
    bad = materialize(contaminated(docs, items).select(F.col("doc_id").alias(bad_id)).distinct(), "contaminated")
    return docs.join(bounded_broadcast(bad, broadcast_rows), F.col("doc_id").eqNullSafe(F.col(bad_id)), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "item_id", F.col("n_shingles").cast("bigint").alias("n_shingles"), F.col("n_found").cast("bigint").alias("n_found"))


SQL = r"""
WITH iw AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(len(w), 5) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2),
        lambda p: array_to_string(w[p:p + least(len(w), 5) - 1], ' '))) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, k, count(*) AS n_shingles FROM i GROUP BY item_id, k),
dw AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
d AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2),
        lambda p: array_to_string(w[p:p + k - 1], ' '))) AS s FROM dw, (SELECT DISTINCT k FROM n) WHERE len(w) >= k)
SELECT d.doc_id, i.item_id, n.n_shingles, count(*) AS n_found
FROM d JOIN i ON d.s = i.s AND d.k = i.k JOIN n ON n.item_id = i.item_id
GROUP BY d.doc_id, i.item_id, n.n_shingles HAVING 5 * count(*) >= 4 * n.n_shingles
"""
