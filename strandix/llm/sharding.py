"""Sharding by a permutation-filled lookup table, in DataFrame operations only.

Every shard orders the slots of a table of prime size by its own permutation, offset + k * skip, both drawn from a
hash of the shard's name. The shards take turns; each claims the first free slot of its order, until the table is
full. A row's key hashes to a slot, and the slot names the shard, so placement is one lookup in a broadcast table
whatever the number of rows. When a shard comes or goes, few slots change hands besides its own.

The table has `size` rows, a parameter, and that is all that is broadcast. Keys that hold many rows can be split:
with `spread` over 1, a row's slot also depends on a hash of its `spread_by` column modulo `spread`, which deals
each key over up to that many shards.

Defined results: a null key is the empty key; repeated rows go to one shard; empty tables give an empty result;
other columns are carried along (`place`) or ignored (the query).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.llm.common import fresh, table

#: A prime; about five hundred slots for each of 128 shards.
SIZE, SHARDS = 65_537, 128


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _draw(name: str, salt: str, below: int) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16) % below


def fill(shards: list[str], size: int = SIZE) -> list[int]:
    """The lookup table: for each slot the index of its shard in `shards`."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > size or not _is_prime(size):
        raise ValueError("shards must be distinct, at least one and at most the table's size, which must be prime")
    at = [_draw(s, "offset", size) for s in shards]
    skip = [_draw(s, "skip", size - 1) + 1 if size > 2 else 1 for s in shards]
    out, free = [-1] * size, size
    while free:
        for i in range(len(shards)):
            while out[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            out[at[i]] = i
            free -= 1
            if not free:
                break
    return out


def lookup_table(spark: SparkSession, shards: list[str], size: int = SIZE) -> DataFrame:
    """(slot, shard), made from one literal so that no Python process is needed to read it."""
    named = fill(shards, size)
    rows = F.posexplode(F.split(F.lit(",".join(map(str, named))), ","))
    names = F.array(*[F.lit(s) for s in shards])
    return spark.range(1).select(rows.alias("slot", "i")).select("slot", F.get(names, F.col("i").cast("int")).alias("shard"))


def slot_of(key: Column, size: int = SIZE) -> Column:
    """A key's slot, from the first 60 bits of its MD5."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("bigint") % size).cast("int")


def place(df: DataFrame, key: str, lookup: DataFrame, size: int = SIZE, spread: int = 1, spread_by: str | None = None) -> DataFrame:
    """df with columns `__slot` and `__shard`, with underscores before them where df has such columns."""
    slot, shard = fresh(df, "__slot", "__shard")
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    if spread > 1:
        k = F.concat(k, F.lit("\x1f"), F.pmod(F.xxhash64(spread_by or key), F.lit(spread)).cast("string"))
    at = lookup.select(F.col("slot").alias(slot), F.col("shard").alias(shard))
    return df.withColumn(slot, slot_of(k, size)).join(F.broadcast(at), slot).select(*[F.col(f"`{c}`") for c in df.columns], slot, shard)


def write_shards(df: DataFrame, key: str, shards: list[str], path: str, size: int = SIZE, files_per_shard: int = 8) -> None:
    """Writes df as Parquet, one folder a shard; rows of a shard are dealt over several files so that no task takes a whole one."""
    placed = place(df, key, lookup_table(df.sparkSession, shards, size), size)
    slot, shard = placed.columns[-2:]
    (folder,) = fresh(df, "shard")
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(files_per_shard))
    placed.repartition(shard, deal).drop(slot).withColumnRenamed(shard, folder).write.partitionBy(folder).parquet(path)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = [f"shard-{i:03d}" for i in range(SHARDS)]
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return place(docs, "doc_id", lookup_table(spark, shards)).select("doc_id", F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))


def sql() -> str:
    """The placement in SQL; the filled table is a list literal there, since SQL has no loop of turns. Tests check the filling."""
    named = ",".join(f"{i:03d}" for i in fill([f"shard-{i:03d}" for i in range(SHARDS)]))
    slot = f"(('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SIZE})::INT"
    return f"WITH t AS (SELECT string_split('{named}', ',') AS t), d AS (SELECT doc_id, {slot} AS slot FROM documents) SELECT doc_id, slot, 'shard-' || t[slot + 1] AS shard FROM d, t"
