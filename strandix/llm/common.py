"""What the operators share: words, scratch tables in the shared folder, table reading."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.sources.shared import scratch

#: White space of the word contract: space and the control characters 9 to 13.
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandix_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that `materialize` wrote, once nothing will read it any more."""
    path = getattr(df, "_strandix_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """For each name one that df has no column of, whatever the case: the name itself or with underscores before it."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def words(text: Column) -> Column:
    """Words `[^\\x20\\x09-\\x0D]+` of a text, in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE + "+"), "")


def small(df: DataFrame, most: int) -> bool:
    """Whether df has at most `most` rows; it reads no more than that many of them."""
    return df.limit(most + 1).count() <= most


def bounded_broadcast(df: DataFrame, most: int) -> DataFrame:
    """df with a broadcast hint if its row count has been checked to be at most `most`; else df, for a shuffled join."""
    return F.broadcast(df) if small(df, most) else df
