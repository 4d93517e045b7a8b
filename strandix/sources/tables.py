"""Reading and writing tables: Parquet, JSON lines with a terminal record, and the raw two-column relation."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandix.errors import EngineError

RAW = T.StructType([T.StructField("primary_key", T.BinaryType(), False), T.StructField("row", T.BinaryType(), False)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_relation(df: DataFrame) -> DataFrame:
    """A relation of a key and a row in bytes; other shapes are refused."""
    if [(f.name, f.dataType) for f in df.schema] != [(f.name, f.dataType) for f in RAW]:
        raise EngineError("SRC001", "a raw relation has primary_key BINARY and row BINARY")
    return df


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with a declared schema; a malformed line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.json(path)


def stream_lines(df: DataFrame) -> Iterator[str]:
    """Rows as JSON lines, one partition at a time, then a completion record: without it a reader has only a part."""
    n = 0
    whole = F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]), {"ignoreNullFields": "false"})
    for r in df.select(whole.alias("row")).toLocalIterator():
        n += 1
        yield '{"row":' + r["row"] + "}"
    yield json.dumps({"complete": True, "rows": n})


def read_lines(lines: Iterator[str]) -> list[dict]:
    """The rows of a finished stream; an unfinished one is an error."""
    rows = []
    for x in map(json.loads, lines):
        if x.get("complete"):
            if x["rows"] != len(rows):
                raise EngineError("SRC002", "row count differs")
            return rows
        rows.append(x["row"])
    raise EngineError("SRC002", "the stream has no completion record")
