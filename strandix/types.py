"""Logical column types, their SQL names, their Spark types, and the checks of literals and parameters."""

from __future__ import annotations

import datetime
import json
import re
import uuid
from dataclasses import dataclass
from decimal import ROUND_HALF_EVEN, Decimal

from pyspark.sql import types as T

from strandix.errors import sql_error

#: SQL spellings and the canonical name. Note that INT8 has eight bits here.
SPELLINGS = {
    "BOOLEAN": "bool", "BOOL": "bool",
    "TINYINT": "i8", "INT8": "i8", "SMALLINT": "i16", "INT16": "i16", "INTEGER": "i32", "INT": "i32", "INT32": "i32", "BIGINT": "i64", "INT64": "i64",
    "UINT8": "u8", "UINT16": "u16", "UINT32": "u32", "UINT64": "u64",
    "REAL": "f32", "FLOAT32": "f32", "DOUBLE": "f64", "DOUBLE PRECISION": "f64", "FLOAT": "f64", "FLOAT64": "f64",
    "TEXT": "text", "BINARY": "binary", "DATE": "date", "TIME": "time", "TIMESTAMP": "timestamp", "INTERVAL": "interval", "UUID": "uuid", "JSON": "json",
}
_SPARK = {
    "bool": T.BooleanType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(),
    "u8": T.ShortType(), "u16": T.IntegerType(), "u32": T.LongType(), "u64": T.DecimalType(20, 0),
    "f32": T.FloatType(), "f64": T.DoubleType(), "text": T.StringType(), "binary": T.BinaryType(), "date": T.DateType(),
    "time": T.LongType(), "timestamp": T.TimestampNTZType(), "uuid": T.StringType(), "json": T.StringType(),
    "interval": T.StructType([T.StructField("months", T.IntegerType()), T.StructField("days", T.IntegerType()), T.StructField("nanos", T.LongType())]),
}


@dataclass(frozen=True)
class Logical:
    """A column type; precision and scale are set for decimals only."""

    name: str
    precision: int = 0
    scale: int = 0

    @property
    def spark(self) -> T.DataType:
        return T.DecimalType(self.precision, self.scale) if self.name == "decimal" else _SPARK[self.name]

    @property
    def comparable(self) -> bool:
        return self.name != "json"

    def check(self, value):
        """The value as this type holds it; None stays None. Another family or domain is an error, never a cast."""
        if value is None:
            return None
        n = self.name
        if n == "bool" and isinstance(value, bool):
            return value
        if n[0] in "iu" and n[1:].isdigit() and isinstance(value, int) and not isinstance(value, bool):
            bits = int(n[1:])
            low, high = (-(1 << (bits - 1)), (1 << (bits - 1)) - 1) if n[0] == "i" else (0, (1 << bits) - 1)
            if low <= value <= high:
                return Decimal(value) if n == "u64" else value
        if n in ("f32", "f64") and isinstance(value, float):
            return float("nan") if value != value else value + 0.0
        if n == "text" and isinstance(value, str):
            return value
        if n == "binary" and isinstance(value, (bytes, bytearray)):
            return bytearray(value)
        if n == "decimal" and isinstance(value, Decimal):
            rounded = value.quantize(Decimal(1).scaleb(-self.scale), ROUND_HALF_EVEN)
            if len(rounded.as_tuple().digits) <= self.precision:
                return rounded
        if n == "date" and isinstance(value, datetime.date) and not isinstance(value, datetime.datetime):
            return value
        if n == "timestamp" and isinstance(value, datetime.datetime):
            return value
        if n == "time" and isinstance(value, int) and 0 <= value < 86_400_000_000_000:
            return value
        if n == "uuid" and isinstance(value, uuid.UUID):
            return str(value)
        if n == "interval" and isinstance(value, tuple) and len(value) == 3:
            return value
        if n == "json" and isinstance(value, str):
            return canonical_json(value)
        raise sql_error(6, f"{type(value).__name__} for {n}")


def parse_type(text: str) -> Logical:
    """The type of an SQL spelling such as BIGINT or DECIMAL(10, 2)."""
    name = re.sub(r"\s+", " ", text.strip().upper())
    if m := re.fullmatch(r"(?:DECIMAL|NUMERIC) ?\( ?(\d+) ?, ?(\d+) ?\)", name):
        p, s = int(m[1]), int(m[2])
        if 1 <= p <= 38 and s <= p:
            return Logical("decimal", p, s)
    elif name in SPELLINGS:
        return Logical(SPELLINGS[name])
    raise sql_error(1, f"type {text}")


def of_spark(kind: T.DataType) -> Logical:
    """The logical type of a column of an existing table."""
    if isinstance(kind, T.DecimalType):
        return Logical("decimal", kind.precision, kind.scale)
    for name in ("bool", "i8", "i16", "i32", "i64", "f32", "f64", "text", "binary", "date", "timestamp"):
        if _SPARK[name] == kind:
            return Logical(name)
    if isinstance(kind, T.TimestampType):
        return Logical("timestamp")
    raise sql_error(10, f"column type {kind.simpleString()}")


def canonical_json(text: str) -> str:
    """Canonical JSON: keys in byte order, no spaces, no repeated keys, no NaN."""

    def pairs(items):
        keys = [k for k, _ in items]
        if len(set(keys)) != len(keys):
            raise sql_error(6, "repeated key in JSON")
        return dict(sorted(items, key=lambda kv: kv[0].encode()))

    def constant(name):
        raise sql_error(6, f"{name} in JSON")

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except ValueError as e:
        raise sql_error(6, str(e)) from e
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"))
