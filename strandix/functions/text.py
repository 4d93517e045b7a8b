"""The canonical analyzer, and glob patterns."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from strandix.errors import EngineError

MAX_TOKEN_BYTES, MAX_PATTERN_BYTES = 256, 1_024
_TOKEN = r"[\p{IsAlphabetic}\p{N}]+"


@F.pandas_udf(StringType())
def _folded(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def fold(text: Column) -> Column:
    """NFKC and full case folding. ASCII needs neither, and texts whose letters fold as they lower-case stay in the JVM."""
    simple = text.rlike(r"^[\x00-\x7FÀ-ÖØ-Þà-öø-ÿ–—‘’“”]*$")
    return F.when(simple, F.lower(text)).otherwise(_folded(F.when(~simple, text)))


def raw_tokens(folded: Column) -> Column:
    return F.regexp_extract_all(folded, F.lit(_TOKEN), F.lit(0))


def tokens(folded: Column) -> Column:
    """The tokens of a folded text, without those of more than 256 bytes."""
    return F.filter(raw_tokens(folded), lambda t: F.octet_length(t) <= MAX_TOKEN_BYTES)


def positions(folded: Column) -> Column:
    """(term, position) of each token; a token that is too long is dropped and its position kept."""
    all_ = F.transform(raw_tokens(folded), lambda t, i: F.struct(t.alias("term"), i.alias("position")))
    return F.filter(all_, lambda t: F.octet_length(t["term"]) <= MAX_TOKEN_BYTES)


def query_tokens(text: str) -> list[str]:
    """The tokens of a query in order, cut by the same classes as documents are: marks that are alphabetic belong to a word."""
    found = regex.findall(r"[\p{Alphabetic}\p{N}]+", unicodedata.normalize("NFKC", text).casefold())
    return [t for t in found if len(t.encode()) <= MAX_TOKEN_BYTES]


def query_terms(text: str) -> list[str]:
    """The distinct terms of a query in byte order."""
    return sorted(set(query_tokens(text)), key=lambda t: t.encode())


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a glob of ? * [abc] [a-z] [^...] and backslash escapes; only ^ negates a class."""
    if len(pattern.encode()) > MAX_PATTERN_BYTES:
        raise EngineError("LIM005", "pattern too long")
    out, i = [], 0

    def plain(c: str) -> str:
        return "\\" + c if not c.isalnum() and c.isascii() and c not in " _" else c

    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "\\":
            i += 1
            if i == len(pattern):
                raise EngineError("PAT001", "pattern ends in an escape")
            out.append(plain(pattern[i]))
        elif c == "[":
            end, body = i + 1, []
            negated = end < len(pattern) and pattern[end] == "^"
            end += negated
            while end < len(pattern) and (pattern[end] != "]" or not body):
                step = 2 if pattern[end] == "\\" and end + 1 < len(pattern) else 1
                one = pattern[end + step - 1]
                if pattern[end : end + 1] == "-" and body and end + 1 < len(pattern) and pattern[end + 1] != "]":
                    body.append("-")
                else:
                    body.append(plain(one))
                end += step
            if end >= len(pattern):
                raise EngineError("PAT001", "class without end")
            out.append("[" + "^" * negated + "".join(body) + "]")
            i = end
        else:
            out.append(plain(c))
        i += 1
    return "(?s)^" + "".join(out) + "$"


def literal_prefix(pattern: str) -> str:
    """What every match starts with, for pruning."""
    out, i = [], 0
    while i < len(pattern) and pattern[i] not in "*?[":
        if pattern[i] == "\\" and i + 1 < len(pattern):
            i += 1
        out.append(pattern[i])
        i += 1
    return "".join(out)


def glob(c: Column, pattern: str) -> Column:
    hit = c.rlike(glob_regex(pattern))
    prefix = literal_prefix(pattern)
    return c.startswith(F.lit(prefix)) & hit if prefix else hit
