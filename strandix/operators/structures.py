"""Keyed structures: an operation log folded into the state at a logical time, and the reads over that state.

A log is a table of operations in commit order `seq`. Each family's state is a table with one row for each field,
member, position or entry, and a header with one row for each key, since an empty structure still exists. Reads take
the logical time; something expires when its expiry is at or before it. The wall clock is never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandix.errors import EngineError
from strandix.functions.text import glob

SET_KEYS, SET_OUTPUT, SET_VISITS, BATCH, EXPIRE_KEYS = 64, 65_536, 1_048_576, 4_096, 4_096
_INTEGER = r"^(0|-?[1-9][0-9]*)$"


def visible(expiry: str | Column, at: int) -> Column:
    c = F.col(expiry) if isinstance(expiry, str) else expiry
    return c.isNull() | (c > F.lit(at))


def ttl(expiry: str | Column, at: int) -> Column:
    """persistent, or the microseconds that remain."""
    c = F.col(expiry) if isinstance(expiry, str) else expiry
    return F.when(c.isNull(), "persistent").otherwise((c - F.lit(at)).cast("string"))


# -- strings and counters


def fold_strings(log: DataFrame, at: int) -> DataFrame:
    """(key, value, expiry) from SET and DELETE operations: log has key, seq, op, value, expiry. The last one decides."""
    last = log.groupBy("key").agg(F.max_by(F.struct("op", "value", "expiry"), "seq").alias("x"))
    return last.filter(F.col("x.op") == "set").select("key", "x.value", "x.expiry").filter(visible("expiry", at))


def fold_conditional(log: DataFrame) -> DataFrame:
    """As fold_strings, with `when` NX or XX and `at` the time of each operation. What one does depends on what came before
    it, so each key's operations are folded in order; a key's log is a batch of operations by contract."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        value, expiry = None, None
        for r in pdf.sort_values("seq").itertuples():
            held = value is not None and (expiry is None or expiry > r.at)
            if r.op == "delete":
                value, expiry = None, None
            elif r.op == "set" and (r.when not in ("NX", "XX") or (r.when == "NX") != held):
                value, expiry = r.value, None if pd.isna(r.expiry) else int(r.expiry)
            elif r.op == "expire" and held:
                expiry = None if pd.isna(r.expiry) else int(r.expiry)
        return pd.DataFrame([[pdf["key"].iloc[0], value, expiry]] if value is not None else [], columns=["key", "value", "expiry"])

    return log.groupBy("key").applyInPandas(fold, "key string, value string, expiry long")


def fold_counters(log: DataFrame) -> DataFrame:
    """(key, value) of increments. Sums are exact; one that leaves 64 bits is an error."""
    total = log.groupBy("key").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("value"))
    wide = (F.col("value") > 9223372036854775807) | (F.col("value") < -9223372036854775808)
    return total.select("key", F.when(wide, F.raise_error(F.lit("counter overflow")).cast("bigint")).otherwise(F.col("value").cast("bigint")).alias("value"))


def fold_field_counters(log: DataFrame) -> DataFrame:
    """(key, field, value) of increments of hash fields, a missing field counting from 0. Sums are exact, as in fold_counters."""
    named = log.select(F.struct("key", "field").alias("key"), "delta")
    return fold_counters(named).select("key.key", "key.field", "value")


def outcomes(log: DataFrame) -> DataFrame:
    """(key, seq, op, added, updated, removed) of each put and remove on (key, field): what it found decides what it did.

    A field is held if its last put or remove before was a put that has not expired at that time; log: key, field, seq,
    op, value, expiry and at, the time of the operation. One window over each field's own operations, no fold of a key.
    """
    w = Window.partitionBy("key", "field").orderBy("seq")
    prev = log.filter(F.col("op").isin("put", "remove")).withColumn("was", F.lag(F.struct("op", "expiry")).over(w))
    held = F.coalesce((F.col("was.op") == "put") & (F.col("was.expiry").isNull() | (F.col("was.expiry") > F.col("at"))), F.lit(False))
    put = F.col("op") == "put"
    return prev.select("key", "field", "seq", "op", (put & ~held).alias("added"), (put & held).alias("updated"), (~put & held).alias("removed"))


def counter(text: Column) -> Column:
    """A stored counter as an integer: missing is 0; anything but canonical decimal text is an error."""
    return F.when(text.isNull(), F.lit(0).cast("bigint")).when(text.rlike(_INTEGER), text.cast("bigint")).otherwise(F.raise_error(F.lit("not an integer")).cast("bigint"))


# -- hashes and sets


def fold_members(log: DataFrame, at: int) -> DataFrame:
    """(key, field, value, expiry) from operations create, put, remove and delete on (key, field).

    A structure that was deleted and made again shows nothing of its former life: only operations after the key's
    last create or delete count. A put clears the field's own expiry unless it gives one.
    """
    cuts = log.filter(F.col("op").isin("create", "delete")).groupBy("key").agg(F.max("seq").alias("cut"))
    live = log.filter(F.col("op").isin("put", "remove")).join(cuts, "key", "left").filter(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    last = live.groupBy("key", "field").agg(F.max_by(F.struct("op", "value", "expiry"), "seq").alias("x"))
    return last.filter(F.col("x.op") == "put").select("key", "field", "x.value", "x.expiry").filter(visible("expiry", at))


def headers(log: DataFrame, at: int) -> DataFrame:
    """(key, expiry) of the structures that exist at a time, empty ones too; expiry comes from the last create or expire,
    and a delete ends it."""
    own = F.when(F.col("op") != "delete", F.col("expiry"))
    last = log.groupBy("key").agg(F.max_by("op", F.when(F.col("op") != "expire", F.col("seq"))).alias("op"), F.max_by(own, F.when(F.col("op").isin("create", "expire", "delete"), F.col("seq"))).alias("expiry"))
    return last.filter((F.col("op") != "delete") & visible("expiry", at)).select("key", "expiry")


def live_members(log: DataFrame, at: int) -> DataFrame:
    """fold_members of the structures that have not expired as wholes; an expired one is made again by a create."""
    return fold_members(log, at).join(headers(log, at).select("key"), "key", "left_semi")


def fold_expiring(log: DataFrame, at: int) -> DataFrame:
    """(key, field, value, expiry) from put, remove and expire on (key, field), where expire sets a field's own expiry.

    log: key, field, seq, op, value, expiry and at, the time of the operation. An expire on a field that is missing or
    has expired by then does nothing, so a field lives only if each expire since its last put found it alive.
    """
    w = Window.partitionBy("key", "field").orderBy("seq")
    ops = log.filter(F.col("op").isin("put", "remove", "expire"))
    ops = ops.withColumn("life", F.sum(F.when(F.col("op") == "expire", 0).otherwise(1)).over(w)).withColumn("before", F.lag("expiry").over(w))
    late = (F.col("op") == "expire") & F.coalesce(F.col("before") <= F.col("at"), F.lit(False))
    lives = ops.groupBy("key", "field", "life").agg(F.min_by("op", "seq").alias("op"), F.min_by("value", "seq").alias("value"), F.max_by("expiry", "seq").alias("expiry"), F.max(late).alias("late"))
    last = lives.groupBy("key", "field").agg(F.max_by(F.struct("op", "value", "expiry", "late"), "life").alias("x"))
    return last.filter((F.col("x.op") == "put") & ~F.col("x.late")).select("key", "field", "x.value", "x.expiry").filter(visible("expiry", at))


def counters_of(state: DataFrame, keys: list[str]) -> DataFrame:
    """(position, key, value) of stored counters in the order asked for; a missing one is 0, other text is an error."""
    if len(keys) > BATCH:
        raise EngineError("LIM009", "too many keys")
    asked = state.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(k) for k in keys])).alias("position", "key"))
    return asked.join(state.filter(F.col("key").isin(keys)).select("key", "value"), "key", "left").select("position", "key", counter(F.col("value")).alias("value")).orderBy("position")


def allowed_by(strings: DataFrame, prefix: str, value: str, at: int) -> DataFrame:
    """(doc_id) of the strings under a key prefix that hold exactly this value at a time: the filter of a search."""
    hit = F.col("key").startswith(prefix) & (F.col("value") == value) & visible("expiry", at)
    return strings.filter(hit).select(F.substring("key", F.lit(len(prefix) + 1), F.length("key")).cast("bigint").alias("doc_id")).filter("doc_id IS NOT NULL")


def get_many(state: DataFrame, key, fields: list[str]) -> DataFrame:
    """(position, field, value) in the order asked for; repeated fields are repeated, missing ones null."""
    if len(fields) > BATCH:
        raise EngineError("LIM009", "too many fields")
    asked = state.sparkSession.range(1).select(F.posexplode(F.array(*[F.lit(f) for f in fields])).alias("position", "field"))
    return asked.join(state.filter(F.col("key") == key).select("field", "value"), "field", "left").select("position", "field", "value").orderBy("position")


def is_member(state: DataFrame, key, members: list[str]) -> DataFrame:
    """(position, member, present) in the order asked for."""
    got = get_many(state.withColumn("value", F.lit(True)), key, members)
    return got.select("position", F.col("field").alias("member"), F.coalesce("value", F.lit(False)).alias("present")).orderBy("position")


def scan(state: DataFrame, key, limit: int, after: str | None = None, reverse: bool = False) -> DataFrame:
    """Fields in byte order, strictly after the cursor (before it, in reverse)."""
    df = state.filter(F.col("key") == key)
    if after is not None:
        df = df.filter(F.col("field") < after if reverse else F.col("field") > after)
    return df.orderBy(F.desc("field") if reverse else F.asc("field")).limit(limit)


@dataclass(frozen=True)
class Match:
    rows: list
    cursor: str | None
    stop: str  # exhausted, output or visit


def scan_match(fields: DataFrame, key, pattern: str, at: int, output: int, visits: int, after: str | None = None) -> Match:
    """Fields that match a glob. `fields` holds expired fields too: they are visited, not returned. The cursor is the last one visited."""
    if not any(c in pattern for c in "*?[\\"):
        rows = fields.filter((F.col("key") == key) & (F.col("field") == pattern) & visible("expiry", at)).collect()
        return Match(rows, None, "exhausted")
    seen = scan(fields, key, visits + 1, after).withColumn("hit", glob(F.col("field"), pattern) & visible("expiry", at)).orderBy("field").collect()
    rows, cursor = [], after
    for r in seen[:visits]:
        cursor = r["field"]
        if r["hit"]:
            rows.append(r)
            if len(rows) == output:
                return Match(rows, cursor, "output")
    return Match(rows, cursor, "visit") if len(seen) > visits else Match(rows, None, "exhausted")


def cardinality(header: DataFrame, state: DataFrame) -> DataFrame:
    """(key, n) for every structure that exists, 0 for an empty one."""
    n = state.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    return header.select("key").join(n, "key", "left").select("key", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


# -- set algebra: members of one set are rows (key, member)
#
# A request is refused beyond its ceilings of visits and output. With whole=True there is no request: the operation is one
# plan over tables of any size, nothing is counted before it, and only the number of keys is limited.


def _set_keys(keys: list) -> list:
    if not 1 <= len(keys) <= SET_KEYS:
        raise EngineError("LIM010", "one to 64 keys")
    return keys


def _visited(state: DataFrame, keys: list, whole: bool = False) -> DataFrame:
    """The members of the asked sets, or an error if they are more than a request may visit."""
    state = state.filter(F.col("key").isin(_set_keys(keys))).select("key", "member").distinct()
    return state if whole else bounded(state, SET_VISITS)


def set_union(state: DataFrame, keys: list, whole: bool = False) -> DataFrame:
    got = _visited(state, keys, whole).select("member").distinct()
    return (got if whole else bounded(got)).orderBy("member")


def set_intersection(state: DataFrame, keys: list, whole: bool = False) -> DataFrame:
    asked = list(dict.fromkeys(_set_keys(keys)))
    bit = F.coalesce(*[F.when(F.col("key") == k, F.shiftleft(F.lit(1).cast("bigint"), i)) for i, k in enumerate(asked)])
    held = _visited(state, asked, whole).groupBy("member").agg(F.bit_or(bit).alias("held"))
    got = held.filter(F.bit_count("held") == len(asked)).select("member")
    return (got if whole else bounded(got)).orderBy("member")


def set_difference(state: DataFrame, keys: list, whole: bool = False) -> DataFrame:
    first, *rest = _set_keys(keys)
    here = F.when(F.col("key") == first, 1).otherwise(0)
    there = F.when(F.col("key").isin(rest), 1).otherwise(0) if rest else F.lit(0)
    held = _visited(state, keys, whole).groupBy("member").agg(F.max(here).alias("here"), F.max(there).alias("there"))
    got = held.filter("here = 1 AND there = 0").select("member")
    return (got if whole else bounded(got)).orderBy("member")


def bounded(df: DataFrame, most: int = SET_OUTPUT) -> DataFrame:
    """df, or an error if it has more rows: never a part of a result."""
    if df.limit(most + 1).count() > most:
        raise EngineError("LIM010", f"more than {most} members")
    return df


def check_kind(kinds: DataFrame, keys: list, kind: str) -> None:
    """Every key that exists must be of the kind; kinds: (key, kind)."""
    if not kinds.filter(F.col("key").isin(keys) & (F.col("kind") != kind)).isEmpty():
        raise EngineError("STR001", f"a key is not a {kind}")


# -- sorted sets: rows (key, member, score)


def with_ranks(state: DataFrame) -> DataFrame:
    """Zero-based rank and reverse rank by (score, member) in each key. For keys of unbounded size use z_range, which does not rank them whole."""
    up = Window.partitionBy("key").orderBy("score", "member")
    down = Window.partitionBy("key").orderBy(F.desc("score"), F.desc("member"))
    return state.withColumn("rank", (F.row_number().over(up) - 1).cast("bigint")).withColumn("rev_rank", (F.row_number().over(down) - 1).cast("bigint"))


def normal_range(start: int, stop: int, n: int) -> tuple[int, int] | None:
    """Inclusive signed bounds as positions 0..n-1, clamped; None if nothing is left."""
    start, stop = (max(0, start + n) if start < 0 else start), (stop + n if stop < 0 else min(stop, n - 1))
    return None if start > stop or start >= n or stop < 0 else (start, stop)


def z_range(state: DataFrame, key, start: int, stop: int, reverse: bool = False) -> DataFrame:
    """Members by rank, both ends included; negative ranks count from the end. Reverse turns ties around too."""
    df = state.filter(F.col("key") == key).select("member", "score")
    got = normal_range(start, stop, df.count() if start < 0 or stop < 0 else 1 << 62)
    if got is None:
        return df.limit(0)
    order = [F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")]
    return df.orderBy(*order).offset(got[0]).limit(min(got[1] - got[0] + 1, 2_000_000_000))


def z_range_by_score(state: DataFrame, key, low: float | None, high: float | None, low_open: bool = False, high_open: bool = False, offset: int = 0, limit: int | None = None, reverse: bool = False) -> DataFrame:
    """Members between two scores; None is unbounded. Offset and limit apply after the direction."""
    df = state.filter(F.col("key") == key).select("member", "score")
    if low is not None:
        df = df.filter(F.col("score") > low if low_open else F.col("score") >= low)
    if high is not None:
        df = df.filter(F.col("score") < high if high_open else F.col("score") <= high)
    df = df.orderBy(*([F.desc("score"), F.desc("member")] if reverse else [F.asc("score"), F.asc("member")])).offset(offset)
    return df if limit is None else df.limit(limit)


def z_outcomes(log: DataFrame) -> DataFrame:
    """(key, member, seq, outcome) of each add and remove: added, updated, unchanged, removed or missing.

    log: key, member, seq, op (add or remove), score. One window over each member's own operations.
    """
    w = Window.partitionBy("key", "member").orderBy("seq")
    was = log.withColumn("score", clean_score(F.col("score"))).withColumn("was", F.lag(F.struct("op", "score")).over(w))
    held, add = F.coalesce(F.col("was.op") == "add", F.lit(False)), F.col("op") == "add"
    outcome = F.when(add & ~held, "added").when(add & (F.col("was.score") == F.col("score")), "unchanged").when(add, "updated").when(held, "removed").otherwise("missing")
    return was.select("key", "member", "seq", outcome.alias("outcome"))


def fold_scores(log: DataFrame) -> DataFrame:
    """(key, member, score) after all adds and removes; log as for z_outcomes."""
    last = log.groupBy("key", "member").agg(F.max_by(F.struct("op", "score"), "seq").alias("x"))
    return last.filter(F.col("x.op") == "add").select("key", "member", clean_score(F.col("x.score")).alias("score"))


def clean_score(c: Column) -> Column:
    """NaN is refused; minus zero is zero."""
    return F.when(F.isnan(c), F.raise_error(F.lit("score is not a number")).cast("double")).otherwise(c + F.lit(0.0))


# -- lists


def pushed_list(log: DataFrame) -> DataFrame:
    """(key, pos, value) of logs that push only: the closed form of positions, without a fold. log: key, seq, side, value."""
    left = Window.partitionBy("key", "side").orderBy("seq")
    n = F.row_number().over(left)
    return log.select("key", F.when(F.col("side") == "left", -n).otherwise(n - 1).cast("bigint").alias("pos"), "value")


def push_lengths(log: DataFrame) -> DataFrame:
    """(key, seq, length): what each push of a log that pushes only returns. log: key, seq."""
    return log.select("key", "seq", F.row_number().over(Window.partitionBy("key").orderBy("seq")).cast("bigint").alias("length"))


def fold_list(log: DataFrame) -> DataFrame:
    """(key, pos, value, popped) of logs that push and pop, in order: log: key, seq, op (lpush rpush lpop rpop), value.

    Rows with popped are the values that the pops returned, at pos = seq. A key's log is one batch of operations.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        from collections import deque

        held, first, out = deque(), 0, []
        key = pdf["key"].iloc[0]
        for r in pdf.sort_values("seq").itertuples():
            if r.op == "rpush":
                held.append(r.value)
            elif r.op == "lpush":
                held.appendleft(r.value)
                first -= 1
            elif r.op == "rpop":
                out.append((key, r.seq, held.pop() if held else None, True))
            elif r.op == "lpop":
                out.append((key, r.seq, held.popleft() if held else None, True))
                first += out[-1][2] is not None
        out += [(key, first + i, v, False) for i, v in enumerate(held)]
        return pd.DataFrame(out, columns=["key", "pos", "value", "popped"])

    return log.groupBy("key").applyInPandas(fold, "key string, pos long, value string, popped boolean")


def l_range(state: DataFrame, start: int, stop: int) -> DataFrame:
    """(key, index, value) of every key's list between signed, inclusive, clamped bounds. state: key, pos, value."""
    w = Window.partitionBy("key")
    df = state.withColumn("index", (F.row_number().over(w.orderBy("pos")) - 1).cast("bigint")).withColumn("n", F.count(F.lit(1)).over(w))
    low = F.greatest(F.lit(0), F.col("n") + start) if start < 0 else F.lit(start)
    high = F.col("n") + stop if stop < 0 else F.lit(stop)
    return df.filter(F.col("index").between(low, high)).select("key", "index", "value")


# -- streams: rows (key, entry_id, fields)


def appended(log: DataFrame) -> DataFrame:
    """Entry ids from 1 in arrival order: log: key, seq, fields (a map of at least one field)."""
    w = Window.partitionBy("key").orderBy("seq")
    return log.select("key", F.row_number().over(w).cast("bigint").alias("entry_id"), "fields")


def live_entries(log: DataFrame, at: int) -> DataFrame:
    """(key, entry_id, fields) of the streams that exist at a time, from append, create, expire and delete operations.

    log: key, seq, op, fields, expiry. A stream that was deleted and made again counts its entries from 1.
    """
    cuts = log.filter(F.col("op").isin("create", "delete")).groupBy("key").agg(F.max("seq").alias("cut"))
    new = log.filter(F.col("op") == "append").join(cuts, "key", "left").filter(F.col("cut").isNull() | (F.col("seq") > F.col("cut")))
    return appended(new.join(headers(log, at).select("key"), "key", "left_semi"))


def x_range(state: DataFrame, key, low: int, high: int, limit: int) -> DataFrame:
    return state.filter((F.col("key") == key) & F.col("entry_id").between(low, high)).orderBy("entry_id").limit(limit)


def check_entries(entries: DataFrame) -> None:
    """Explicit entries (key, seq, entry_id, fields): ids rise in arrival order and every entry has 1 to 4096 fields."""
    w = Window.partitionBy("key").orderBy("seq")
    bad = (F.col("entry_id") <= F.coalesce(F.lag("entry_id").over(w), F.lit(0))) | ~F.size("fields").between(1, BATCH)
    if not entries.withColumn("bad", bad).filter("bad").isEmpty():
        raise EngineError("STR002", "entry ids must rise and fields be present")


# -- expiry


def expire_due(header: DataFrame, at: int, most: int) -> tuple[DataFrame, DataFrame, bool]:
    """(what is removed, what stays, whether more is due): the first `most` by (expiry, key)."""
    if not 1 <= most <= EXPIRE_KEYS:
        raise EngineError("LIM009", "one to 4096 keys")
    due = header.filter(F.col("expiry") <= at).orderBy("expiry", "key")
    gone = due.limit(most)
    return gone, header.join(gone.select("key"), "key", "left_anti"), due.limit(most + 1).count() > most


def sweep(header: DataFrame, at: int, most: int = EXPIRE_KEYS) -> tuple[DataFrame, DataFrame]:
    """(what is removed, with the round that removes it; what stays) when expire_due runs until nothing is due.

    Maintenance only: reads decide by the time they are given, not by whether a sweep has run. The rounds are those of
    one order by (expiry, key): due keys are counted for each time of expiry, the counts, of a bounded number of times,
    are summed in one task, and keys are numbered within their time.
    """
    if not 1 <= most <= EXPIRE_KEYS:
        raise EngineError("LIM009", "one to 4096 keys")
    due = header.filter(F.col("expiry") <= at)
    late = due.groupBy("expiry").agg(F.count(F.lit(1)).alias("n"))
    if late.limit(SET_VISITS + 1).count() > SET_VISITS:
        raise EngineError("LIM010", f"more than {SET_VISITS} times of expiry are due")
    before = late.withColumn("before", F.sum("n").over(Window.orderBy("expiry")) - F.col("n")).select("expiry", "before")
    place = F.row_number().over(Window.partitionBy("expiry").orderBy("key")) - 1 + F.col("before")
    gone = due.join(before, "expiry").withColumn("round", F.floor(place / most).cast("bigint")).drop("before")
    return gone, header.filter(visible("expiry", at))
