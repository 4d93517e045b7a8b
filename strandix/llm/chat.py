"""Chat formatting by columnar byte assembly.

Each turn becomes five segments: OPEN, role, MID, text, CLOSE. For a batch of turns the segments' lengths give
cumulative offsets, the offsets give scatter indices, and headers and contents are copied into one preallocated
buffer, which is the data buffer of the Arrow string column; segments over `LARGE` bytes are copied as slices.
Byte spans of the assistant texts form the loss mask.

Control strings inside roles and texts are escaped reversibly: an occurrence, with any number of backslashes after
its first character, gets one more there; reading back takes one away. Other text is unchanged.

A conversation comes in turn order, ties by role and text. It is one row, unless it holds more than `PART` bytes:
then it is cut between turns into parts, in order, so that no task holds more than two parts and a batch. A
conversation's digest depends on the order of its turns, so all of them pass through one task, part by part.
Defined results: null text and null role are empty; null conv_id is a conversation of its own; null turn sorts
first; repeated rows are repeated turns; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.llm.common import table

OPEN, MID, CLOSE = "<|turn|>", "<|text|>", "<|end|>\n"
#: Strings that no role or text may hold as they are: ours, and those of public chat templates.
CONTROLS = ("<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
LARGE, PART = 1 << 16, 1 << 26


def _rests() -> str:
    special = set("\\|[]()*+?.{}^$")
    return "|".join("".join("\\" + c if c in special else c for c in s[1:]) for s in CONTROLS)


_ESCAPE = rf"([<\[])(\\*)({_rests()})"
_UNESCAPE = rf"([<\[])\\(\\*)({_rests()})"


def escape(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(text, _ESCAPE, r"\1\\\2\3")


def unescape(text: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(text, _UNESCAPE, r"\1\2\3")


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(data, starts, lengths) of a string column without nulls."""
    column = column.cast(pa.large_string())
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, off[:-1], np.diff(off)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buffer, offsets of the turns and the end, byte spans (start, end) of the texts) for columns without nulls."""
    n = len(roles)
    fixed = [np.frombuffer(s.encode(), np.uint8) for s in (OPEN, MID, CLOSE)]
    role, text = _bytes_of(escape(roles)), _bytes_of(escape(texts))
    source = np.concatenate([*fixed, role[0], text[0]])
    base = np.cumsum([0] + [len(x) for x in (*fixed, role[0])])
    length = np.empty((n, 5), np.int64)
    start = np.empty((n, 5), np.int64)
    for k, (s, size) in enumerate(((base[0], len(fixed[0])), (base[3] + role[1], role[2]), (base[1], len(fixed[1])), (base[4] + text[1], text[2]), (base[2], len(fixed[2])))):
        start[:, k], length[:, k] = s, size
    ends = np.cumsum(length.ravel())
    dest = (ends - length.ravel()).reshape(n, 5)
    out = np.empty(ends[-1] if n else 0, np.uint8)
    small = length.ravel() <= LARGE
    size, s, d = length.ravel()[small], start.ravel()[small], dest.ravel()[small]
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(d, size) + within] = source[np.repeat(s, size) + within]
    for i in np.flatnonzero(~small):
        out[dest.ravel()[i] : ends[i]] = source[start.ravel()[i] : start.ravel()[i] + length.ravel()[i]]
    return out, np.append(dest[:, 0], len(out)), np.stack([dest[:, 3], dest[:, 3] + length[:, 3]], 1)


_SCHEMA = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("mask", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])


def _format_rows(rows: pa.Table, first_part: int) -> Iterator[pa.RecordBatch]:
    """One row for each conversation in rows; the first has part number first_part."""
    ids = rows.column("conv_id").combine_chunks()
    n = len(ids)
    if not n:
        return
    out, at, spans = assemble(rows.column("role").combine_chunks(), rows.column("text").combine_chunks())
    key = pc.fill_null(ids, 0).to_numpy()
    none = ids.is_null().to_numpy(zero_copy_only=False)
    cut = np.concatenate(([0], np.flatnonzero((key[1:] != key[:-1]) | (none[1:] != none[:-1])) + 1, [n]))
    offsets = pa.array(at[cut].astype(np.int32)).buffers()[1]
    text = pa.Array.from_buffers(pa.string(), len(cut) - 1, [None, offsets, pa.py_buffer(out)])
    loss = pc.equal(rows.column("role").combine_chunks(), "assistant").to_numpy(zero_copy_only=False)
    begin = np.repeat(at[cut[:-1]], np.diff(cut))
    held = pa.StructArray.from_arrays([pa.array((spans[loss, k] - begin[loss]).astype(np.int32)) for k in (0, 1)], ["start", "end"])
    mask = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(np.add.reduceat(loss, cut[:-1])))).astype(np.int32)), held)
    part = np.zeros(len(cut) - 1, np.int32)
    part[0] = first_part
    yield pa.RecordBatch.from_arrays([ids.take(pa.array(cut[:-1])), pa.array(part), pa.array(np.diff(cut).astype(np.int64)), text, mask], schema=_SCHEMA)


def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches cut between rows into ones of about PART bytes of text, so that offsets stay far below 31 bits."""
    for b in batches:
        size = np.cumsum(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + PART, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, formatted, mask): the formatted conversations with the byte spans of their loss."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, part, given = None, 0, None  # given: the conversation whose part was written last
        for b in bounded(batches):
            rows = pa.Table.from_batches([b]).select(["conv_id", "role", "text"])
            if held is None and rows.column("conv_id")[0].as_py() != given:
                part = 0
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            last = rows.column("conv_id")[-1].as_py()
            ids = rows.column("conv_id").combine_chunks()
            other = pc.fill_null(pc.not_equal(ids, last), True) if last is not None else ids.is_valid()
            ends = np.flatnonzero(other.to_numpy(zero_copy_only=False))
            k = int(ends[-1]) + 1 if len(ends) else 0
            if k:
                yield from _format_rows(rows.slice(0, k), part)
                part = 0
            held = rows.slice(k)
            if held.nbytes > PART:
                yield from _format_rows(held, part)
                held, part, given = None, part + 1, last
        if held is not None:
            yield from _format_rows(held, part)

    rows = turns.select(F.col("conv_id").cast("bigint"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return dealt.mapInArrow(emit, "conv_id long, part int, n_turns long, formatted string, mask array<struct<start:int,end:int>>")


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns = [t.removesuffix(CLOSE).split(MID, 1) for t in formatted.split(OPEN)[1:]]
    flat = unescape(pa.array([x for t in turns for x in t], pa.string())).to_pylist()
    return list(zip(flat[::2], flat[1::2]))


def masked_text(formatted: bytes, mask: list[dict]) -> list[str]:
    """The unescaped texts under the loss mask."""
    return unescape(pa.array([formatted[m["start"] : m["end"]].decode() for m in mask], pa.string())).to_pylist()


def digests(formatted: DataFrame) -> DataFrame:
    """What the parts of each conversation hold, read back from the formatted text. `formatted` keeps the parts of a conversation together."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]

        def row() -> list:
            return [at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]]

        for b in batches:
            out = []
            for r in b.to_pylist():
                if state is None or r["part"] == 0:
                    if state is not None:
                        out.append(row())
                    at, state = r["conv_id"], [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = r["formatted"]
                turns = read_back(text)
                state[0] += len(turns)
                state[1].update("".join(f"{role}\n{said}\n" for role, said in turns).encode("utf-8", "surrogatepass"))
                loss = "".join(masked_text(text.encode("utf-8", "surrogatepass"), r["mask"]))
                state[2] += len(loss)
                state[3].update(loss.encode("utf-8", "surrogatepass"))
                state[4] += len(text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.string() if k in (2, 4) else pa.int64()) for k in range(6)], names)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], pa.string() if k in (2, 4) else pa.int64()) for k, v in enumerate(row())], names)

    return formatted.mapInArrow(emit, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.lit("</s>[INST] ok [/INST]")
    extra = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said.alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").cast("bigint").alias("turn"), "role", "text")
    return digests(format_conversations(turns.unionByName(extra)))


SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '([<\[])(\\*)(CONTROLS)', '\1\\\2\3', 'g') AS out_text,
             regexp_replace(role, '([<\[])(\\*)(CONTROLS)', '\1\\\2\3', 'g') AS out_role FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(out_role) + length(out_text) + 24)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""".replace("CONTROLS", _rests().replace("'", "''"))
