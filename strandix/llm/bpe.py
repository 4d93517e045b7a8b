"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per worker and its partitions.

Texts are cut into pre-tokens by the tokenizer's pattern. The distinct pre-tokens of a batch that are not known yet
are the words of a recursive query. A word's state is a string with one character for each of its tokens, at first
one for each byte. Each step lays the tokens out as rows of word and position, joins neighbours to the merge table,
finds each word's leftmost pair of least rank and contracts it, until no pair is left; the query keeps the present
state of a word only (USING KEY). Decoding joins the rows (text, position, token) of the whole encoded texts to the
vocabulary and aggregates their bytes in position order.

A step contracts all occurrences of its pair from the left, where that is what one at a time comes to. The merge
table says so for every pair: no token of the same bytes is made of another pair that could overlap it, and the new
token followed by the pair's first token has no lower rank. Other pairs are contracted one at a time, and so are all
pairs of a word in which a later step found a lower rank than an earlier one: it is encoded again. A step costs the
word's length, and there are no more steps than different pairs, so long words need no other way.

As in the public encoder of this rank-file format, a pre-token that is a token of its own is that token. The cache of
pre-tokens holds two generations of bounded size; what falls out is computed again.
DuckDB keeps its tables in memory, within a limit; what it spills goes to the task's own folder and ends with it.

Defined results: null text is the empty text, with no ids; repeated rows each get a row; an empty table gives an
empty result; other columns are ignored or carried along, one named as a result column with an underscore before it.
A vocabulary with a rank that no character can stand for (over a million), or with a token of more than 256 pairs, is refused.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.llm.common import fresh, table

#: Entries of a cache generation, words of one recursive query, characters of texts handled at once.
GENERATION, WORDS, CHARS = 150_000, 20_000, 2_000_000
#: Code points of surrogates, which no token's character may be.
SURROGATES, SURROGATES_END = 0xD800, 0xE000

#: The state of each word of `words` at its fixpoint. With {every} = false pairs are contracted one at a time. A pair's
#: key is its rank and its number among the pairs of that rank; the position stands between them, so that the least sum
#: is a word's leftmost pair of least rank. Neighbours of short states are taken by position, which costs the position's
#: distance from the start, those of others from the list of all characters: the rows are the same.
ENCODE = """
WITH RECURSIVE s(w, t, last, back) USING KEY (w) AS (
  SELECT w, t, -1, false FROM words
  UNION
  SELECT r.w, CASE WHEN {every} THEN replace(r.t, g.pair, g.merged) ELSE r.t[:(b.best >> 8) % 1073741824 - 1] || g.merged || r.t[(b.best >> 8) % 1073741824 + 2:] END,
         g.rank, r.back OR g.rank < r.last
  FROM s r JOIN (
    SELECT x.w, min(h.key + x.p * 256) AS best
    FROM (SELECT w, substring(t, p, 2) AS pair, p FROM (SELECT w, t, unnest(range(1, length(t))) AS p FROM s WHERE length(t) <= 64)
          UNION ALL
          SELECT w, unnest(string_split(t[:-2], '')) || unnest(string_split(t[2:], '')), unnest(range(1, length(t))) FROM s WHERE length(t) > 64) x
    JOIN merges h ON h.pair = x.pair GROUP BY x.w) b ON r.w = b.w
  JOIN merges g ON g.key = b.best - (b.best >> 8) % 1073741824 * 256)
SELECT w, t, back FROM s ORDER BY w
"""
#: The bytes of each text, one character for each byte: ordered aggregation over its rows (d, p, t).
DECODE = "SELECT d, array_to_string(list(v.bytes ORDER BY p), '') AS bytes FROM encoded JOIN vocabulary v USING (t) GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def sign(token: int) -> str:
    """The character that stands for a token in a word's state; 0 is left out, and so are surrogates."""
    c = token + 1
    return chr(c if c < SURROGATES else c + SURROGATES_END - SURROGATES)


def tokens(state: str) -> np.ndarray:
    """The token numbers of a state."""
    c = np.frombuffer(state.encode("utf-32-le"), np.uint32).astype(np.int32)
    return np.where(c < SURROGATES, c, c - (SURROGATES_END - SURROGATES)) - 1


def merge_table(ranks: dict[bytes, int]) -> pa.Table:
    """(key, pair, rank, merged, every): each two tokens whose bytes together are a token; every: all occurrences at once."""
    rows = []
    for b, i in ranks.items():
        cuts = [(left, right) for k in range(1, len(b)) if (left := b[:k]) in ranks and (right := b[k:]) in ranks]
        if len(cuts) > 256:
            raise ValueError("a token of this vocabulary is made of more than 256 pairs")
        for n, (left, right) in enumerate(cuts):
            alone = not any(x != left and (x == right or y == left) for x, y in cuts)
            rows.append((i * 2**38 + n, sign(ranks[left]) + sign(ranks[right]), i, sign(i), alone and ranks.get(b + left, i + 1) > i))
    kinds = (pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_())
    return pa.table([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["key", "pair", "rank", "merged", "every"])


class Generations:
    """Two generations of a dict: what was not used during a whole generation is forgotten."""

    def __init__(self, size: int):
        self.new, self.old, self.size = {}, {}, size

    def split(self, keys) -> tuple[dict, list]:
        """(what is known of the keys, the others)."""
        got, rest, new, old = {}, [], self.new, self.old
        for k in keys:
            v = new.get(k)
            if v is None:
                v = old.get(k)
                if v is None:
                    rest.append(k)
                    continue
                new[k] = v
            got[k] = v
        return got, rest

    def add(self, more: dict) -> None:
        if len(self.new) + len(more) > self.size:
            self.old, self.new = self.new, {}
        self.new.update(more)


class Codec:
    """Encoder and decoder of one worker. A text, a piece or a word encoded is a state: one character for each token."""

    def __init__(self, path: str, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(path)
        if max(self.ranks.values()) + SURROGATES_END - SURROGATES >= 0x10FFFF:
            raise ValueError("a rank of this vocabulary has no character to stand for it")
        self.find = regex.compile(pattern).findall
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "250MB"})
        self.con.register("merges_in", merge_table(self.ranks))
        self.con.execute("CREATE TABLE merges AS SELECT * FROM merges_in")
        self.con.register("vocabulary_in", pa.table({"t": pa.array(self.ranks.values(), pa.int32()), "bytes": pa.array([b.decode("latin-1") for b in self.ranks], pa.string())}))
        self.con.execute("CREATE TABLE vocabulary AS SELECT * FROM vocabulary_in")
        self.single = "".join(sign(self.ranks[bytes([c])]) for c in range(256))
        self.whole = {b: sign(i) for b, i in self.ranks.items()}
        self.decimal = {sign(i): str(i) for i in self.ranks.values()}
        self.words = Generations(GENERATION)

    def _contracted(self, states: list[str], every: str = "g.every") -> list[str]:
        """The fixpoints of byte states; words whose steps went back to a lower rank once more, one pair at a time."""
        self.con.register("words", pa.table({"w": pa.array(range(len(states)), pa.int32()), "t": pa.array(states, pa.string())}))
        got = self.con.sql(ENCODE.format(every=every)).to_arrow_table()
        out, back = got.column("t").to_pylist(), np.flatnonzero(got.column("back").to_numpy())
        if len(back) and every != "false":
            for i, t in zip(back, self._contracted([states[i] for i in back], "false")):
                out[i] = t
        return out

    def states_of(self, words: list[bytes]) -> list[str]:
        """Each word encoded: the vocabulary for whole tokens, the recursion for all others."""
        out = [self.whole.get(b) for b in words]
        todo = [i for i, x in enumerate(out) if x is None]
        if todo:
            for i, t in zip(todo, self._contracted([words[i].decode("latin-1").translate(self.single) for i in todo])):
                out[i] = t
        return out

    def learn(self, words: set[str]) -> dict[str, str]:
        """The given pre-tokens encoded, known ones from the cache."""
        got, new = self.words.split(words)
        more = {}
        for lo in range(0, len(new), WORDS):
            part = new[lo : lo + WORDS]
            more.update(zip(part, self.states_of([x.encode("utf-8", "surrogatepass") for x in part])))
        self.words.add(more)
        return got | more

    def encode(self, texts: list[str]) -> list[str]:
        """Each text encoded."""
        found = [self.find(t) for t in texts]
        words = self.learn(set().union(*found))
        return ["".join(map(words.__getitem__, f)) for f in found]

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of token numbers."""
        size = [len(x) for x in ids]
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        self.con.register("encoded", pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), size), "p": np.arange(len(flat), dtype=np.int32), "t": flat}))
        got = self.con.sql(DECODE).to_arrow_table()
        out = [b""] * len(ids)
        for d, x in zip(got.column("d").to_pylist(), got.column("bytes").to_pylist()):
            out[d] = x.encode("latin-1")
        return out


#: The codecs of this worker process: a partition that comes later finds the database and what the earlier ones learned.
_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def slices(column: pa.Array, chars: int = CHARS) -> Iterator[list[str]]:
    """The texts of a string column, null as empty, in lists of about `chars` bytes; only one list is in memory at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False))
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + chars, "right")))
        yield [t or "" for t in column.slice(lo, hi - lo).to_pylist()]
        lo = hi


def encode_documents(docs: DataFrame, path: str, pattern: str, carry: list[str], ids_out: bool = False) -> DataFrame:
    """The named columns of docs with n_tokens, ids_sha256, decoded_sha256, and with ids_out the ids as array<int>."""
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * ids_out
    kinds = [pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * ids_out
    (text,) = fresh(docs, "text_in")
    given = docs.select(F.col("text").alias(text), *[F.col(f"`{c}`") for c in carry])
    for c in [c for c in carry if c.lower() in names]:
        given = given.withColumnRenamed(c, "_" + c)
    plain = given.schema.fields[1:]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for b in batches:
            out = []
            for texts in slices(b.column(0)):
                states = own.encode(texts)
                ids = [tokens(x) for x in states]
                for x, i, back in zip(states, ids, own.decode(ids)):
                    said = " ".join(map(own.decimal.__getitem__, x))
                    out.append([len(x), hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(back).hexdigest()] + [i] * ids_out)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], [*b.schema.names[1:], *names])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in plain] + ["n_tokens long, ids_sha256 string, decoded_sha256 string"] + ["ids array<int>"] * ids_out)
    return given.mapInArrow(emit, schema)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, ["doc_id"])
