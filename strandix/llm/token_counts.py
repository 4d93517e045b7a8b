"""Token counts by trie-shared dynamic programming over a unigram model.

The pieces are those of a public rank file; a piece of rank r scores -log(r + 2), as an integer of millionths so
that equal sums are equal. A pre-token's count is the number of pieces in its best segmentation: highest score,
then fewest pieces. The distinct pre-tokens of a batch go into a trie of their bytes. The best score and count at a
node depend on the bytes above it alone, so they are computed once for every shared prefix, from the node's
ancestors within the longest piece; the count at a terminal node is stored for its pre-token. The trie is walked, not kept: sixteen bytes for each byte of
the longest pre-token.

Texts are cut by the tokenizer's pattern. Counts of pre-tokens, and of what stands between spaces, stay in caches
of two generations of bounded size; what falls out is computed again. A trie lives for one batch of texts.

Defined results: null or empty text has no tokens; repeated rows each get a row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.llm.bpe import GENERATION, Generations, read_ranks, slices
from strandix.llm.common import table


def unigram_scores(ranks: dict[bytes, int]) -> dict[bytes, int]:
    return {b: -round(1e6 * math.log(r + 2)) for b, r in ranks.items()}


class Counter:
    """Counts of pre-tokens under fixed scores."""

    def __init__(self, scores: dict[bytes, int]):
        self.scores = scores
        self.tails = {b[k:] for b in scores for k in range(len(b))}  # every end of a piece: where a look back may go on

    def counts(self, words: list[bytes]) -> list[int]:
        """The number of pieces of each word.

        The trie of the words is walked depth first, which is their order as bytes: the values of the nodes above the
        present one are all that is held, and a word goes on from the node where it leaves the word before.
        """
        score, pieces = array("q", [0]), array("q", [0])  # by depth: of the best segmentation of the path so far
        out, scores, tails, before = [0] * len(words), self.scores, self.tails, b""
        for k in sorted(range(len(words)), key=words.__getitem__):
            w = words[k]
            shared = len(commonprefix((before, w)))
            del score[shared + 1 :], pieces[shared + 1 :]
            for i in range(shared, len(w)):
                top, less = -(1 << 62), 0
                for j in range(i, -1, -1):
                    seg = w[j : i + 1]
                    if seg not in tails:
                        break
                    if (s := scores.get(seg)) is not None:
                        s += score[j]
                        if s > top or (s == top and pieces[j] + 1 < less):
                            top, less = s, pieces[j] + 1
                score.append(top)
                pieces.append(less)
            out[k], before = pieces[-1], w
        return out


_BEFORE = re.compile(r"(?= \S)")
_INNER = re.compile(r" (?!\S)")


def cut_at_spaces(text: str) -> list[str]:
    """The text in pieces, cut before every space that a non-space follows: such a space always begins a pre-token."""
    if not text:
        return []
    if _INNER.search(text):
        return [x for x in _BEFORE.split(text) if x]
    first, *rest = text.split(" ")
    rest = [" " + x for x in rest]
    return [first, *rest] if first else rest


class TextCounter:
    """Counts of whole texts: (pre-tokens, tokens), with caches."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.counter = Counter(unigram_scores(read_ranks(path)))
        self.find = regex.compile(pattern).findall
        self.words, self.pieces = Generations(GENERATION), Generations(GENERATION)

    def count(self, texts: list[str]) -> list[tuple[int, int]]:
        cut = [cut_at_spaces(t) for t in texts]
        got, new = self.pieces.split(set().union(*cut))
        found = {x: self.find(x) for x in new}
        known, fresh = self.words.split({y for f in found.values() for y in f})
        fresh.sort()
        learned = dict(zip(fresh, self.counter.counts([y.encode("utf-8", "surrogatepass") for y in fresh])))
        self.words.add(learned)
        known.update(learned)
        pieces = {x: (len(f), sum([known[y] for y in f])) for x, f in found.items()}
        self.pieces.add(pieces)
        got.update(pieces)
        return [(sum([got[x][0] for x in c]), sum([got[x][1] for x in c])) for c in cut]


#: The counters of this worker process, with what earlier partitions counted.
_COUNTERS: dict[tuple[str, str], TextCounter] = {}


def count_tokens(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_pretokens, n_tokens) for every row of docs."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get((path, pattern)) or _COUNTERS.setdefault((path, pattern), TextCounter(path, pattern))
        for b in batches:
            out = [row for texts in slices(b.column(1)) for row in counter.count(texts)]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in out], pa.int64()) for k in (0, 1))], ["doc_id", "n_pretokens", "n_tokens"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(emit, "doc_id long, n_pretokens long, n_tokens long")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
