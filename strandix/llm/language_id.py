"""Language identification by a linear-chain conditional random field over the words of code-switched text.

A word's features are the n-grams of one to five characters of the word between two boundary marks (those with a
mark are its affixes), hashed into a table of weights, and the word itself if it is in the lexicon of frequent
training words. Transitions between languages are learned with the feature weights, from sequences that splice
spans of documents of different languages; forward-backward gives each word's marginals. A text's words are one chain,
however many; it is laid out in blocks of `CHAIN` words, and messages pass from block to block. A text's language is the one with the
largest share of its words' marginals, and that share is its score.

The model is fitted on a sample of labelled documents that is bounded by `SAMPLE_DOCS` documents a language and
`SAMPLE_CHARS` characters a document, chosen by a hash of text and doc_id; the driver's work grows with the number of
languages, all of which are learned, not with the input's size. Predictions see nothing but the text.

Defined results: a text that is null or has no letter is `und` with score 0; repeated rows each get a row; rows with
null lang are labelled but not learned from; with nothing to learn from every text is `und`; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.llm.common import table

SAMPLE_DOCS, SAMPLE_CHARS = 400, 2_000
CHAIN, TABLE, LEXICON = 64, 1 << 17, 1_500
NGRAMS, CACHE, CHARS = 5, 200_000, 2_000_000
WORD = r"\p{L}[\p{L}\p{M}]*"


def _letters():
    import regex

    return regex.compile(WORD).findall


class Features:
    """Rows of feature indices for words: hashed n-grams, then lexicon entries; one flat array and each word's first place."""

    def __init__(self, lexicon: list[str]):
        self.lexicon = {w: TABLE + i for i, w in enumerate(lexicon)}
        self.size = TABLE + len(lexicon)

    def rows(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(feature indices, word of each) for the words."""
        joined = "".join(["\x02" + w + "\x03" for w in words])
        c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        word = np.cumsum(c == 2) - 1
        h = np.zeros(len(c), np.uint64)
        out, owner = [], []
        for n in range(1, NGRAMS + 1):
            h = (h[: len(c) - n + 1] if n > 1 else h) * np.uint64(0x9E3779B97F4A7C15) + c[n - 1 :]
            x = h ^ (h >> np.uint64(29))
            x = (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 17)
            ok = word[n - 1 :] == word[: len(c) - n + 1]
            out.append(x[ok].astype(np.int64))
            owner.append(word[: len(c) - n + 1][ok])
        named = [(self.lexicon[w], i) for i, w in enumerate(words) if w in self.lexicon]
        out.append(np.array([k for k, _ in named], np.int64))
        owner.append(np.array([i for _, i in named], np.int64))
        return np.concatenate(out), np.concatenate(owner)


def emissions(weights: np.ndarray, feats: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(owner, weights[feats, k], n) for k in range(weights.shape[1])], 1)


def forward_backward(e: np.ndarray, valid: np.ndarray, trans: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals [S, T, L] of chains with potentials e [S, T, L], and the scaled forward and backward messages.

    first: the messages that reach each chain's first place from what stands before it; last: those that reach its
    last place from what follows. Without them the chains stand alone.
    """
    s, t, k = e.shape
    alpha, beta = np.empty_like(e), np.ones_like(e)
    a = e[:, 0] if first is None else e[:, 0] * first
    alpha[:, 0] = a / a.sum(1, keepdims=True)
    for i in range(1, t):
        a = (alpha[:, i - 1] @ trans) * e[:, i]
        alpha[:, i] = a / a.sum(1, keepdims=True)
    if last is not None:
        beta[:, -1] = last
    for i in range(t - 2, -1, -1):
        b = (e[:, i + 1] * beta[:, i + 1]) @ trans.T
        b /= b.sum(1, keepdims=True)
        beta[:, i] = np.where(valid[:, i + 1, None], b, 1.0)
    m = alpha * beta
    m /= m.sum(2, keepdims=True)
    return m, alpha, beta


def block_messages(table: np.ndarray, ids: np.ndarray, valid: np.ndarray, trans: np.ndarray, chain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first, last) for forward_backward over blocks of potentials table[ids]; chain names each block's text.

    The blocks of a text follow one another; all but its last are full. A block's potentials and transitions multiply
    to one matrix, for many blocks at once; messages then step from block to block, for all texts at once.
    """
    n, t, k = *ids.shape, table.shape[1]
    first, last = np.ones((n, k)), np.ones((n, k))
    begin = np.flatnonzero(np.concatenate(([True], chain[1:] != chain[:-1])))
    count = np.diff(np.append(begin, n))
    within = np.arange(n) - np.repeat(begin, count)
    inner = np.flatnonzero(np.repeat(count > 1, count))
    if not len(inner):
        return first, last
    through = np.zeros((n, k, k))  # from a message into a block to the forward message at its end
    for lo in range(0, len(inner), 4096):
        at = inner[lo : lo + 4096]
        e, ok = table[ids[at]].astype(np.float64), valid[at]
        m = np.eye(k) * e[:, 0, None, :]
        for i in range(1, t):
            m = np.where(ok[:, i, None, None], (m @ trans) * e[:, i, None, :], m)
            m /= m.sum((1, 2), keepdims=True)
        through[at] = m
    order = inner[np.argsort(within[inner], kind="stable")]
    steps = np.split(order, np.flatnonzero(np.diff(within[order])) + 1)  # the first blocks of all texts, the second, ...
    for at in steps[1:]:
        f = np.einsum("si,sij->sj", first[at - 1], through[at - 1]) @ trans
        first[at] = f / f.sum(1, keepdims=True)
    for at in steps[:0:-1]:
        b = np.einsum("sij,sj->si", through[at], last[at]) @ trans.T
        last[at - 1] = b / b.sum(1, keepdims=True)
    return first, last


class Model:
    """A fitted model: languages, feature weights and log transitions. It is small and sent to the tasks whole."""

    def __init__(self, langs: list[str], lexicon: list[str], weights: np.ndarray, trans: np.ndarray):
        self.langs, self.lexicon, self.weights, self.trans = langs, lexicon, weights, trans

    @classmethod
    def fit(cls, samples: list[tuple[str, str]], rounds: int = 45, sequences: int = 2_500, rate: float = 0.25, decay: float = 1e-5) -> Model:
        """Maximum likelihood by Adam on spliced sequences; samples: (text, language)."""
        rng = np.random.default_rng(7)
        find = _letters()
        langs = sorted({lang for _, lang in samples})
        spoken: list[list[list[str]]] = [[w for t, la in samples if la == lang and len(w := find(t.lower()))] for lang in langs]
        langs = [la for la, s in zip(langs, spoken) if s]
        spoken = [s for s in spoken if s]
        if not langs:
            return cls([], [], np.zeros((TABLE, 0)), np.zeros((0, 0)))
        lexicon = sorted({w for s in spoken for w, _ in Counter(x for d in s for x in d).most_common(LEXICON)})
        features = Features(lexicon)
        names: dict[str, int] = {}
        ids, labels = np.zeros((sequences, CHAIN), np.int64), np.zeros((sequences, CHAIN), np.int64)
        for i in range(sequences):
            at = 0
            while at < CHAIN:
                lang = int(rng.integers(len(langs)))
                doc = spoken[lang][int(rng.integers(len(spoken[lang])))]
                span = int(rng.integers(4, CHAIN))
                lo = int(rng.integers(max(1, len(doc) - span)))
                for w in doc[lo : lo + min(span, CHAIN - at)]:
                    ids[i, at], labels[i, at] = names.setdefault(w, len(names)), lang
                    at += 1
        feats, owner = features.rows(list(names))
        k, n = len(langs), len(names)
        w, t = np.zeros((features.size, k)), np.zeros((k, k))
        valid = np.ones(ids.shape, bool)
        gold = np.bincount(ids.ravel() * k + labels.ravel(), minlength=n * k).reshape(n, k)
        gold_t = np.bincount((labels[:, :-1] * k + labels[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
        moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
        for r in range(1, rounds + 1):
            em = emissions(w, feats, owner, n)
            e = np.exp(em - em.max(1, keepdims=True))[ids] + 1e-30
            a = np.exp(t)
            m, alpha, beta = forward_backward(e, valid, a)
            want = np.stack([np.bincount(ids.ravel(), m[:, :, j].ravel(), n) for j in range(k)], 1)
            right = e[:, 1:] * beta[:, 1:]
            pair = alpha[:, :-1, :, None] * a * right[:, :, None, :]
            pair /= pair.sum((2, 3), keepdims=True)
            g = (gold - want) / ids.size * 100
            grads = [np.stack([np.bincount(feats, g[owner, j], features.size) for j in range(k)], 1) - decay * w, (gold_t - pair.sum((0, 1))) / ids.size * 100]
            for x, grad, m1, m2 in ((w, grads[0], *moments[:2]), (t, grads[1], *moments[2:])):
                m1 += 0.1 * (grad - m1)
                m2 += 0.01 * (grad * grad - m2)
                x += rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-6)
        return cls(langs, lexicon, w.astype(np.float32), t)


class Labeller:
    """Predictions of a model, with a bounded cache of words' potentials."""

    def __init__(self, model: Model):
        self.model, self.find, self.features = model, _letters(), Features(model.lexicon)
        self.trans = np.exp(model.trans).astype(np.float32)
        self._forget()

    def _forget(self) -> None:
        self.names: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)), np.float32)

    def _potentials(self, words: list[str]) -> np.ndarray:
        """Row numbers in self.table for the words."""
        if len(self.names) > CACHE:
            self._forget()
        new = sorted({w for w in words if w not in self.names})
        if new:
            em = emissions(self.model.weights, *self.features.rows(new), len(new))
            more = np.exp(em - em.max(1, keepdims=True)).astype(np.float32) + np.float32(1e-20)
            self.names.update(zip(new, range(len(self.table), len(self.table) + len(new))))
            self.table = np.concatenate([self.table, more])
        return np.fromiter(map(self.names.__getitem__, words), np.int64, len(words))

    def marginals(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """(words, their marginals [N, L], the text of each word), for texts taken together."""
        found = [self.find(t.lower()) for t in texts]
        words = [w for f in found for w in f]
        if not words:
            return [], np.zeros((0, len(self.model.langs)), np.float32), np.zeros(0, np.int64)
        size = np.array([len(f) for f in found])
        text = np.repeat(np.arange(len(texts)), size)
        within = np.arange(len(words)) - np.repeat(np.cumsum(size) - size, size)
        row, col = np.cumsum(within % CHAIN == 0) - 1, within % CHAIN
        ids = np.zeros((row[-1] + 1, CHAIN), np.int64)
        valid = np.zeros(ids.shape, bool)
        ids[row, col], valid[row, col] = self._potentials(words), True
        out = np.empty((len(words), len(self.model.langs)), np.float32)
        first, last = (x.astype(np.float32) for x in block_messages(self.table, ids, valid, self.trans, text[within % CHAIN == 0]))
        for lo in range(0, len(ids), 4096):
            m, _, _ = forward_backward(self.table[ids[lo : lo + 4096]], valid[lo : lo + 4096], self.trans, first[lo : lo + 4096], last[lo : lo + 4096])
            at = (row >= lo) & (row < lo + 4096)
            out[at] = m[row[at] - lo, col[at]]
        return words, out, text

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, score) of each text."""
        k = len(self.model.langs)
        if not k:
            return ["und"] * len(texts), np.zeros(len(texts))
        _, m, text = self.marginals([t or "" for t in texts])
        mass = np.stack([np.bincount(text, m[:, j], len(texts)) for j in range(k)], 1)
        total = mass.sum(1)
        best = mass.argmax(1)
        score = np.where(total > 0, mass.max(1) / np.maximum(total, 1e-9), 0.0)
        return [self.model.langs[b] if n > 0 else "und" for b, n in zip(best, total)], np.minimum(score, 1.0)


def train(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model from docs (doc_id, text, lang); the caller chooses which documents may be learned from."""
    docs = docs.filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = docs.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    if not counts:
        return Model.fit([])
    # Each document draws a number from its hash; a language's share of that range makes its sample.
    draw = F.pmod(F.xxhash64("doc_id", F.length("text")), F.lit(1 << 40))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1 << 40, (sample_docs << 40) // r["count"])))])
    near = docs.filter(draw < F.element_at(share, F.col("lang"))).select(F.substring("text", 1, sample_chars).alias("text"), "lang", draw.alias("draw"))
    rows = near.orderBy("draw", "lang", "text").limit(2 * sample_docs * len(counts)).collect()
    return Model.fit([(r["text"], r["lang"]) for r in rows])


def label_documents(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(held.value)
        for b in batches:
            texts, lo = b.column(1).to_pylist(), 0
            while lo < len(texts):
                hi, size = lo, 0
                while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") <= CHARS):
                    size += len(texts[hi] or "")
                    hi += 1
                lang, score = labeller.predict(texts[lo:hi])
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(lang, pa.string()), pa.array(np.round(score, 6))], ["doc_id", "lang_pred", "score"])
                lo = hi

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(emit, "doc_id long, lang_pred string, score double")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3
    model = train(docs.filter(F.coalesce(fold != 1, F.lit(False))))
    out = label_documents(docs, model)
    return out.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
