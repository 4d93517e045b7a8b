"""N-gram Jaccard join: size-banded tiles with hashed bitmap signatures, exact sorted-array intersection.

A document's set is its distinct shingles of `words` words, as 64-bit hashes. Two documents link when
100 * |A and B| >= `percent` * |A or B|. Documents with equal sets collapse to one set first. The query takes 3 words
and 90 percent by its contract, the pipeline's stage 5 words and 80 percent; t below is percent / 100.

1. Bands and tiles. Sizes are cut into bands; a set belongs to its own band and looks into the next one if a set there
   is near enough in size. Two sets that link within a band whose largest size is h differ in at most
   k = 2 h (1 - t) / (1 + t) shingles. The band cuts the hash range into m = 3 (k + 1) / 2 parts, so that they agree
   on m - k parts or more. A part's token is the hash of band, part and all shingles of the set in it. Each set keeps
   the first k + 1 of its tokens in one common order, and a linked pair shares one of those it kept (the first of the
   m - k they agree on is preceded by at most k others in either set). The order puts tokens that many sets share
   last and parts with many shingles first: documents that share words, lines or a passage, but no more, do not meet.
   The sets that share a token form its tile.
2. Neighbours. In a tile, sorted by size, each set is compared with its neighbour: in a group of near copies that
   finds nearly all of the group with a few comparisons a set, not with all its pairs. Hashed bitmaps bound the
   overlap from above, |A and B| <= |A| - bits of A not in B, and the pairs that pass are compared exactly. Linked
   sets form components.
3. Mixed tiles, of more than one component. Each set outside a tile's largest component is compared with its likeliest
   partner of another one; then all pairs of different components that pass the bitmap bound are. The sets outside
   meet the tile in blocks, dealt by tile and block, so that no task holds a tile.

No link is lost: a pair of step 3 that is left out is already in one component, or cannot link. The result is one
row per document with its component. Defined results: null or wordless text has the empty set and links with
nothing; fewer words than a shingle's form one shingle; repeated rows and equal sets share a component; null doc_id
counts as no document's representative and keeps a null component unless its set has another; an empty table gives
an empty result; other columns are ignored or carried along.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.llm.common import bounded_broadcast, discard, fresh, materialize, table
from strandix.llm.components import components

WORDS, PERCENT = 3, 90
#: Tokens in one count of frequent tokens, and how often one must occur there to be named frequent.
CHUNK, FREQUENT = 2_000_000, 4
#: Frequent tokens that are ranked by their counts; the others keep the common order. This changes no result.
RANKED = 1 << 20
CACHE = 400_000
#: Sets of one token that go to a task, and those of a block of a mixed tile: outside the largest component, and all.
DEAL, OUTSIDE, BLOCK = 2048, 256, 2048
#: Sets with more copies than this share of the rows have their names broadcast: there are fewer of them than this.
HOT_SETS, BROADCAST_ROWS = 10_000, 1_000_000
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class _Words(dict):
    """Hashes of words, computed once each while they stay in the cache."""

    def __missing__(self, w: bytes) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[w] = xxhash.xxh3_64_intdigest(w)
        return h


def shingle_set(text: str | None, cache: dict, seed: int = 0, words: int = WORDS) -> np.ndarray:
    """The sorted distinct shingle hashes of a text. bytes.lower and bytes.split act on ASCII only, as the word rule does."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if len(w) < words:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(w), seed + 7)] if w else [], np.uint64)
    h = np.fromiter(map(cache.__getitem__, w), np.uint64, len(w))
    n = len(w) - words + 1
    x = h[:n] * K1 + np.uint64(seed)
    x ^= x >> np.uint64(32)
    for k in range(1, words):
        x = (x + h[k : k + n]) * (K2 if k % 2 else K3)
        x ^= x >> np.uint64(29 if k % 2 else 32)
    x.sort()
    return x[np.concatenate(([True], x[1:] != x[:-1]))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * K2
    x = (x ^ (x >> np.uint64(29))) * K3
    return x ^ (x >> np.uint64(32))


class Bands:
    """Bands of set sizes a factor of 1.25 or 1/t wide, whichever is more, for the threshold of `percent`."""

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1, 2]

    def _reach(self, i: int) -> None:
        while len(self.starts) < i + 2 or self.starts[-1] <= 0:
            s = self.starts[-1]
            self.starts.append(max(s + 1, s * 5 // 4, s * 100 // self.percent))

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            self._reach(len(self.starts))
        return bisect_right(self.starts, n) - 1

    def start(self, i: int) -> int:
        self._reach(i)
        return self.starts[i]

    def differences(self, i: int) -> int:
        """The most shingles in which two linked sets of sizes up to the band's largest differ."""
        self._reach(i + 1)
        return 2 * (self.starts[i + 1] - 1) * (100 - self.percent) // (100 + self.percent)


def tile_tokens(s: np.ndarray, bands: Bands, toks: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, own) that a set keeps in its own band (own 1) and the next (own 0). toks, sorted, come last in the order of rank."""
    n, mixed = len(s), None
    own = bands.of(n) if n else 0
    out, flags = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for band in (own, own + 1) if n else ():
        if band != own and 100 * n < bands.percent * bands.start(band):
            break
        k = bands.differences(band)
        if not k:  # only equal sets could link, and those are one set
            continue
        if mixed is None:
            mixed = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_mixed(s))))
        m = -(-3 * (k + 1) // 2)
        size = np.bincount((((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64), minlength=m)
        end = np.cumsum(size)
        tok = _mixed(mixed[end] - mixed[end - size] + np.arange(1, m + 1, dtype=np.uint64) * K1 + np.uint64(band + 1) * K3)
        late = np.zeros(m, np.int64)
        if len(toks):
            at = np.searchsorted(toks, tok)
            at[at == len(toks)] = 0
            late = np.where(toks[at] == tok, rank[at] + 1, 0)
        keep = np.lexsort((tok, -size, late))[: k + 1]
        out.append(tok[keep])
        flags.append(np.full(len(keep), int(band == own), np.int64))
    return np.concatenate(out), np.concatenate(flags)


def _long(x) -> pa.Array:
    return pa.array(np.asarray(x, np.uint64).view(np.int64))


def bitmap(s: np.ndarray) -> np.ndarray:
    """Hashed bitmap of a set, bit h mod size for every shingle h; its size is a power of two, twice the set's at least."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    out = np.zeros(bits, np.uint8)
    out[(s & np.uint64(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.uint64)


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """The same set's bitmap at a smaller power of two."""
    return np.bitwise_or.reduce(bits.reshape(-1, words), 0) if len(bits) > words else bits


def overlap_bound(p: np.ndarray, q: np.ndarray, n_p: int, n_q: int) -> int:
    """No more than this many elements are in both sets: a bit of one that the other lacks is an element that it lacks."""
    words = min(len(p), len(q))
    p, q = folded(p, words), folded(q, words)
    return min(n_p - int(np.bitwise_count(p & ~q).sum()), n_q - int(np.bitwise_count(q & ~p).sum()))


def _set_id(s: np.ndarray) -> int:
    return xxhash.xxh3_128_intdigest(s.tobytes())


def signatures(docs: DataFrame, seed: int, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """kind 0: (doc_id, n, s1, s2), a set's size and 128-bit hash; kind 1: a frequent token s1 and its count n in a chunk of sets."""
    names = ["kind", "doc_id", "n", "s1", "s2"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bands, seen, held, size = _Words(), Bands(percent), set(), [], 0
        none = np.zeros(0, np.uint64)

        def frequent() -> pa.RecordBatch:
            tok, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= max(FREQUENT, len(held) // 1000)
            k = int(often.sum())
            return pa.RecordBatch.from_arrays([pa.array(np.ones(k, np.int32)), pa.nulls(k, pa.int64()), pa.array(count[often].astype(np.int64)), _long(tok[often]), pa.array(np.zeros(k, np.int64))], names)

        for b in batches:
            sizes, ids = [], []
            for t in b.column(1).to_pylist():
                s = shingle_set(t, cache, seed, words)
                i = _set_id(s)
                sizes.append(len(s))
                ids.append(i)
                if i not in seen:
                    if len(seen) < CACHE:
                        seen.add(i)
                    held.append(tile_tokens(s, bands, none, none)[0])
                    size += len(held[-1])
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(ids), np.int32)), b.column(0), pa.array(sizes, pa.int64()), _long([i & (2**64 - 1) for i in ids]), _long([i >> 64 for i in ids])], names)
            if size >= CHUNK:
                yield frequent()
                held, size = [], 0
        if held:
            yield frequent()

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(emit, "kind int, doc_id long, n long, s1 long, s2 long")


def _postings(docs: DataFrame, seed: int, words: int, percent: int, ranked) -> DataFrame:
    """(token, deal, sid, v) for every token that a text's set keeps, equal sets of one task once; v is 2 * size + own.

    A frequent token's sets are dealt to as many tasks as its count needs.
    """

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, bands, seen = _Words(), Bands(percent), set()
        toks, rank, ways = ranked.value
        for b in batches:
            tok, sid, v = [], [], []
            for t in b.column(0).to_pylist():
                s = shingle_set(t, cache, seed, words)
                i = _set_id(s) & (2**64 - 1)
                if i in seen or not len(s):
                    continue
                if len(seen) < CACHE:
                    seen.add(i)
                mine, own = tile_tokens(s, bands, toks, rank)
                tok.append(mine)
                sid.append(np.full(len(mine), i, np.uint64))
                v.append(2 * len(s) + own)
            if not tok:
                continue
            tok, sid = np.concatenate(tok), np.concatenate(sid)
            deal = np.zeros(len(tok), np.int32)
            if len(toks):
                at = np.searchsorted(toks, tok)
                at[at == len(toks)] = 0
                many = (toks[at] == tok) & (ways[at] > 1)
                deal[many] = 1 + (_mixed(sid[many] ^ tok[many]) % ways[at[many]].astype(np.uint64)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([_long(tok), pa.array(deal), _long(sid), pa.array(np.concatenate(v).astype(np.int32))], ["token", "deal", "sid", "v"])

    return docs.select("text").mapInArrow(emit, "token long, deal int, sid long, v int")


def _and_end(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _tiles(postings: DataFrame, percent: int) -> DataFrame:
    """Tiles of two sets or more. kind 0: a pair (a, b) of neighbours in size; kind 1: a posting (token a, sid b, v) of a tile of three or more.

    Tiles are read as a stream; of one that has begun no more than two postings are held.
    """
    names = ["kind", "a", "b", "v"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, large = np.zeros((4, 0), np.int64), False  # the unfinished tile; of a large one its last posting, given out
        for b in _and_end(batches):
            rows = held if b is None else np.concatenate([held, np.stack([b.column(i).to_numpy().astype(np.int64) for i in range(4)])], 1)
            if not rows.shape[1]:
                continue
            rows = rows[:, np.concatenate(([True], (rows[:, 1:] != rows[:, :-1]).any(0)))]
            tok, deal, sid, v = rows
            start = np.concatenate(([0], np.flatnonzero((np.diff(tok) != 0) | (np.diff(deal) != 0)) + 1))
            size = np.diff(np.append(start, len(tok)))
            big = (size > 2) | (deal[start] > 0)
            big[0] |= large
            done = np.ones(len(size), bool)
            if b is not None:
                done[-1] = big[-1]
            tile, n = np.repeat(np.arange(len(size)), size), v >> 1
            ok = (tile[1:] == tile[:-1]) & done[tile[1:]] & (100 * n[:-1] >= percent * n[1:]) & (((v[:-1] | v[1:]) & 1) == 1) & (sid[1:] != sid[:-1])
            at = np.flatnonzero(ok)
            if len(at):
                p = np.stack([np.minimum(sid[at], sid[at + 1]), np.maximum(sid[at], sid[at + 1])])
                p = np.unique(p, axis=1)
                k = p.shape[1]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(k, np.int32)), pa.array(p[0]), pa.array(p[1]), pa.array(np.zeros(k, np.int32))], names)
            give = np.flatnonzero((big & done)[tile])
            give = give[1:] if large and len(give) and give[0] == 0 else give
            if len(give):
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(give), np.int32)), pa.array(tok[give]), pa.array(sid[give]), pa.array(v[give].astype(np.int32))], names)
            large = bool(big[-1])
            held = rows[:, -1:] if large else rows[:, start[-1] :]

    dealt = postings.repartition("token", "deal").sortWithinPartitions("token", "deal", "v", "sid")
    return dealt.mapInArrow(emit, "kind int, a long, b long, v int")


def _of_sets(docs: DataFrame, ids: DataFrame, seed: int, words: int, make, column: str) -> DataFrame:
    """(sid, n, column) with make(set) in bytes, of the documents named in ids (doc_id); repeated rows give repeated rows."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for b in batches:
            sets = [shingle_set(t, cache, seed, words) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([_long([_set_id(s) & (2**64 - 1) for s in sets]), pa.array([len(s) for s in sets], pa.int64()), pa.array([make(s).tobytes() for s in sets], pa.binary())], ["sid", "n", column])

    near = docs.withColumn("doc_id", F.col("doc_id").cast("bigint")).join(bounded_broadcast(ids, BROADCAST_ROWS), "doc_id", "left_semi")
    return near.select("text").mapInArrow(emit, f"sid long, n long, {column} binary")


def _may_link(pairs: DataFrame, maps: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose bitmaps leave a link possible."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = b.column(2).to_numpy(), b.column(4).to_numpy()
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(3), b.column(5))):
                both = overlap_bound(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), n[i], m[i])
                keep[i] = 100 * both >= percent * (n[i] + m[i] - both)
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(keep)).columns[:2], ["a", "b"])

    full = pairs.join(maps.select(F.col("sid").alias("a"), "n", F.col("bits").alias("x")), "a").join(maps.select(F.col("sid").alias("b"), F.col("n").alias("m"), F.col("bits").alias("y")), "b")
    return full.select("a", "b", "n", "x", "m", "y").mapInArrow(emit, "a long, b long")


def _verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, seed: int, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, by exact intersection of sorted arrays, as a written table. `pairs` is one too."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = np.zeros(b.num_rows, bool)
            for i, (x, y) in enumerate(zip(b.column(2), b.column(3))):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                if len(p) > len(q):
                    p, q = q, p
                at = np.searchsorted(q, p)
                at[at == len(q)] = 0
                both = int((q[at] == p).sum())
                keep[i] = 100 * both >= percent * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays(b.filter(pa.array(keep)).columns[:2], ["a", "b"])

    used = pairs.select(F.col("a").alias("s1")).union(pairs.select("b")).distinct()
    arrays = materialize(_of_sets(docs, used.join(sets, "s1").select(F.col("rep").alias("doc_id")), seed, words, lambda s: s, "toks"), "arrays")
    full = pairs.join(arrays.select(F.col("sid").alias("a"), F.col("toks").alias("x")), "a").join(arrays.select(F.col("sid").alias("b"), F.col("toks").alias("y")), "b")
    out = materialize(full.select("a", "b", "x", "y").mapInArrow(emit, "a long, b long"), "links")
    discard(arrays)
    return out


def _block_pairs(rows: DataFrame, percent: int, best: bool) -> DataFrame:
    """Pairs of different components in a block whose bitmaps leave a link possible.

    rows: token, rb, sb (the block), side (1: outside the tile's largest component), sid, v, comp, bits. Every set of
    side 1 meets every set of side 0. best: only its likeliest partner, at most one pair a set and block.
    """

    def pairs(side, sid, v, comp, bits) -> Iterator[pa.RecordBatch]:
        words = min(map(len, bits)) // 8
        maps = np.stack([folded(np.frombuffer(x, np.uint64), words) for x in bits])
        n, rest = v >> 1, np.flatnonzero(side == 0)
        for i in np.flatnonzero(side == 1):
            ok = (comp[rest] != comp[i]) & (((v[rest] | v[i]) & 1) == 1) & (100 * np.minimum(n[rest], n[i]) >= percent * np.maximum(n[rest], n[i]))
            j = rest[ok]
            if not len(j):
                continue
            miss_i = np.bitwise_count(maps[i] & ~maps[j]).sum(1, dtype=np.int64)
            miss_j = np.bitwise_count(maps[j] & ~maps[i]).sum(1, dtype=np.int64)
            both = np.minimum(n[i] - miss_i, n[j] - miss_j)
            good = 100 * both >= percent * (n[i] + n[j] - both)
            j, both = j[good], both[good]
            if best and len(j):
                j = j[[np.argmax(both / (n[i] + n[j] - both))]]
            if len(j):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(sid[i], sid[j])), pa.array(np.maximum(sid[i], sid[j]))], ["a", "b"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def close() -> Iterator[pa.RecordBatch]:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from pairs(*(t.column(k).to_numpy() for k in ("side", "sid", "v", "comp")), t.column("bits").to_pylist())

        last = None
        for b in batches:
            key = np.stack([b.column(i).to_numpy() for i in range(3)])
            cut = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1), b.num_rows]
            for lo, hi in zip(cut, cut[1:]):
                if hi == lo:
                    continue
                if held and last != tuple(key[:, lo]):
                    yield from close()
                    held = []
                last = tuple(key[:, lo])
                held.append(b.slice(lo, hi - lo))
        if held:
            yield from close()

    dealt = rows.select("token", "rb", "sb", "side", "sid", F.col("v").cast("bigint").alias("v"), "comp", "bits").repartition("token", "rb", "sb").sortWithinPartitions("token", "rb", "sb")
    return dealt.mapInArrow(blocks, "a long, b long").distinct()


def _mixed_pairs(large: DataFrame, comps: DataFrame, maps: DataFrame, percent: int, best: bool) -> DataFrame:
    """Candidate pairs (a, b), a written table, of the tiles of more than one component."""
    named = large.join(comps.select(F.col("node").alias("sid"), "comp"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    per = named.groupBy("token", "comp").agg(F.count(F.lit(1)).alias("c"), F.max(F.col("v") % 2).alias("own"))
    tiles = per.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.sum("c").alias("sets"), F.max(F.struct("c", "comp"))["comp"].alias("top"), F.max("c").alias("most"), F.max("own").alias("own")).filter("comps > 1 AND own = 1")
    tiles = materialize(tiles, "mixed")
    rows = named.join(bounded_broadcast(tiles, BROADCAST_ROWS), "token").withColumn("outside", F.col("comp") != F.col("top"))
    if best:  # each set is looked at in its smallest tile
        outside = rows.filter("outside").groupBy("sid").agg(F.min(F.struct("sets", "token"))["token"].alias("token"))
        meet = materialize(outside, "outside")
        rows = rows.join(meet.select("token").distinct(), "token", "left_semi").join(meet.withColumn("mine", F.lit(True)), ["token", "sid"], "left").withColumn("outside", F.coalesce("mine", F.lit(False)))
    h = F.xxhash64("sid")
    r_blocks, s_blocks = F.ceil((F.col("sets") - F.col("most")) / OUTSIDE).cast("int"), F.ceil(F.col("sets") / BLOCK).cast("int")
    own_r, own_s = F.pmod(h, r_blocks).cast("int"), F.pmod(h, s_blocks).cast("int")
    keep = ["token", "sid", "v", "comp"]
    rows = rows.select(*keep, "outside", r_blocks.alias("r"), s_blocks.alias("s"), own_r.alias("own_r"), own_s.alias("own_s"))
    meeting = rows.select(*keep, F.explode(F.sequence(F.lit(0), F.col("r") - 1)).alias("rb"), F.col("own_s").alias("sb"), F.lit(0).alias("side"))
    asking = rows.filter("outside").select(*keep, F.col("own_r").alias("rb"), F.explode(F.sequence(F.lit(0), F.col("s") - 1)).alias("sb"), F.lit(1).alias("side"))
    return materialize(_block_pairs(meeting.unionByName(asking).join(maps.select("sid", "bits"), "sid"), percent, best), "pairs")


def _signed_sets(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, int]:
    """The signatures under the first seed whose 64-bit set names are all different for different sets."""
    seed = 0
    while True:
        sig = materialize(signatures(docs, seed, words, percent), "signatures")
        clash = sig.filter("kind = 0").groupBy("s1").agg(F.min("s2").alias("lo"), F.max("s2").alias("hi")).filter("lo != hi")
        if clash.isEmpty():
            return sig, seed
        discard(sig)
        seed += 1


def cluster(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs; its attribute `scratch` lists the written tables it reads."""
    docs = docs.select("doc_id", "text")
    sc = docs.sparkSession.sparkContext
    sig, seed = _signed_sets(docs, words, percent)
    often = sig.filter("kind = 1").groupBy("s1").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "s1").limit(RANKED).toArrow()
    toks = often.column("s1").to_numpy().view(np.uint64)
    order = np.argsort(toks)
    ways = -(-often.column("n").to_numpy() // DEAL)
    ranked = sc.broadcast((toks[order], (len(toks) - np.arange(len(toks), dtype=np.int64))[order], ways.astype(np.int32)[order]))

    sets = materialize(sig.filter("kind = 0 AND n > 0").groupBy("s1").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies")), "sets")
    tiles = materialize(_tiles(_postings(docs, seed, words, percent, ranked), percent), "tiles")
    first = tiles.filter("kind = 0").select("a", "b").distinct()
    large = tiles.filter("kind = 1").select(F.col("a").alias("token"), F.col("b").alias("sid"), "v")
    used = tiles.select(F.col("b").alias("s1")).union(tiles.filter("kind = 0").select("a")).distinct()
    maps = materialize(_of_sets(docs, used.join(sets, "s1").select(F.col("rep").alias("doc_id")), seed, words, bitmap, "bits").dropDuplicates(["sid"]), "bitmaps")

    near = materialize(_may_link(first, maps, percent), "pairs")
    links = [_verified(near, docs, sets, seed, words, percent)]
    comps = materialize(components(links[0]), "comps")
    for best in (True, False):  # first the likeliest partners: few pairs are left for the rest
        more = _mixed_pairs(large, comps, maps, percent, best)
        if more.isEmpty():
            continue
        links.append(_verified(more, docs, sets, seed, words, percent))
        every = links[0]
        for x in links[1:]:
            every = every.unionByName(x)
        discard(comps)
        comps = materialize(components(every), "comps")

    # From set names to the least doc_id of the component; a set without links is its own component.
    home = sets.join(comps.select(F.col("node").alias("s1"), "comp"), "s1", "left").withColumn("comp", F.coalesce("comp", "s1"))
    least = home.groupBy("comp").agg(F.min("rep").alias("component_id"))
    names = materialize(home.join(least, "comp").select("s1", "component_id", "copies"), "names")
    for t in (tiles, maps, near, comps, sets, *links):
        discard(t)
    # Copies of one set may be a third of all rows: sets with more than a HOT_SETS-th of them are fewer than HOT_SETS.
    every = sig.filter("kind = 0").select("doc_id", "n", "s1")
    rows = names.agg(F.sum("copies")).first()[0] or 0
    hot = names.filter(F.col("copies") > rows / HOT_SETS).select("s1", F.col("component_id").alias("hot_id"))
    every = every.join(F.broadcast(hot), "s1", "left")
    rest = every.filter("hot_id IS NULL").drop("hot_id").join(names.filter(F.col("copies") <= rows / HOT_SETS).select("s1", "component_id"), "s1", "left")
    out = rest.select("doc_id", "n", "component_id").unionByName(every.filter("hot_id IS NOT NULL").select("doc_id", "n", F.col("hot_id").alias("component_id")))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    out.scratch = [sig, names]
    return out


def one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The documents that are the least of their component, with all columns; repeated rows of one doc_id stay together."""
    known = cluster(docs, words, percent)
    (gone_id,) = fresh(docs, "gone")
    gone = known.filter("component_id IS NOT NULL AND NOT (doc_id <=> component_id)").select(F.col("doc_id").alias(gone_id)).distinct()
    gone = materialize(gone, "near-copies")
    for t in known.scratch:
        discard(t)
    return docs.join(gone, F.col("doc_id").cast("bigint").eqNullSafe(F.col(gone_id)), "left_anti")


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p:p + 2], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * k >= 90 * (p.n + q.n - k)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.b) AS component_id
FROM documents d JOIN r ON r.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""
