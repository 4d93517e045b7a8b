"""Main-text extraction by a tree-structured graphical model over the DOM.

A page is parsed into a tree of block elements; inline elements belong to the block around them. Each node is
content or not. Unary potentials come from its tag, the words of its class, id and role, and its text; pair
potentials join a node to its parent. Sum-product messages go from the leaves to the root and back, level by level
over all pages of a batch at once, and give each node's exact marginal. Weights are fitted by maximum likelihood on
labelled pages. The text of the nodes that are more likely content than not is the page's main text.

Blocks keep page order; character references are decoded; white space inside a block becomes one space; blocks are
joined by an empty line. Scripts, styles, comments, the head and the like are never text.

Defined results: null html is the empty page with empty text; unclosed or stray tags are tolerated as browsers do
for blocks and paragraphs; repeated rows each get a row; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandix.llm.common import table
from strandix.llm.html_labelled import MARK, labelled_pages

BLOCKS = frozenset("html body article aside main section nav header footer div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd blockquote pre table thead tbody tfoot tr td th caption figure figcaption form fieldset legend label button select option textarea address details summary dialog hr menu center".split())
VOID = frozenset("br hr img input meta link area base col embed source track wbr".split())
RAW = frozenset("script style noscript template svg math iframe object canvas title head textarea select".split())
_ENDS = {t: re.compile(rf"<(/?){t}(?=[\s/>])", re.I | re.A) for t in RAW}
#: Of the raw elements, those that may hold another of their name.
NESTED = frozenset("svg math object template canvas".split())
#: Of these, those whose contents are read like any other where the end tag is missing.
OPEN_ENDED = frozenset("head svg math object canvas select".split())
#: What a start tag closes if it is open, up to the given ancestors.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
ENDS_P = BLOCKS - {"html", "body", "li", "td", "th", "tr", "dt", "dd", "label", "button", "option", "caption", "legend", "thead", "tbody", "tfoot"}
#: Words of class, id and role that carry meaning for pages in general.
NAMES = tuple("header masthead top topbar topnav bar nav navbar navigation menu breadcrumb breadcrumbs links pagination toc notice cookie cookies consent alert gdpr paywall message popup modal banner ad ads advert adverts advertisement sponsor sponsored promo slot sidebar side widget related recommended trending read comment comments responses reply discussion disqus reader footer copyright bottom legal colophon contentinfo search login newsletter subscribe signup contact form share social tags byline tools content post article entry story main text body complementary".split())
#: Comments, declarations and tags. Possessive repeats keep the work in proportion to the page, however broken it is.
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/><]*+)((?:[^>\"'<]++|\"[^\"]*+\"|'[^']*+')*+(?=>)|[^>]*+)>", re.S)
_ATTR = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_TAGS = {t: i for i, t in enumerate(sorted(BLOCKS))}
_NAMES = {t: len(_TAGS) + i for i, t in enumerate(NAMES)}
_BASE = len(_TAGS) + len(_NAMES)
#: Features of the text: a bias, five lengths, three link shares, ends with a stop, holds a comma, has no text, copyright sign.
FEATURES = _BASE + 13


def _end_of(name: str, source: str, at: int) -> re.Match | None:
    """The end tag of a raw element that begins before at; elements of its name inside it are passed over whole."""
    depth, last = 1, None
    for m in _ENDS[name].finditer(source, at):
        if m[1]:
            last, depth = m, depth - 1
            if not depth:
                return m
        elif name in NESTED:
            depth += 1
    return last


class Dom:
    """The nodes of one page: parent, depth, features and text blocks (node, text)."""

    __slots__ = ("parent", "depth", "feats", "blocks")

    def __init__(self, source: str):
        self.parent, self.depth, self.feats, self.blocks = [-1], [0], [[_TAGS["html"]]], []
        tags, stack, text, chars, linked = ["html"], [0], [], [0], [0]
        in_link, at, size = 0, 0, len(source)
        endless = set()  # names that have no end tag any more
        last_tag = source.rfind(">") + 1  # no tag ends behind it

        def flush() -> None:
            if text:
                block = " ".join(_html.unescape("".join(text)).split())
                text.clear()
                if block:
                    self.blocks.append((stack[-1], block))
                    chars[stack[-1]] += len(block)

        def add(raw: str) -> None:
            if raw:
                text.append(raw)
                if in_link and not raw.isspace():
                    linked[stack[-1]] += len(raw)

        while at < size:
            m = _TOKEN.search(source, at, last_tag)
            if m is None:
                add(source[at:])
                break
            add(source[at : m.start()])
            at = m.end()
            if m[0].startswith("<!--") and not m[0].endswith("-->"):
                break
            name = m[2]
            if name is None:
                continue
            name = name.lower()
            if m[1]:
                if name == "a":
                    in_link = max(0, in_link - 1)
                elif name in BLOCKS:
                    flush()
                    for k in range(len(stack) - 1, 0, -1):
                        if tags[stack[k]] == name:
                            del stack[k:]
                            in_link = 0
                            break
                continue
            if name in RAW:
                if m[0].endswith("/>"):
                    continue
                close = None if name in endless else _end_of(name, source, at)
                if close is None:
                    endless.add(name)
                    if name in OPEN_ENDED:
                        continue
                end = size if close is None else close.start()
                stop = source.find(">", end)
                at = size if stop < 0 else stop + 1
                continue
            if name == "br":
                add(" ")
                continue
            if name == "a":
                in_link += 1
                continue
            if name not in BLOCKS:
                continue
            flush()
            if name in ENDS_P:
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] == "p":
                        del stack[k:]
                        in_link = 0
                        break
                    if tags[stack[k]] in ("td", "th", "button", "table", "caption"):
                        break
            elif name in CLOSES:
                which, upto = CLOSES[name]
                for k in range(len(stack) - 1, 0, -1):
                    if tags[stack[k]] in which:
                        del stack[k:]
                        break
                    if tags[stack[k]] in upto:
                        break
            if name in VOID:
                continue
            feats = [_TAGS[name]]
            if m[3]:
                for v in _ATTR.findall(m[3]):
                    feats += [_NAMES[p] for x in _PART.findall(v[0] or v[1] or v[2]) if (p := x.lower()) in _NAMES]
            self.parent.append(stack[-1])
            self.depth.append(self.depth[stack[-1]] + 1)
            self.feats.append(feats)
            tags.append(name)
            chars.append(0)
            linked.append(0)
            stack.append(len(tags) - 1)
        flush()
        last = {node: block for node, block in self.blocks}
        for i, f in enumerate(self.feats):
            n = chars[i]
            f.append(_BASE)
            if not n:
                f.append(_BASE + 1)
                continue
            f.append(_BASE + 2 + (n > 20) + (n > 80) + (n > 200) + (n > 600))
            share = linked[i] / n
            f.append(_BASE + 7 + (share > 0.1) + (share > 0.6))
            block = last[i]
            if block[-1] in ".!?:。":
                f.append(_BASE + 10)
            if "," in block:
                f.append(_BASE + 11)
            if "©" in block:
                f.append(_BASE + 12)


class Forest:
    """Nodes of many pages as arrays, with levels by depth, for message passing."""

    def __init__(self, doms: list[Dom]):
        first = np.cumsum([0] + [len(d.parent) for d in doms])
        self.first = first
        self.parent = np.concatenate([np.array(d.parent, np.int64) + f for d, f in zip(doms, first)]) if doms else np.zeros(0, np.int64)
        depth = np.concatenate([np.array(d.depth) for d in doms]) if doms else np.zeros(0, np.int64)
        order = np.argsort(depth, kind="stable")
        self.levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
        flat = [f for d in doms for f in d.feats]
        self.owner = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
        self.feats = np.array([x for f in flat for x in f], np.int64)
        self.n = len(flat)

    def marginals(self, weights: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(content) of each node, and expected counts [2, 2] of (parent, child) states. weights: FEATURES; pair: log potentials."""
        unary = np.bincount(self.owner, weights[self.feats], self.n)
        up = np.stack([np.zeros(self.n), unary], 1)  # log of the subtree's evidence by the node's state
        phi = np.exp(pair)
        msg = np.zeros((self.n, 2))
        for level in self.levels[:0:-1]:
            e = np.exp(up[level] - up[level].max(1, keepdims=True))
            msg[level] = np.log(e @ phi.T) + up[level].max(1, keepdims=True)
            for s in (0, 1):
                np.add.at(up[:, s], self.parent[level], msg[level, s])
        full = up.copy()
        both = np.zeros((2, 2))
        for level in self.levels[1:]:
            rest = full[self.parent[level]] - msg[level]  # the parent's belief without this child
            rest -= rest.max(1, keepdims=True)
            own = up[level] - up[level].max(1, keepdims=True)
            joint = np.exp(rest)[:, :, None] * phi * np.exp(own)[:, None, :]
            joint /= joint.sum((1, 2), keepdims=True)
            both += joint.sum(0)
            full[level] = up[level] + np.log(np.exp(rest) @ phi)
        p = np.exp(full - full.max(1, keepdims=True))
        return p[:, 1] / p.sum(1), both


def train(pages: list[str], rounds: int = 150, rate: float = 0.15, decay: float = 2e-4) -> tuple[np.ndarray, np.ndarray]:
    """(weights, pair potentials) fitted to pages whose content texts carry the mark."""
    doms = [Dom(p) for p in pages]
    forest = Forest(doms)
    gold = np.zeros(forest.n)
    for d, first in zip(doms, forest.first):
        for node, block in d.blocks:
            if MARK in block:
                gold[first + node] = 1
        for i in range(len(d.parent) - 1, 0, -1):  # a wrapper is content if all that it wraps is
            kids = [k for k in range(i + 1, len(d.parent)) if d.parent[k] == i]
            if kids and not any(n == i for n, _ in d.blocks):
                gold[first + i] = float(np.mean([gold[first + k] for k in kids]) > 0.5)
    child = np.concatenate(forest.levels[1:])
    gold_pair = np.bincount((2 * gold[forest.parent[child]] + gold[child]).astype(np.int64), minlength=4).reshape(2, 2)
    want = np.bincount(forest.feats, gold[forest.owner], FEATURES)
    x = np.zeros(FEATURES + 4)
    m1, m2 = np.zeros_like(x), np.zeros_like(x)
    for r in range(1, rounds + 1):
        p, both = forest.marginals(x[:FEATURES], x[FEATURES:].reshape(2, 2))
        g = np.concatenate([want - np.bincount(forest.feats, p[forest.owner], FEATURES), (gold_pair - both).ravel()]) / len(pages) - decay * len(x) * x / 10
        m1 += 0.1 * (g - m1)
        m2 += 0.01 * (g * g - m2)
        x += rate * (m1 / (1 - 0.9**r)) / (np.sqrt(m2 / (1 - 0.99**r)) + 1e-8)
    return x[:FEATURES], x[FEATURES:].reshape(2, 2)


def texts(pages: list[str | None], model: tuple[np.ndarray, np.ndarray]) -> list[str]:
    """The main text of each page."""
    doms = [Dom(p or "") for p in pages]
    forest = Forest(doms)
    p, _ = forest.marginals(*model)
    return ["\n\n".join(block for node, block in d.blocks if p[first + node] > 0.5) for d, first in zip(doms, forest.first)]


def extract(pages: DataFrame, model: tuple[np.ndarray, np.ndarray], batch: int = 200) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of pages."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo in range(0, b.num_rows, batch):
                part = b.slice(lo, batch)
                out = texts(part.column(2).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), "html").mapInArrow(emit, "page_id long, url string, text string, n_chars long")


def op7_html_extraction(spark: SparkSession, sf_dir: str, training_pages: int = 600) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"), train(labelled_pages(training_pages)))
