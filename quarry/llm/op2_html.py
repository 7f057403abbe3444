"""Operator 2: main text of web pages by gradient-boosted trees over DOM nodes.

A page becomes a tree of its block elements (inline markup only adds text to
the block it stands in). Every block is described by the density of text,
tags and links in its subtree, its depth, its place among its siblings, and
the evidence of the tag, class, id and role tokens of itself and of the
blocks around it. Boosted trees turn that into log-odds that the block
belongs to the article. Decoding is hierarchical: a block is kept only with
all blocks above it, and the choice with the largest total (log-odds weighted
by text) is found exactly from the leaves up, so a kept block never stands in
a dropped one. Kept text is given block by block in page order.

Fit: there are no labelled pages, so the trees learn from pages made for the
purpose, whose labels are known by construction: sentences of at most
``SAMPLE_PAGES`` pages (by a hash of the id; the only bounded part) are set
into drawn layouts with menus, headers, sidebars, notices, adverts, forms,
comments and footers under the names that sites use for them. The trees are a
few kilobytes; every page is parsed whole where it is read, without a shuffle.

Defined results: a null or empty page has an empty text; markup that is not
closed or not opened is taken as browsers take it, but of a select or button
left open only the tag is passed over; repeated rows repeat; an
empty table gives an empty result; columns other than page_id, url and html
are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from html import unescape

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import map_rows, share
from quarry.session import read_table

SAMPLE_PAGES = 200
MADE_PAGES = 500
SEED = 2
N_TREES, DEPTH, RATE, BINS, MIN_LEAF = 40, 4, 0.2, 32, 20
CONTAINER_WEIGHT = 0.1  # share of its subtree's text by which a block's own log-odds count

# Elements by their role in a page (fixed values of the markup language).
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small "
                   "span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title".split())  # template: no text of the page
CONTROLS = frozenset("select button".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form "
                     "h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
FENCE = frozenset("table ul ol dl div article section main body html nav aside header footer form object".split())
# Within svg: elements that hold markup of the page again, and elements that end an open svg where they begin.
SVG_HOLDS_PAGE = frozenset("foreignobject desc title".split())
ENDS_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li "
                     "listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
                 r"|<[a-zA-Z!?/][^>]*+(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role|itemprop|hidden|aria-hidden)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
UNQUOTED_END = re.compile(r"=\s*[^\s\"']\S*\Z")
TOKEN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
SENTENCE_END = re.compile(r"[.!?](?:\s|$)")


class Block:
    __slots__ = ("parent", "tag", "tokens", "depth", "parts", "chars", "linked", "children", "tags", "ends", "start",
                 "all_chars", "all_linked", "all_tags", "all_ends", "blocks")

    def __init__(self, parent, tag, tokens, depth, start):
        self.parent, self.tag, self.tokens, self.depth, self.start = parent, tag, tokens, depth, start
        self.parts: list = []       # (order, text) runs of its own text
        self.children: list = []
        self.chars = self.linked = self.tags = self.ends = 0


def self_closed(attributes: str) -> bool:
    """Whether the slash before ``>`` is one of its own and not the end of an unquoted value."""
    return attributes.endswith("/") and not UNQUOTED_END.search(QUOTED.sub('""', attributes))


class OpenElements:
    """The open elements, and where in them each name and the nearest fence stand,
    so that no tag has to look through all of them."""

    def __init__(self, root: Block):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}
        self.fences: list[int] = []

    def add(self, b: Block) -> None:
        self.places.setdefault(b.tag, []).append(len(self.stack))
        if b.tag in FENCE:
            self.fences.append(len(self.stack))
        self.stack.append(b)

    def nearest(self, names, fenced: bool) -> int:
        """Place of the nearest open element of these names, 0 if there is none (``fenced``: none before a fence)."""
        at = max((self.places[x][-1] for x in names if self.places.get(x)), default=0)
        return 0 if fenced and self.fences and at < self.fences[-1] else at

    def close(self, at: int) -> None:
        while len(self.stack) > at:
            tag = self.stack.pop().tag
            self.places[tag].pop()
            if tag in FENCE:
                self.fences.pop()


def svg_end(html: str, at: int, around: OpenElements) -> int:
    """Where the page goes on after an svg tag that ends at ``at``: behind its end tag, or, if it is left open, at
    the first tag that belongs to the page: one that svg cannot hold, or the end of an element around it."""
    held, n_held = ["svg"], Counter(["svg"])
    for m in TAG.finditer(html, at):
        name = (m.group(2) or "").lower()
        if not name:
            continue
        page_again = any(n_held[x] for x in SVG_HOLDS_PAGE)
        if not m.group(1):
            if name in ENDS_SVG and not page_again:
                return m.start()
            if not self_closed(m.group(3)) and not (page_again and name in VOID):
                held.append(name)
                n_held[name] += 1
        elif n_held[name]:
            last = ""
            while last != name:
                last = held.pop()
                n_held[last] -= 1
            if not held:
                return m.end()
        elif not page_again and (name in ("p", "br") or name in INLINE or around.nearest((name,), False)):
            return m.start()
    return len(html)


def control_end(html: str, at: int, control: str, around: OpenElements) -> int:
    """Behind the end tag of a select or button that ends at ``at``; ``at`` if it is left open, that is if another
    one begins, or an element around it ends, before: then the page is read on."""
    held = Counter()
    for m in TAG.finditer(html, at):
        name = (m.group(2) or "").lower()
        if name == control:
            return m.end() if m.group(1) else at
        if not name or name in VOID or name in INLINE:
            continue
        if not m.group(1):
            held[name] += 1
        elif held[name]:
            held[name] -= 1
        elif around.nearest((name,), False):
            return at
    return at


def parse(html: str) -> list[Block]:
    """Blocks in page order, the root first; each holds its runs of text, numbered in page order."""
    root = Block(None, "", (), 0, 0)
    blocks, around = [root], OpenElements(root)
    stack = around.stack
    inline: list[str] = []          # open inline elements that matter: links
    run: list[str] = []
    order = 0

    def flush():
        nonlocal order, run
        if run:
            text = " ".join(unescape("".join(run)).split())
            if text:
                b = stack[-1]
                b.parts.append((order, text))
                b.chars += len(text)
                b.ends += len(SENTENCE_END.findall(text))
                order += 1
            run = []

    at, n = 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        if not m:
            run.append(html[at:])
            if inline:
                stack[-1].linked += n - at
            break
        if m.start() > at:
            run.append(html[at:m.start()])
            if inline:
                stack[-1].linked += m.start() - at
        at = m.end()
        name = m.group(2)
        if not name:
            continue
        name = name.lower()
        stack[-1].tags += 1
        if m.group(1):
            if name == "a":
                if inline:
                    inline.pop()
            elif name not in INLINE and name not in VOID:
                k = around.nearest((name,), name == "p")
                if k:
                    flush()
                    around.close(k)
                    inline.clear()
            continue
        if name in RAW:
            # Without an end tag these run to the end of the page; the slash of <script/> closes nothing.
            end = re.compile("</" + re.escape(name) + r"\s*>", re.I).search(html, at)
            at = end.end() if end else n
            run.append(" ")
            continue
        if name in CONTROLS:
            at = control_end(html, at, name, around)
            run.append(" ")
            continue
        if name == "svg":
            if not self_closed(m.group(3)):
                at = svg_end(html, at, around)
            run.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            else:
                run.append(" " if name == "br" else "")
            continue
        if name in INLINE:
            if name == "a":
                inline[:] = ["a"]
            continue
        flush()
        inline.clear()
        if name in CLOSES_P and (k := around.nearest(("p",), True)):
            around.close(k)
        if name in SAME and (k := around.nearest(SAME[name], True)):
            around.close(k)
        tokens = ["<" + name]
        for key, value in ATTRIBUTE.findall(m.group(3)) if m.group(3) else ():
            tokens += (t.lower() for t in TOKEN.findall(key + " " + value if "hidden" in key else value))
        b = Block(stack[-1], name, tuple(tokens), len(stack), at)
        stack[-1].children.append(b)
        around.add(b)
        blocks.append(b)
    flush()
    for b in blocks:
        b.all_chars, b.all_linked, b.all_tags, b.all_ends, b.blocks = b.chars, min(b.linked, b.chars), b.tags, b.ends, 1
    for b in reversed(blocks):
        p = b.parent
        if p is not None:
            p.all_chars += b.all_chars
            p.all_linked += b.all_linked
            p.all_tags += b.all_tags
            p.all_ends += b.all_ends
            p.blocks += b.blocks
    return blocks


FEATURES = ("own_token", "worst_token_above", "best_token_above", "parent_token", "depth", "blocks", "chars", "own_chars",
            "density", "links", "sentences", "share_of_page", "share_of_parent", "place", "siblings", "like_siblings",
            "sibling_chars", "sibling_links", "begin", "parent_density", "parent_links", "ends_per_char")


def features(blocks: list[Block], evidence: dict[str, float]) -> np.ndarray:
    """One row per block. ``evidence``: log-odds of each tag and attribute token."""
    total = max(1, blocks[0].all_chars)
    length = max(1, max(b.start for b in blocks))
    rows, of = [], {}
    for b in blocks:
        known = [evidence[t] for t in b.tokens if t in evidence]
        own = min(known) + max(known) if known else 0.0
        p = b.parent
        above = of.get(id(p), (0.0, 0.0, 0.0))
        of[id(b)] = (min(above[0], own), max(above[1], own), own)
        chars, tags = b.all_chars, b.all_tags
        if p is not None:
            around = p.children
            others = len(around) - 1
            rest = (p.all_chars - p.chars - chars) / others if others else 0.0
            rest_links = (p.all_linked - b.all_linked) / max(1, p.all_chars - chars)
            like = sum(c.tag == b.tag for c in around[:64]) / min(64, len(around))
            parent = (chars / max(1, p.all_chars), p.all_chars / (1 + p.all_tags), p.all_linked / max(1, p.all_chars))
        else:
            others, rest, rest_links, like, parent = 0, 0.0, 0.0, 1.0, (1.0, 0.0, 0.0)
        rows.append((own, above[0], above[1], above[2], b.depth, b.blocks, math.log1p(chars), math.log1p(b.chars),
                     chars / (1 + tags), b.all_linked / max(1, chars), math.log1p(b.all_ends), chars / total, parent[0],
                     0.0, others, like, math.log1p(max(0.0, rest)), rest_links, b.start / length, parent[1], parent[2],
                     b.all_ends / max(20, chars)))
    out = np.array(rows, np.float64).reshape(len(rows), len(FEATURES))
    index = {id(b): i for i, b in enumerate(blocks)}
    for b in blocks:
        n = len(b.children)
        for k, c in enumerate(b.children):
            out[index[id(c)], 13] = k / max(1, n - 1)
    return out


# --- boosted trees ------------------------------------------------------------------------

class Boosted:
    """Logistic boosting of complete trees on binned features."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> "Boosted":
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
        binned = self._bins(x)
        rate = y.mean()
        self.base = math.log(rate / (1 - rate))
        score = np.full(len(y), self.base)
        self.trees = []
        for _ in range(N_TREES):
            p = 1 / (1 + np.exp(-score))
            tree = self._grow(binned, y - p, p * (1 - p))
            self.trees.append(tree)
            score += self._leaves(tree, binned)
        return self

    def _bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, side="right") for c, v in zip(self.cuts, x.T)], axis=1).astype(np.int16)

    @staticmethod
    def _grow(binned: np.ndarray, g: np.ndarray, h: np.ndarray):
        """Arrays over the nodes of a complete tree: feature, last bin to the left; and the leaf values."""
        n_features = binned.shape[1]
        feature, cut = np.zeros(2 ** DEPTH - 1, int), np.full(2 ** DEPTH - 1, BINS)
        node = np.zeros(len(g), int)
        for level in range(DEPTH):
            first = 2 ** level - 1
            for k in range(first, 2 * first + 1):
                at = np.flatnonzero(node == k)
                best = 1e-6
                if len(at) >= 2 * MIN_LEAF:
                    gs, hs = g[at].sum(), h[at].sum()
                    whole = gs * gs / (hs + 1)
                    for f in range(n_features):
                        b = binned[at, f]
                        gl = np.cumsum(np.bincount(b, g[at], BINS))[:-1]
                        hl = np.cumsum(np.bincount(b, h[at], BINS))[:-1]
                        nl = np.cumsum(np.bincount(b, minlength=BINS))[:-1]
                        gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - whole
                        gain[(nl < MIN_LEAF) | (len(at) - nl < MIN_LEAF)] = 0
                        j = int(gain.argmax())
                        if gain[j] > best:
                            best, feature[k], cut[k] = gain[j], f, j
                node[at] = 2 * k + 1 + (binned[at, feature[k]] > cut[k])
        leaf = node - (2 ** DEPTH - 1)
        value = RATE * np.bincount(leaf, g, 2 ** DEPTH) / (np.bincount(leaf, h, 2 ** DEPTH) + 1)
        return feature, cut, value

    @staticmethod
    def _leaves(tree, binned: np.ndarray) -> np.ndarray:
        feature, cut, value = tree
        node = np.zeros(len(binned), int)
        row = np.arange(len(binned))
        for _ in range(DEPTH):
            node = 2 * node + 1 + (binned[row, feature[node]] > cut[node])
        return value[node - (2 ** DEPTH - 1)]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        binned = self._bins(x)
        return self.base + sum(self._leaves(t, binned) for t in self.trees)


# --- decoding -----------------------------------------------------------------------------

def decode(blocks: list[Block], odds: np.ndarray) -> list[bool]:
    """The choice with the largest total in which no kept block stands in a dropped one."""
    worth = [0.0] * len(blocks)
    index = {id(b): i for i, b in enumerate(blocks)}
    for i in range(len(blocks) - 1, -1, -1):
        b = blocks[i]
        # The root and the page's frame hold everything; they are no choice.
        own = 0.0 if b.tag in ("", "html", "body") else float(odds[i]) * (b.chars + CONTAINER_WEIGHT * (b.all_chars - b.chars))
        if b.tag == "head":
            own = -1e18
        worth[i] = max(0.0, own + sum(worth[index[id(c)]] for c in b.children))
    kept = [False] * len(blocks)
    for i, b in enumerate(blocks):
        above = b.parent is None or kept[index[id(b.parent)]]
        kept[i] = above and (worth[i] > 0 or b.tag in ("", "html", "body"))
        if kept[i] and b.tag in ("", "html", "body") and odds[i] <= 0:
            b.parts = []  # bare text of the frame
    return kept


class Extractor:
    def __init__(self, evidence: dict[str, float], trees: Boosted):
        self.evidence, self.trees = evidence, trees

    def texts(self, pages: list[str | None]) -> list[str]:
        parsed = [parse(p or "") for p in pages]
        rows = [features(b, self.evidence) for b in parsed]
        odds = self.trees.log_odds(np.concatenate(rows)) if rows else np.empty(0)
        out, at = [], 0
        for blocks, r in zip(parsed, rows):
            kept = decode(blocks, odds[at:at + len(r)])
            at += len(r)
            out.append("\n".join(t for _, t in sorted(p for b, k in zip(blocks, kept) if k for p in b.parts)))
        return out


# --- pages to learn from ------------------------------------------------------------------

# Names that sites give to the parts of a page (fixed values).
NAMES = {
    "main": "article post entry content main story body text page single hentry".split(),
    "header": "header masthead top banner branding title logo".split(),
    "menu": "nav menu navigation navbar breadcrumb breadcrumbs links tabs skip".split(),
    "sidebar": "sidebar aside widget related recommended popular rail secondary archive tags".split(),
    "notice": "notice cookie consent gdpr alert message warning popup modal newsletter subscribe disclaimer".split(),
    "advert": "ad ads advert advertisement sponsored sponsor promo promotion banner".split(),
    "form": "form search login signup contact subscribe".split(),
    "comments": "comment comments commentlist discussion replies reply respond disqus reader".split(),
    "footer": "footer foot copyright colophon legal bottom credits".split(),
    "share": "share social sharing meta byline buttons tools".split(),
}
TAGS = {"main": ["article", "main", "div", "section"], "header": ["header", "div"], "menu": ["nav", "div", "ul"],
        "sidebar": ["aside", "div", "section"], "notice": ["div", "p", "section", "aside"], "advert": ["div", "aside", "section", "p"],
        "form": ["form"], "comments": ["section", "div", "ol"], "footer": ["footer", "div"], "share": ["div", "ul", "p"]}


class Maker:
    """Draws pages from sentences; ``label`` tokens in the markup tell which blocks are article."""

    def __init__(self, sentences: list[str], seed: int = SEED):
        self.r = np.random.default_rng(seed)
        self.sentences = sentences or ["word word word."]

    def pick(self, items):
        return items[int(self.r.integers(len(items)))]

    def chance(self, p: float) -> bool:
        return bool(self.r.random() < p)

    def text(self, most: int) -> str:
        return " ".join(self.pick(self.sentences) for _ in range(int(self.r.integers(1, most + 1))))

    def words(self, most: int) -> str:
        w = self.pick(self.sentences).split()
        return " ".join(w[: int(self.r.integers(1, most + 1))])

    def open(self, part: str, named: float = 0.85) -> tuple[str, str]:
        tag = self.pick(TAGS[part])
        bare = tag in ("article", "main", "header", "nav", "aside", "footer", "form") and self.chance(0.6)
        name = "" if bare or not self.chance(named) else " %s=\"%s%s\"" % (
            self.pick(["class", "class", "id"]), self.pick(["", "site-", "page-", "main-" if part != "main" else "the-", "c-"]),
            self.pick(NAMES[part]))
        return f"<{tag}{name}>", f"</{tag}>"

    def link(self) -> str:
        return f'<a href="/{self.words(1)}">{self.words(3)}</a>'

    def links(self, item: str = "li") -> str:
        inner = "".join(f"<{item}>{self.link()}</{item}>" for _ in range(int(self.r.integers(2, 9))))
        return f"<ul>{inner}</ul>" if item == "li" else inner

    def noise(self, part: str) -> str:
        a, z = self.open(part)
        if part in ("menu",):
            body = self.links()
        elif part == "sidebar":
            body = (f"<h3>{self.words(3)}</h3>" if self.chance(0.6) else "") + (
                self.links() if self.chance(0.6) else f"<p>{self.text(2)}</p>")
        elif part == "header":
            body = f"<div>{self.words(4)}</div>" if self.chance(0.5) else f"<h2>{self.words(4)}</h2><p>{self.words(8)}</p>"
        elif part == "comments":
            item = self.pick(["div", "li", "p", "article"]) if not a.startswith("<ol") else "li"
            one = f' class="{self.pick(NAMES["comments"])}"' if self.chance(0.7) else ""
            wrap = "<p>%s</p>" if item != "p" and self.chance(0.7) else "%s"
            body = (f"<h3>{self.words(3)}</h3>" if self.chance(0.5) else "") + "".join(
                f"<{item}{one}>" + wrap % self.text(3) + f"</{item}>" for _ in range(int(self.r.integers(1, 6))))
        elif part == "form":
            body = f"<label>{self.words(3)}</label><input name=q><p>{self.words(10)}</p><button>{self.words(2)}</button>"
        elif part == "footer":
            body = f"&copy; {self.words(4)} &middot; {self.text(1)}" if self.chance(0.6) else f"<p>{self.text(1)}</p>" + self.links()
        elif part == "share":
            body = " ".join(self.link() for _ in range(3)) if self.chance(0.6) else self.words(8)
        else:
            body = self.text(2) if self.chance(0.6) else f"<p>{self.text(2)}</p>" + (self.link() if self.chance(0.4) else "")
        if a.startswith("<p"):
            body = re.sub(r"</?(?:p|ul|li|div|h\d)[^>]*>", " ", body)
        if a.startswith(("<ul", "<ol")) and not body.startswith("<li"):
            body = f"<li>{body}</li>"
        return a + body + z

    def article(self) -> str:
        mark = ' data-label="1"'
        parts = [f"<h1{mark}>{self.words(9)}</h1>"] if self.chance(0.8) else []
        for _ in range(int(self.pick([0, 1, 2, 3, 4, 6, 9, 14]))):
            kind = self.r.random()
            body = self.text(int(self.pick([1, 1, 2, 4, 8])))
            if self.chance(0.15):
                body += " " + self.link() + " " + self.words(4)
            if kind < 0.8:
                opened = "<b>" if self.chance(0.1) else ""
                parts.append(f"<p{mark}>{opened}{body}" + ("<br>" if opened else "</p>"))
            elif kind < 0.86:
                parts.append(f"<h2{mark}>{self.words(6)}</h2>")
            elif kind < 0.9:
                parts.append(f"<ul{mark}>" + "".join(f"<li{mark}>{self.words(12)}</li>" for _ in range(3)) + "</ul>")
            elif kind < 0.94:
                parts.append(f"<blockquote{mark}>{body}</blockquote>")
            elif kind < 0.97:
                parts.append(f"<table{mark}><tr{mark}><td{mark}>{self.words(4)}</td><td{mark}>{self.words(4)}</td></tr></table>")
            else:
                parts.append(f"<div{mark}>{body}</div>")
            if self.chance(0.06):
                parts.append(self.noise(self.pick(["advert", "share", "sidebar", "form", "notice"])))
        if not parts:
            parts.append(f"<p{mark}>{self.text(1)}</p>")
        if self.chance(0.15):
            parts.append(self.noise("comments"))
        a, z = self.open("main", 0.8)
        return a[:-1] + mark + ">" + "".join(parts) + z

    def page(self) -> str:
        before = [self.noise(p) for p in ("header", "menu", "notice", "advert", "form", "sidebar") if self.chance(0.5)]
        after = [self.noise(p) for p in ("share", "comments", "sidebar", "advert", "notice", "form", "menu") if self.chance(0.4)]
        self.r.shuffle(before)
        self.r.shuffle(after)
        if self.chance(0.85):
            after.append(self.noise("footer"))
        middle = self.article()
        if self.chance(0.25):
            middle = f'<div class="{self.pick(["wrapper", "container", "row", "layout"])}">' + middle + (
                after.pop(0) if after and self.chance(0.5) else "") + "</div>"
        return "<html><body>" + "".join(before) + middle + "".join(after) + "</body></html>"


MARKED = re.compile(r"<(\w+)([^>]*?) data-label=\"1\">")


def made_page(maker: Maker) -> tuple[list[Block], list[int]]:
    """A drawn page without its marks, and the label of every block."""
    html = maker.page()
    # The mark travels as a class token, so the parser carries it to the block.
    blocks = parse(MARKED.sub(r'<\1\2 id="zzlabel">', html))
    labels = []
    for b in blocks:
        labels.append(int("zzlabel" in b.tokens))
        b.tokens = tuple(t for t in b.tokens if t != "zzlabel")
    return blocks, labels


def train(sentences: list[str], pages: int = MADE_PAGES, seed: int = SEED) -> Extractor:
    maker = Maker(sentences, seed)
    made = [made_page(maker) for _ in range(pages)]
    seen: dict[str, list[float]] = {}
    for blocks, labels in made:
        for b, y in zip(blocks, labels):
            for t in set(b.tokens):
                seen.setdefault(t, [0.0, 0.0])[y] += 1
    n0, n1 = (sum(c[k] for c in seen.values()) for k in (0, 1))
    evidence = {t: math.log((c1 + 0.5) / (n1 + 1)) - math.log((c0 + 0.5) / (n0 + 1)) for t, (c0, c1) in seen.items()}
    rows = [(features(b, evidence), y) for b, y in made]
    x, y = np.concatenate([r for r, _ in rows]), np.concatenate([y for _, y in rows]).astype(float)
    use = np.array([b.tag not in ("", "html", "body") for blocks, _ in made for b in blocks])
    return Extractor(evidence, Boosted().fit(x[use], y[use]))


def sample_sentences(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> list[str]:
    """Sentences of a bounded, repeatable sample of pages."""
    total = max(1, pages.count())
    rows = pages.filter(share(["page_id"], 2) * total < sample_pages).select("html").collect()
    out = []
    for text in sorted(" ".join(t for b in parse(r.html or "") for _, t in b.parts) for r in rows):
        out += [s for s in re.split(r"(?<=[.!?]) ", text) if 2 <= len(s) <= 400][:40]
    return out


def extract_text(pages: DataFrame, extractor: Extractor) -> DataFrame:
    """page_id, url, text, n_chars."""
    shared = pages.sparkSession.sparkContext.broadcast(extractor)

    def run(batches):
        for b in batches:
            for a in range(0, len(b["html"]), 256):
                texts = shared.value.texts(b["html"][a:a + 256])
                yield {"page_id": b["page_id"][a:a + 256], "url": b["url"][a:a + 256], "text": texts,
                       "n_chars": [len(t) for t in texts]}

    return map_rows(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html"),
                    "page_id long, url string, text string, n_chars long", run)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return extract_text(pages, train(sample_sentences(pages)))
