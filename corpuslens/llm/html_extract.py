"""Main text of web pages: gradient-boosted trees over DOM nodes, decoded along the tree.

A page is parsed to elements. Each gets features: tag, depth, attribute tokens of itself and its ancestors (hashed to
BINS), size and density of its subtree, links, punctuation, and how it compares with its siblings. Boosted trees give
the log odds that the element belongs to the article. Decoding picks the best consistent set: a kept element needs a
kept parent, so K(node) = odds + sum of max(0, K(child)), and a child is kept if its K is positive.

The trees are learned on the driver from synthetic pages that synthetic_page() composes from parts whose role is
known (bounded by PAGES), and sent to the tasks; no page of the input is used for learning.

Defined results: null and empty pages give an empty text. Each row gives one row; null page_ids and repeated rows are
kept. Broken markup is read as far as it goes: an unknown end tag is skipped, an unfinished tag is text. Text
outside all elements belongs to the page itself, which is always kept. Character references are decoded; white space
(Unicode's, line breaks included) inside a block becomes one space. Other columns are not read.
"""

from __future__ import annotations

import bisect
import functools
import html
import random
import re
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame

from corpuslens.llm.common import bound_batches, slices

#: Tags that are features of their own, tags that end a block of text, tags without content, tags that a start tag closes.
TAGS = "html head title body nav header footer main article section aside div p h1 h2 h3 h4 ul ol li dl dt dd table tr td th blockquote pre figure figcaption form label button select option textarea input a b strong em i span img small noscript template iframe svg details summary time".split()
BLOCKS = set("html head title body nav header footer main article section aside div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption form fieldset legend select option textarea noscript template iframe details summary address hr center menu dialog button label video audio canvas object".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table")), "option": ("option", ("select",))}
#: A start tag of these ends an open paragraph.
ENDS_P = BLOCKS - set("button label option select textarea td th tr tbody thead tfoot html head body title iframe noscript template video audio canvas object".split())
BINS = 128
PAGES, TREES, DEPTH, STEP, SPLITS = 400, 40, 5, 0.25, 32

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b(?>[^>]*)(?:>.*?(?:</\1\s*>|\Z)|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*')*+|[^>]*)>", re.S | re.I)
_ATTR = re.compile(r"(?:id|class|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_TAG = {t: i for i, t in enumerate(TAGS)}


@functools.lru_cache(maxsize=50_000)
def _bits(attrs: str) -> int:
    """Hashed attribute tokens of a start tag."""
    out = 0
    for m in _ATTR.finditer(attrs):
        for token in re.findall(r"[a-z]+", (m[1] or m[2] or m[3] or "").lower()):
            out |= 1 << (zlib.crc32(token.encode()) % BINS)
    return out


@dataclass
class Page:
    """Elements in page order. parent, tag, end (of the subtree), bits, masks: per element; texts: (element, block, text)."""

    parent: list[int] = field(default_factory=list)
    tag: list[int] = field(default_factory=list)
    names: list[str] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    bits: list[int] = field(default_factory=list)
    over: list[int] = field(default_factory=list)
    texts: list[tuple[int, int, str]] = field(default_factory=list)


def parse(source: str) -> Page:
    page, block, at = Page(), 0, 0
    parent, tags, names, depth, bits, over, texts = page.parent, page.tag, page.names, page.depth, page.bits, page.over, page.texts

    def add(name: str, attrs: str, up: int) -> int:
        parent.append(up)
        names.append(name)
        tags.append(_TAG.get(name, len(TAGS)))
        depth.append(depth[up] + 1 if up >= 0 else 0)
        bits.append(_bits(attrs) if attrs else 0)
        # attribute tokens and tags of the element and all above it
        over.append((over[up] if up >= 0 else 0) | bits[-1] | 1 << (BINS + tags[-1]))
        return len(parent) - 1

    # open elements, and where in the stack those of each name and the blocks stand, so that no tag walks the stack
    stack, where, blocks = [add("#page", "", -1)], {}, []

    def last(name: str) -> int:
        return where[name][-1] if where.get(name) else 0

    def pop_to(n: int) -> None:
        while len(stack) > n:
            name = names[stack.pop()]
            where[name].pop()
            if name in BLOCKS:
                blocks.pop()

    for m in _TOKEN.finditer(source):
        if m.start() > at:
            text = source[at : m.start()]
            texts.append((stack[-1], block, html.unescape(text) if "&" in text else text))
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        is_block = name in BLOCKS
        if m[2]:
            if i := last(name):
                pop_to(i)
            block += is_block
            continue
        if name == "br":
            texts.append((stack[-1], block, " "))
        if is_block:
            block += 1
            if name in ENDS_P and blocks and names[stack[blocks[-1]]] == "p":
                pop_to(blocks[-1])
            if name in CLOSES:
                closed, scope = CLOSES[name]
                inner = max(map(last, scope))
                if ends := [at_[i] for n in closed.split() if (at_ := where.get(n)) and (i := bisect.bisect_right(at_, inner)) < len(at_)]:
                    pop_to(min(ends))
        node = add(name, m[4], stack[-1])
        if name not in VOID and not (m[4] and m[4].endswith("/") and name not in BLOCKS):
            where.setdefault(name, []).append(len(stack))
            if is_block:
                blocks.append(len(stack))
            stack.append(node)
    if at < len(source):
        texts.append((stack[-1], block, html.unescape(source[at:])))
    return page


def features(pages: list[Page]) -> np.ndarray:
    """A row per element of the pages, in order."""
    sizes = [len(p.parent) for p in pages]
    base = np.cumsum([0, *sizes])
    n = int(base[-1])
    parent = np.concatenate([np.asarray(p.parent) + b for p, b in zip(pages, base)])
    root = np.repeat(base[:-1], sizes)
    parent = np.where(parent < root, np.arange(n), parent)
    tag, depth = np.concatenate([p.tag for p in pages]), np.concatenate([p.depth for p in pages])
    own = np.zeros((n, 6))  # characters, words, sentence marks, digits or capitals, pieces; characters in links
    is_link = np.zeros(n, bool)
    for p, b in zip(pages, base):
        for node, _, text in p.texts:
            if chars := len(text):
                row = own[b + node]
                words = text.count(" ") + text.count("\n") + 1
                row[0] += chars
                row[1] += words
                row[2] += text.count(".") + text.count(",") + text.count("?") + text.count("!")
                row[3] += text.count("|") + text.count("»") + text.count("©") + text.count("·")
                row[4] += 1
        for i, (name, up) in enumerate(zip(p.names, p.parent)):
            is_link[b + i] = name == "a" or (up >= 0 and is_link[b + up])
    own[:, 5] = own[:, 0] * is_link
    # subtrees are ranges of page order: the end of one is the next element that is not deeper
    end = np.arange(1, n + 1)
    for i in range(n - 1, -1, -1):
        if parent[i] != i:
            end[parent[i]] = max(end[parent[i]], end[i])
    run = lambda x: (lambda c: c[end] - c[np.arange(n)])(np.concatenate((np.zeros((1, *x.shape[1:])), np.cumsum(x, axis=0))))
    below = run(own)
    count = end - np.arange(n)
    is_p, is_a, is_li = (run((tag == _TAG[t]).astype(float)) for t in ("p", "a", "li"))
    is_input = run(np.isin(tag, [_TAG[t] for t in ("input", "button", "select", "textarea", "label")]).astype(float))
    children = np.bincount(parent, minlength=n) - (parent == np.arange(n))
    order = np.zeros(n)
    seen: dict[int, int] = {}
    for i, up in enumerate(parent.tolist()):
        order[i] = seen[up] = seen.get(up, -1) + 1
    mates = np.maximum(children[parent], 1)
    chars = below[:, 0]
    mean_mate = np.bincount(parent, chars, n)[parent] / mates
    same = np.zeros(n)
    keys, inverse, counts = np.unique(parent * (len(TAGS) + 1) + tag, return_inverse=True, return_counts=True)
    same = counts[inverse]
    words = np.maximum(below[:, 1], 1)
    numbers = np.stack([
        depth, children, count, np.log1p(chars), np.log1p(own[:, 0]), chars / np.maximum(chars[root], 1), chars / count, below[:, 5] / np.maximum(chars, 1), below[:, 2] / words, below[:, 3], chars / words,
        is_p, is_a, is_li, is_input, order, order / mates, mates, np.log1p(mean_mate), chars / np.maximum(mean_mate, 1), same, same / mates, np.log1p(chars[parent]), (np.arange(n) - root) / np.maximum(np.repeat(sizes, sizes), 1), below[:, 5][parent] / np.maximum(chars[parent], 1),
    ], axis=1)
    wide = BINS + 64
    over = np.frombuffer(b"".join(x.to_bytes(wide // 8, "little") for p in pages for x in p.over), np.uint8).reshape(n, -1)
    mine = np.frombuffer(b"".join(x.to_bytes(BINS // 8, "little") for p in pages for x in p.bits), np.uint8).reshape(n, -1)
    tags = np.zeros((n, len(TAGS) + 1), np.float32)
    tags[np.arange(n), tag] = 1
    return np.concatenate([numbers.astype(np.float32), np.unpackbits(over, axis=1, bitorder="little").astype(np.float32), np.unpackbits(mine, axis=1, bitorder="little").astype(np.float32), tags], axis=1)


# ---- boosted trees ----


@dataclass(frozen=True)
class Trees:
    """Complete binary trees of depth DEPTH: per inner node a feature and a threshold (go right if above), per leaf a value."""

    bias: float
    feature: np.ndarray  # trees x inner nodes
    threshold: np.ndarray
    value: np.ndarray  # trees x leaves

    def odds(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.bias), np.arange(len(x))
        for f, t, v in zip(self.feature, self.threshold, self.value):
            node = np.zeros(len(x), np.int64)
            for _ in range(DEPTH):
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            out += v[node - (2**DEPTH - 1)]
        return out


def boost(x: np.ndarray, y: np.ndarray) -> Trees:
    """Trees for the log odds of y by Newton steps on binned features."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, SPLITS + 1)[1:-1])) if len(np.unique(x[:, f][:2000])) > 2 else np.array([0.5]) for f in range(x.shape[1])]
    varied = [f for f in range(x.shape[1]) if x[:, f].min() < x[:, f].max()]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in varied], axis=1)
    width = SPLITS + 1
    flat = binned + np.arange(len(varied)) * width
    p = y.mean()
    bias = float(np.log(p / (1 - p)))
    score = np.full(len(y), bias)
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    features_, thresholds, values = [], [], []
    for _ in range(TREES):
        q = 1 / (1 + np.exp(-score))
        g, h = q - y, np.maximum(q * (1 - q), 1e-6)
        node, feature, threshold = np.zeros(len(y), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(DEPTH):
            first, many = 2**level - 1, 2**level
            size = many * len(varied) * width
            at = ((node - first)[:, None] * (len(varied) * width) + flat).ravel()
            gs = np.bincount(at, np.repeat(g, len(varied)), size).reshape(many, len(varied), width).cumsum(axis=2)
            hs = np.bincount(at, np.repeat(h, len(varied)), size).reshape(many, len(varied), width).cumsum(axis=2)
            G, H = gs[:, :1, -1:], hs[:, :1, -1:]
            gain = gs**2 / (hs + 1) + (G - gs) ** 2 / (H - hs + 1) - G**2 / (H + 1)
            gain[(hs < 2) | (H - hs < 2)] = 0
            best = gain.reshape(many, -1).argmax(axis=1)
            for k in range(many):
                f, b = divmod(int(best[k]), width)
                if gain[k, f, b] > 1e-6 and b < len(edges[varied[f]]):
                    feature[first + k], threshold[first + k] = varied[f], edges[varied[f]][b]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > threshold[node])
        leaf = node - inner
        value = -STEP * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + 1)
        score = score + value[leaf]
        features_.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return Trees(bias, np.array(features_), np.array(thresholds), np.array(values))


# ---- synthetic pages ----

_SYLLABLES = "an be co de el fi ga ho in ju ka lo me no or pa qu ri se ta un vi wo ar ing ed er est ion th sch é ü ña ène".split()


class _Writer:
    """Composes a page; every element is written with the mark of its role, which labels it: k (kept) or d (dropped)."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)

    def word(self) -> str:
        return "".join(self.r.choice(_SYLLABLES) for _ in range(self.r.randint(1, 4)))

    def words(self, lo: int, hi: int) -> str:
        return " ".join(self.word() for _ in range(self.r.randint(lo, hi)))

    def sentences(self, lo: int, hi: int) -> str:
        junk = self.r.choice(["", "", "", "", "!!", "%%%", " |"])
        return " ".join(self.words(2, 24).capitalize().replace(" ", junk + self.r.choice([" ", " ", ", "]), 2) + "." for _ in range(self.r.randint(lo, hi)))

    def el(self, tag: str, role: str, body: str, attrs: str = "") -> str:
        return f"<{tag} data-role={role} {attrs}>{body}</{tag}>" if tag not in VOID else f"<{tag} data-role={role} {attrs}>"

    def name(self, choices: str) -> str:
        n = self.r.choice(choices.split())
        style = self.r.random()
        return f'class="{n}"' if style < 0.55 else f'id="{n}"' if style < 0.75 else f'class="{self.word()} {n}"' if style < 0.9 else f'class="{n} {self.word()}-{self.r.randint(1, 9)}"'

    def links(self, role: str, lo: int, hi: int) -> str:
        link = lambda: self.el("a", role, self.words(1, 5), 'href="/x"')
        items = [link() for _ in range(self.r.randint(lo, hi))]
        kind = self.r.random()
        if kind < 0.7:
            return self.el("ul", role, "".join(self.el("li", role, x) for x in items))
        return self.r.choice([" ", " | ", " &middot; "]).join(items)

    def inline(self, text: str, role: str = "k") -> str:
        if self.r.random() < 0.3 and " " in text:
            a, b = text.split(" ", 1)
            tag = self.r.choice(["a", "b", "em", "strong", "i", "span"])
            return self.el(tag, role, a, 'href="/y"' if tag == "a" else "") + " " + b
        return text

    def dropped(self) -> str:
        """A part that is not the article."""
        r, d = self.r, "d"
        kind = r.randrange(13)
        if kind == 0:
            return self.el(r.choice(["nav", "nav", "div"]), d, self.links(d, 2, 9), self.name("menu nav navbar navigation topnav main-menu breadcrumb"))
        if kind == 1:
            body = self.el(r.choice(["h1", "div", "a", "p"]), d, self.words(1, 4)) + (self.links(d, 2, 6) if r.random() < 0.6 else self.el("p", d, self.words(3, 9)))
            return self.el(r.choice(["header", "header", "div"]), d, body, self.name("header site-header masthead banner top logo"))
        if kind == 2:
            body = r.choice([self.links(d, 3, 9), self.el("h3", d, self.words(1, 4)) + self.links(d, 3, 8), self.el("p", d, self.sentences(1, 4)), self.el("div", d, self.el("h4", d, self.words(1, 3)) + self.el("p", d, self.sentences(1, 2)))])
            return self.el(r.choice(["aside", "aside", "div", "section"]), d, body, self.name("sidebar side widget rail related recommended more-stories aside"))
        if kind == 3:
            return self.el(r.choice(["div", "div", "section", "aside", "p", "span"]), d, r.choice([self.sentences(1, 3), self.el("a", d, self.words(2, 9), 'href="/ad"'), self.el("p", d, self.sentences(1, 2)), self.el("b", d, self.words(1, 3)) + " " + self.sentences(1, 1)]), self.name("ad ad ads advert advertisement sponsored promo banner-ad adbox"))
        if kind == 4:
            return self.el("div", d, self.el("p", d, self.sentences(1, 3)) + self.el("button", d, self.words(1, 2)), self.name("cookie cookie-notice notice alert gdpr consent popup newsletter modal disclaimer paywall"))
        if kind == 5:
            body = "".join(r.choice([self.el("label", d, self.words(1, 3)), self.el("input", d, "", 'type="text"'), self.el("button", d, self.words(1, 2)), self.el("select", d, "".join(self.el("option", d, self.words(1, 2)) for _ in range(3))), self.el("textarea", d, self.words(0, 3)), self.el("p", d, self.words(3, 9))]) for _ in range(r.randint(2, 5)))
            return self.el("form", d, body, r.choice(["", self.name("search login subscribe contact-form signup")]))
        if kind in (6, 7):
            one = lambda: self.el(r.choice(["div", "li", "article"]), d, self.el(r.choice(["span", "b", "h4", "a"]), d, self.words(1, 2)) + self.el("p", d, self.sentences(1, 5)), self.name("comment reply comment-body user-comment"))
            head = self.el(r.choice(["h2", "h3"]), d, self.words(1, 3)) if r.random() < 0.7 else ""
            return self.el(r.choice(["section", "div", "ol"]), d, head + "".join(one() for _ in range(r.randint(1, 6))), self.name("comments comments responses discussion comment-list"))
        if kind == 8:
            return self.el("div", d, self.links(d, 2, 6), self.name("share social sharing follow tags pagination pager tools"))
        if kind == 9:
            return self.el(r.choice(["noscript", "template", "iframe"]), d, self.words(2, 9))
        if kind == 10:
            return self.el("div", d, self.links(d, 3, 8), self.name("related more trending popular recommended also-read"))
        if kind == 11:
            return self.el(r.choice(["footer", "footer", "div"]), d, r.choice(["&copy; " + self.words(1, 3) + " &middot; " + self.sentences(1, 1), self.links(d, 2, 8) + self.el("p", d, self.words(2, 9)), self.el("small", d, "&copy; 2020 " + self.words(1, 4))]), self.name("footer site-footer bottom copyright legal"))
        return self.el("div", d, self.el("ul", d, "".join(self.el("li", d, self.words(1, 3)) for _ in range(r.randint(2, 6)))), self.name("menu sidebar toc-nav breadcrumbs nav-list"))

    def kept(self) -> str:
        """A part of the article."""
        r, k = self.r, "k"
        kind = r.random()
        if kind < 0.62:
            return self.el("p", k, self.inline(self.sentences(1, r.choice([1, 3, 9, 20]))))
        if kind < 0.70:
            return f"<p data-role=k><b data-role=k>{self.sentences(1, 1)}<br>"
        if kind < 0.78:
            return self.el(r.choice(["h2", "h3"]), k, self.words(1, 9))
        if kind < 0.85:
            return self.el(r.choice(["ul", "ol"]), k, "".join(self.el("li", k, self.inline(self.sentences(1, 2))) for _ in range(r.randint(2, 6))))
        if kind < 0.89:
            return self.el("blockquote", k, r.choice([self.sentences(1, 4), self.el("p", k, self.sentences(1, 3))]))
        if kind < 0.92:
            return self.el("pre", k, self.words(4, 30))
        if kind < 0.95:
            return self.el("table", k, "".join(self.el("tr", k, "".join(self.el("td", k, self.words(1, 4)) for _ in range(3))) for _ in range(r.randint(2, 5))))
        if kind < 0.97:
            return self.el("figure", k, self.el("img", k, "", 'src="/i"') + self.el("figcaption", k, self.words(3, 12)))
        return self.el("div", k, self.el("p", k, self.sentences(1, 6)))

    def page(self) -> str:
        r = self.r
        title = self.words(2, 12)
        parts = [self.el("h1", "k", title)] if r.random() < 0.9 else []
        for _ in range(r.randint(1, r.choice([2, 6, 25]))):
            parts.append(self.kept())
            if r.random() < 0.08:
                parts.append(self.dropped())
        if r.random() < 0.2:
            parts.append(self.dropped())
        style = r.random()
        tag = "article" if style < 0.5 else r.choice(["main", "div", "div", "section"])
        attrs = "" if tag in ("article", "main") and r.random() < 0.6 else self.name("content article post entry story article-body text main-content body-text post-content page-content")
        core = self.el(tag, "k", "".join(parts), attrs)
        for _ in range(r.choice([0, 0, 1, 2])):
            around = [self.dropped() if r.random() < 0.4 else "", core, self.dropped() if r.random() < 0.4 else ""]
            core = self.el(r.choice(["div", "main", "section", "div"]), "k", "".join(around), r.choice(["", self.name("wrapper container page row col layout main")]))
        before, after = ("".join(self.dropped() for _ in range(r.randint(0, 4))) for _ in range(2))
        head = self.el("head", "d", '<meta charset="utf-8">' + self.el("title", "d", title) + "<style>p{margin:0}</style><script>var t='</p>';</script>")
        return "<!DOCTYPE html>" + self.el("html", "k", head + self.el("body", "k", before + "<!-- x -->" + core + after))


def synthetic_page(seed: int) -> str:
    return _Writer(seed).page()


_ROLE = re.compile(r" data-role=([kd])")


@functools.cache
def trained(pages: int = PAGES) -> Trees:
    """Trees learned from that many synthetic pages; the same in every run."""
    parsed, labels = [], []
    for seed in range(pages):
        source = synthetic_page(seed)
        roles = [1]  # the page itself
        for t in _TOKEN.finditer(source):
            if t[3] and not t[2]:
                m = _ROLE.search(t[4])
                roles.append(-1 if m is None else int(m[1] == "k"))
        parsed.append(parse(_ROLE.sub("", source)))
        labels += roles
    x, y = features(parsed), np.array(labels)
    x, y = x[y >= 0], y[y >= 0]
    return boost(x, y.astype(float))


def keep(page: Page, odds: list[float]) -> list[bool]:
    """The consistent set of elements of the largest total odds."""
    best, parent = list(odds), page.parent
    for i in range(len(parent) - 1, 0, -1):
        if best[i] > 0:
            best[parent[i]] += best[i]
    kept = [True] * len(parent)
    for i in range(1, len(parent)):
        kept[i] = kept[parent[i]] and best[i] > 0
    return kept


def extract(sources: list[str], trees: Trees) -> list[str]:
    """The main text of each page."""
    pages = [parse(s) for s in sources]
    if not pages:
        return []
    odds, at, out = trees.odds(features(pages)).tolist(), 0, []
    for page in pages:
        n = len(page.parent)
        kept = keep(page, odds[at : at + n])
        at += n
        blocks: dict[int, list[str]] = {}
        for node, block, text in page.texts:
            if kept[node]:
                blocks.setdefault(block, []).append(text)
        joined = (" ".join("".join(parts).split()) for parts in blocks.values())
        out.append("\n\n".join(x for x in joined if x))
    return out


def extract_pages(pages: DataFrame, trees: Trees | None = None) -> DataFrame:
    """page_id, url and text of each row of pages (page_id, url, html)."""
    bound_batches(pages.sparkSession)
    trees = trees or trained()

    def run(batches):
        for batch in batches:
            column = batch.column("html")
            sizes = np.asarray(pa.compute.binary_length(column).fill_null(0), np.int64)
            for lo, hi in slices(sizes, 1 << 20):
                texts = extract([x or "" for x in column.slice(lo, hi - lo).to_pylist()], trees)
                yield pa.RecordBatch.from_arrays([batch.column("page_id").slice(lo, hi - lo), batch.column("url").slice(lo, hi - lo), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", "url", "html").mapInArrow(run, f"page_id {kind}, url string, text string")
