"""Main text of web pages: flat blocks, each kept or left by a decision tree.

A page is read once, from left to right, into blocks of text between the tags
of block elements.  A block's features are its words and link density, those of
the blocks before and after it, and where it stands: in which element, below
which containers, after which words of their classes.  The tree is grown on a
small table of labelled blocks (``html_labels``) and applied to a batch's blocks
at once.
"""

from __future__ import annotations

import re
from bisect import bisect
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark.llm.common import carrying
from tidemark.llm.html_labels import LABELLED, filled

BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section "
    "select summary table caption colgroup tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
#: Their content is not markup; what it holds up to the end tag is no text of the page.
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
#: Elements around which a block does not end and that need no place on the stack.
INLINE = frozenset("abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q rb rp rt rtc ruby s samp small strike strong sub sup time tt u var".split())
#: What a start tag closes if it is open, up to the element in the second place.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")),
    "option": (("option",), ("select", "datalist")), "optgroup": (("option", "optgroup"), ("select",)),
}
NO_PARAGRAPH = BLOCK - frozenset("body colgroup dd dt frameset head html legend li optgroup option select caption tbody td tfoot th thead tr".split())

#: Parts of a page by element, and by words in class, id and role.
HINTS = ("menu", "header", "footer", "side", "notice", "advert", "form", "comment", "hidden")
_BY_TAG = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "side", "dialog": "notice", "form": "form", "search": "form",
    "select": "form", "button": "form", "datalist": "form", "fieldset": "form", "label": "form", "option": "form", "noscript": "hidden",
    "template": "hidden", "svg": "hidden", "math": "hidden", "canvas": "hidden", "audio": "hidden", "video": "hidden", "object": "hidden",
    "head": "hidden",
}
_BY_WORD = {
    word: hint
    for hint, words in {
        "menu": "nav navbar navigation menu breadcrumb breadcrumbs pagination pager tabs toolbar skip skiplink share sharing social tags",
        "header": "header masthead topbar banner",
        "footer": "footer copyright colophon legal contentinfo",
        "side": "sidebar aside related recommended recommendations trending popular widget widgets rail complementary",
        "notice": "cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription paywall toast",
        "advert": "ad ads advert adverts advertisement advertisements advertising adsense adsbygoogle sponsor sponsored promo promotion promoted",
        "form": "form login signin signup search searchbox",
        "comment": "comment comments commentlist disqus respond replies reviews discussion",
        "hidden": "hidden invisible",
    }.items()
    for word in words.split()
}
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')|[="'])*+)>""")
_ATTRIBUTE = re.compile(r"""(?<![^\s"'/])(class|id|role|hidden|style|aria-hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?(?=[\s/>]|$)""", re.I)
_MAIN = re.compile(r"""\brole\s*=\s*["']?main\b|\bitemprop\s*=\s*["']?articleBody\b""", re.I)
_DISPLAYED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_WORD = re.compile(r"[a-z]+")
_SAYING = frozenset("has have is no not with without".split())  # a class of these speaks of other elements
DEEPEST = 512  # elements nested more deeply are passed over, their text is not
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
FEATURES = (
    "words", "link_density", "words_before", "density_before", "words_after", "density_after", "heading", "listed", "main",
    "main_on_page", "hints", *HINTS,
)


@dataclass
class _Open:
    """An element on the stack: what held before it is put back when it closes."""

    tag: str
    hints: frozenset
    main: int
    link: bool
    around: tuple | None = None  # the unfinished block around an element of its own inside a line


@dataclass
class Page:
    """Blocks of a page: texts and, in the same order, rows of what the features need."""

    texts: list[str] = field(default_factory=list)
    rows: list[tuple] = field(default_factory=list)
    has_main: bool = False


def _hints(tag: str, attributes: str) -> frozenset:
    found = {_BY_TAG[tag]} if tag in _BY_TAG else set()
    if tag in ("html", "body"):  # their classes speak of the page
        return frozenset(found)
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id", "role"):
            for each in value.split():
                words = _WORD.findall(_CAMEL.sub(" ", each).lower())
                if _SAYING.isdisjoint(words):
                    found.update(_BY_WORD[w] for w in words if w in _BY_WORD)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _DISPLAYED.search(value):
            found.add("hidden")
    return frozenset(found)


class _Reader:
    """One pass over a page's markup."""

    def __init__(self):
        self.page, self.stack, self.count = Page(), [], {}
        self.hints, self.main, self.link = frozenset(), 0, False
        self.parts, self.linked = [], 0

    def text(self, raw: str) -> None:
        if raw:
            raw = unescape(raw) if "&" in raw else raw
            self.parts.append(raw)
            size = len(raw.split()) if self.link else 0
            self.linked += size

    def flush(self) -> None:
        """The block that ends here, if it holds more than white space."""
        words = "".join(self.parts).split()
        if words:
            tag = next((o.tag for o in reversed(self.stack) if o.tag in BLOCK), "")
            listed = any(self.count.get(t) for t in ("li", "td", "th"))
            self.page.texts.append(" ".join(words))
            self.page.rows.append((len(words), min(1.0, self.linked / len(words)), tag in ("h1", "h2", "h3", "h4", "h5", "h6", "hgroup"), listed, self.main, self.hints))
        self.parts, self.linked = [], 0

    def open(self, tag: str, attributes: str) -> None:
        if tag in BLOCK:
            self.flush()
        elif tag == "br":
            self.parts.append(" ")
        if tag in VOID or tag in INLINE:
            return
        if tag == "a":
            self.link = True
            return
        if tag in NO_PARAGRAPH and self.count.get("p"):
            self.close("p", ("table", "td", "th", "button", "object"))
        if tag in CLOSES:
            closed, within = CLOSES[tag]
            for name in closed:
                if self.count.get(name):
                    self.close(name, within)
        if len(self.stack) >= DEEPEST:
            return
        found = _hints(tag, attributes)
        apart = tag not in BLOCK and found - self.hints
        self.stack.append(_Open(tag, self.hints, self.main, self.link, (self.parts, self.linked) if apart else None))
        self.count[tag] = self.count.get(tag, 0) + 1
        if apart:
            self.parts, self.linked = [], 0
        is_main = tag in ("article", "main") or _MAIN.search(attributes)
        if is_main and not (found | self.hints) - {"menu", "form"}:
            self.main, self.hints, self.page.has_main = self.main + 1, frozenset(), True
        else:
            self.hints = self.hints | found

    def close(self, tag: str, within: tuple = ()) -> None:
        """Closes the last open ``tag`` and what is open inside it, unless one of ``within`` was opened later."""
        if not self.count.get(tag):
            return
        for o in reversed(self.stack) if within else ():
            if o.tag == tag:
                break
            if o.tag in within:
                return
        done = False
        while not done:
            o = self.stack[-1]
            if o.tag in BLOCK or o.around is not None:
                self.flush()
            self.stack.pop()
            self.count[o.tag] -= 1
            self.hints, self.main, self.link = o.hints, o.main, o.link
            if o.around is not None:
                self.parts, self.linked = o.around
            done = o.tag == tag

    def read(self, html: str) -> Page:
        at, size, last, quotes = 0, len(html), html.rfind(">"), True
        lower = None
        while at < size:
            lt = html.find("<", at)
            if lt < 0 or lt > last:  # no tag ends from here on
                self.text(html[at:])
                break
            self.text(html[at:lt])
            after = html[lt + 1 : lt + 2]
            if html.startswith("<!--", lt):
                end = html.find("-->", lt + 2)
                at = size if end < 0 else end + 3
                continue
            name_at = html[lt + 2 : lt + 3] if after == "/" else after
            if not (name_at.isascii() and name_at.isalpha()):
                if after in ("!", "?", "/") and after:
                    at = html.find(">", lt) + 1  # a declaration, or an odd comment
                else:
                    self.text("<")
                    at = lt + 1
                continue
            match = _TAG.match(html, lt) if quotes else None
            if match is None:  # a quote that never ends: tags end at the next sign from here on
                quotes = False
                end = html.find(">", lt)
                piece = html[lt + 1 : end]
                shut, piece = piece.startswith("/"), piece.lstrip("/")
                tag = re.match(r"[^\s/]*", piece)[0].lower()
                attributes, at = piece[len(tag) :], end + 1
            else:
                shut, tag, attributes, at = match[1], match[2].lower(), match[3], match.end()
            if shut:
                if tag == "a":
                    self.link = False
                elif tag == "p" and not self.count.get("p"):
                    self.flush()
                elif tag not in INLINE:
                    if tag in BLOCK:
                        self.flush()
                    self.close(tag)
                continue
            if tag in RAW:
                lower = html.lower() if lower is None else lower
                if len(lower) != size:  # a letter whose lower case is longer
                    lower = html.translate({c: c + 32 for c in range(65, 91)})
                end = lower.find(f"</{tag}", at)
                end = html.find(">", end) if end >= 0 else -1
                at = size if end < 0 else end + 1
                continue
            self.open(tag, attributes)
        while self.stack:
            self.close(self.stack[-1].tag)
        self.flush()
        return self.page


def blocks(html: str | None) -> Page:
    """The blocks of a page; a null page is an empty one."""
    return _Reader().read(html or "")


def features(page: Page) -> np.ndarray:
    """A row of FEATURES for each block of a page."""
    n = len(page.rows)
    x = np.zeros((n, len(FEATURES)))
    if n:
        x[:, 0], x[:, 1] = [r[0] for r in page.rows], [r[1] for r in page.rows]
        x[1:, 2:4], x[:-1, 4:6] = x[:-1, :2], x[1:, :2]
        x[:, 6], x[:, 7], x[:, 8] = [r[2] for r in page.rows], [r[3] for r in page.rows], [r[4] > 0 for r in page.rows]
        x[:, 9] = page.has_main
        x[:, 10] = [bool(r[5]) for r in page.rows]
        for k, hint in enumerate(HINTS):
            x[:, 11 + k] = [hint in r[5] for r in page.rows]
    return x


@dataclass
class Tree:
    """A decision tree as arrays: a node sends a row to ``left`` if its feature is at most ``cut``; leaves have feature -1."""

    feature: list[int] = field(default_factory=list)
    cut: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    keep: list[bool] = field(default_factory=list)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Which rows to keep, one level of the tree after the other."""
        feature, cut, left, right, keep = map(np.array, (self.feature, self.cut, self.left, self.right, self.keep))
        node, rows = np.zeros(len(x), int), np.arange(len(x))
        while True:
            at = feature[node]
            inner = at >= 0
            if not inner.any():
                return keep[node]
            node = np.where(inner, np.where(x[rows, np.maximum(at, 0)] <= cut[node], left[node], right[node]), node)


def grow(x: np.ndarray, y: np.ndarray, *, depth: int = 12, least: int = 1) -> Tree:
    """A tree by the largest fall in Gini impurity; of equal cuts the one of the earliest feature and least value."""
    tree = Tree()

    def gini(ones, n):
        return 2 * ones * (n - ones) / np.maximum(n, 1)

    def node(rows: np.ndarray, level: int) -> int:
        me = len(tree.feature)
        for column, value in ((tree.feature, -1), (tree.cut, 0.0), (tree.left, -1), (tree.right, -1), (tree.keep, bool(y[rows].mean() >= 0.5) if len(rows) else False)):
            column.append(value)
        best = (gini(y[rows].sum(), len(rows)) - 1e-9, -1, 0.0)
        for f in range(x.shape[1]) if level < depth else ():
            order = rows[np.argsort(x[rows, f], kind="stable")]
            values, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(order))
            split = np.flatnonzero((values[1:] > values[:-1]) & (n >= least) & (len(order) - n >= least))
            if len(split):
                impure = gini(ones[split], n[split]) + gini(ones[-1] - ones[split], len(order) - n[split])
                k = int(np.argmin(impure))
                if impure[k] < best[0] - 1e-9:
                    best = (float(impure[k]), f, float(values[split[k]] + values[split[k] + 1]) / 2)
        if best[1] >= 0:
            tree.feature[me], tree.cut[me] = best[1], best[2]
            small = x[rows, best[1]] <= best[2]
            tree.left[me] = node(rows[small], level + 1)
            tree.right[me] = node(rows[~small], level + 1)
        return me

    node(np.arange(len(x)), 0)
    return tree


def train(labelled: tuple[str, ...] = LABELLED) -> Tree:
    """The tree of labelled pages: every block starts with ``+`` (keep) or ``-`` and the number of its words."""
    x, y = [], []
    for page in labelled:
        found = blocks(filled(page))
        x.append(features(found))
        y += [text.startswith("+") for text in found.texts]
    return grow(np.concatenate(x), np.array(y, dtype=float))


def main_texts(pages: list[str | None], tree: Tree) -> list[str]:
    """The main text of each page: the blocks that the tree keeps, joined by line ends."""
    read = [blocks(html) for html in pages]
    begins = np.concatenate(([0], np.cumsum([len(p.texts) for p in read]))).astype(int)
    keep = tree.predict(np.concatenate([features(p) for p in read])) if begins[-1] else []
    return ["\n".join(t for t, k in zip(p.texts, keep[a:b], strict=True) if k) for p, a, b in zip(read, begins[:-1], begins[1:], strict=True)]


def extract(pages: DataFrame, tree: Tree, *, html_col: str = "html", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """The columns ``keep`` of every page with ``text`` and ``n_chars``, its code points.

    Null and empty pages, and those with no block that the tree keeps, have the
    empty text.  A block ends where a block element begins or ends; a line
    break inside it is white space.  Character references are decoded once, all
    Unicode white space counts.  Broken markup is read as browsers do for what
    matters here: unclosed paragraphs, items and links end with what encloses
    them, a comment or script without an end takes the rest.  Very long pages
    are read whole, in time linear in their length.  Each page is read by
    itself: repeated rows, null ids and further columns of any name pass;
    an empty table stays empty.  ``keep`` may not name the columns that are added.
    """
    added = StructType([StructField("text", StringType()), StructField("n_chars", LongType())])

    def run(batches):
        for batch in batches:
            begin = 0
            for end in _cuts(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()):
                part, begin = batch.slice(begin, end - begin), end
                texts = main_texts(part.column("text").to_pylist(), tree)
                columns = [part.column("kept"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["kept", *added.names])

    return carrying(pages, html_col, keep, run, added)


def _cuts(sizes: np.ndarray, most: int = 1 << 22) -> list[int]:
    """Ends of runs of rows that hold some ``most`` bytes each, a longer row alone."""
    total, ends = np.cumsum(sizes, dtype=np.int64), [0]
    while ends[-1] < len(sizes):
        done = total[ends[-1] - 1] if ends[-1] else 0
        ends.append(max(ends[-1] + 1, bisect(total, done + most)))
    return ends[1:]
