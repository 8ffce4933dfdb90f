"""Operator 13: the main text of web pages, by ratios of tag paths.

Every block of text of a page has a root-to-leaf path of tags with their classes. For each path
the lengths, punctuation marks, link characters and numbers of its blocks are added up; their
ratios are fused into one score a path: mean length times mean punctuation, less what is links.
In page order the scores of the blocks are smoothed with a Gaussian, and paths whose smoothed score lies
above a threshold (the standard deviation over the page), and whose own score is not far below
the best path's, are content paths. A page's content is the container that holds them: the article or main element where markup names one,
otherwise the deepest element with most of the score. Inside it all blocks stay, so that short
paragraphs and headings of a good container are not lost; lists of short links go.

Markup that says what it is goes before any ratio: elements for menus, headers (outside of an
article), footers, sidebars, forms, scripts and styles, hidden elements, and elements whose
class or id names such a part, an advert, a notice or reader comments (word lists below).

The parser is tolerant: end tags may be missing, wrong or cut off, the page may end anywhere.
An open paragraph ends where a block starts, marks like <b> end with their block, a comment or
script without end goes to the end of the page. Each page is worked on alone, in time about
proportional to its length, whatever its nesting.

Nulls: null html is an empty page, with an empty text; null ids and urls pass through. Repeated
rows give repeated rows; only the three columns are read. Empty tables give none.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrowtext import per_slice, strings

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
    footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary
    table tbody td tfoot th thead tr ul""".split())
#: Elements that end an open one of these without an end tag, up to the element that bounds them.
SIBLINGS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("tbody", "thead", "tfoot", "table")),
    "tbody": (("tbody", "thead", "tfoot"), ("table",)), "thead": (("tbody", "thead", "tfoot"), ("table",)), "tfoot": (("tbody", "thead", "tfoot"), ("table",)),
    "option": (("option",), ("select", "optgroup")),
}
IN_HEAD = frozenset("base basefont bgsound link meta noscript script style template title".split())
CELLS = frozenset("td th caption".split())
#: Elements that are no main text wherever they stand.
NO_TEXT = frozenset("""head nav footer aside form script style noscript template iframe noembed noframes xmp textarea title select button datalist
    menu dialog svg canvas object audio video search""".split())
#: Words of class and id names of parts that are no main text.
NO_TEXT_NAMES = frozenset("""ad ads adv advert adverts advertisement advertisements advertising adsense adslot alert banner breadcrumb breadcrumbs
    comment comments commentlist consent cookie cookies copyright disclaimer discussion disqus footer gdpr header login masthead menu menus modal
    nav navbar navigation newsletter notice notices outbrain overlay pager pagination popup promo promos promoted promotion recommendation
    recommendations recommended related replies reply respond share sharebar sharing sidebar sidebars signup social sponsor sponsored sponsors
    subscribe subscription taboola toolbar topbar""".split())
#: Words that say so only at the start of a name (page builders end the names of all blocks with them).
NO_TEXT_STARTS = frozenset("widget widgets".split())
NO_TEXT_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar toolbar dialog alert alertdialog form".split())
#: Names that start so speak of the page's state, not of the element.
STATES = frozenset("has with no is without hide show not".split())
#: A header with one of these in its name belongs to the text.
OF_TEXT = frozenset("article post entry story section content".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PUNCTUATION = re.compile("[,.;:!?\"'()，。、；：！？…–—]")
#: Open elements at most; deeper ones only part blocks, as in browsers.
MOST_OPEN = 512
#: Width of the Gaussian, in blocks, and its reach.
SIGMA, REACH = 1.0, 3
#: Share of the best path's score that a content path has at least.
LEAST_RATIO = 0.15

_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)|(!--)|[!?/])")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>]|\Z)", re.I) for t in RAW}


def _attributes(text: str) -> dict[str, str]:
    found = {}
    for m in _ATTRIBUTE.finditer(text):
        value = m.group(2) or ""
        found.setdefault(m.group(1).lower(), html.unescape(value[1:-1] if value[:1] in "\"'" else value))
    return found


def _named_away(names: str, in_text: bool) -> bool:
    """Whether a class or id says that an element is no main text."""
    for name in names.split():
        words = [w.lower() for w in _NAME.findall(name)]
        if not words or words[0] in STATES:
            continue
        if words[0] in NO_TEXT_STARTS:
            return True
        for w in words:
            if w in NO_TEXT_NAMES and not (w == "header" and (in_text or OF_TEXT.intersection(words))):
                return True
    return False


class Element:
    """An open element: its place in the tree of paths and what it says about its text."""

    __slots__ = ("tag", "path", "away", "link", "article", "main")

    def __init__(self, tag, path, away, link, article, main):
        self.tag, self.path, self.away, self.link, self.article, self.main = tag, path, away, link, article, main


class Page:
    """The blocks of a page: text, path, link characters, nearest article and main element."""

    def __init__(self, source: str):
        self.paths: dict[tuple[int, str], int] = {}
        self.parents: list[int] = []
        self.tags: list[str] = []
        self.blocks: list[tuple[str, int, int, int, bool]] = []
        self.articles = 0
        self.pieces: list[str] = []
        self.linked = 0
        self.stack = [Element("", self._path(-1, ""), False, False, 0, False)]
        self.open: dict[str, int] = {}
        self.flat: dict[str, int] = {}
        self._read(source)
        self._end_block()

    def _path(self, parent: int, name: str) -> int:
        key = (parent, name)
        if key not in self.paths:
            self.paths[key] = len(self.parents)
            self.parents.append(parent)
            self.tags.append(name.partition(".")[0])
        return self.paths[key]

    def _end_block(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                top = next(e for e in reversed(self.stack) if e.tag in BLOCK or not e.tag)
                self.blocks.append((text, top.path, min(self.linked, len(text)), top.article, top.main))
            self.pieces, self.linked = [], 0

    def _pop(self) -> None:
        e = self.stack[-1]
        if e.tag in BLOCK:
            self._end_block()
        self.stack.pop()
        self.open[e.tag] -= 1

    def _close(self, wanted: tuple[str, ...], bounds) -> None:
        """Close the nearest open element of these tags, if no bound lies before it."""
        if not any(self.open.get(t) for t in wanted):
            return
        for k in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[k].tag
            if tag in wanted:
                while len(self.stack) > k:
                    self._pop()
                return
            if tag in bounds:
                return

    def _start(self, tag: str, attributes: str) -> None:
        if self.open.get("head") and tag not in IN_HEAD and tag not in ("html", "head"):
            self._close(("head",), ())
        if tag in BLOCK:
            # marks end with the block they stand in, an open paragraph ends here
            while self.stack[-1].tag and self.stack[-1].tag not in BLOCK and self.stack[-1].tag not in NO_TEXT:
                self._pop()
            if self.stack[-1].tag == "p":
                self._pop()
            if tag in SIBLINGS:
                self._close(*SIBLINGS[tag])
            elif tag in HEADINGS and self.stack[-1].tag in HEADINGS:
                self._pop()
            self._end_block()
        if tag in VOID:
            self.pieces.append(" ")
            return
        if len(self.stack) > MOST_OPEN:
            self.flat[tag] = self.flat.get(tag, 0) + 1
            return
        top = self.stack[-1]
        a = _attributes(attributes) if attributes else {}
        names = " ".join((a.get("class", ""), a.get("id", "")))
        in_text = bool(top.article) or top.main
        role = a.get("role", "").lower()
        whole = tag in ("html", "body", "main")
        away = top.away or tag in NO_TEXT or (tag == "header" and not in_text) or "hidden" in a or "display:none" in a.get("style", "").replace(" ", "").lower() or (
            not whole and (role in NO_TEXT_ROLES or (names.strip() != "" and _named_away(names, in_text))))
        main = top.main or tag == "main" or role == "main" or a.get("itemprop") == "articleBody"
        article = top.article
        if not article and not away and (tag == "article" or role == "article"):
            self.articles += 1
            article = self.articles
        link = top.link or tag == "a"
        # the path goes by blocks and their classes; marks inside a block are not parts of it
        path = self._path(top.path, f"{tag}.{' '.join(sorted(a.get('class', '').split()))}") if tag in BLOCK else top.path
        self.stack.append(Element(tag, path, away, link, article, main))
        self.open[tag] = self.open.get(tag, 0) + 1

    def _finish(self, tag: str) -> None:
        if self.flat.get(tag):
            self.flat[tag] -= 1
            if tag in BLOCK:
                self._end_block()
            return
        if tag in ("br", "p") and not self.open.get(tag):
            self._end_block() if tag == "p" else self.pieces.append(" ")
            return
        if not self.open.get(tag) or tag in ("html", "body"):
            return
        if tag in BLOCK:
            self._close((tag,), () if tag in ("table", "td", "th", "tr", "caption") or tag not in CELLS and not any(self.open.get(c) for c in CELLS) else CELLS)
        else:
            self._close((tag,), BLOCK)

    def _text(self, text: str) -> None:
        top = self.stack[-1]
        if not text or top.away or top.tag == "html" and self.open.get("head"):
            return
        text = html.unescape(text) if "&" in text else text
        self.pieces.append(text)
        if top.link:
            self.linked += len(" ".join(text.split()))

    def _read(self, source: str) -> None:
        at, size = 0, len(source)
        while at < size:
            m = _TAG.search(source, at)
            if m is None:
                self._text(source[at:])
                return
            self._text(source[at:m.start()])
            closing, tag, comment = m.groups()
            if comment:
                # "<!-->" and "<!--->" are whole comments
                end = source.find("-->", m.end() - 2)
                at = size if end < 0 else end + 3
                continue
            if tag is None:
                if source.startswith("<![CDATA[", m.start()):
                    end = source.find("]]>", m.end())
                    self._text(source[m.start() + 9:size if end < 0 else end].replace("&", "&amp;"))
                    at = size if end < 0 else end + 3
                else:
                    end = source.find(">", m.end())
                    at = size if end < 0 else end + 1
                continue
            end = _ATTRIBUTES.match(source, m.end()).end()
            if end < size and source[end] != ">":
                end = source.find(">", end)
            if end < 0 or end >= size:
                return  # a tag that is cut off is no text
            attributes, at, tag = source[m.end():end], end + 1, tag.lower()
            if closing:
                self._finish(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW:
                over = _RAW_END[tag].search(source, at)
                self._finish(tag)
                if over is None:
                    return
                end = source.find(">", over.end())
                at = size if end < 0 else end + 1


def path_scores(page: Page) -> tuple[np.ndarray, np.ndarray]:
    """The score of every block's path, from the ratios of its sums, and the same smoothed in page order."""
    lengths = np.array([len(b[0]) for b in page.blocks], float)
    marks = np.array([len(PUNCTUATION.findall(b[0])) for b in page.blocks], float)
    links = np.array([b[2] for b in page.blocks], float)
    path = np.array([b[1] for b in page.blocks])
    n = np.maximum(np.bincount(path), 1)
    length, mark, link = (np.bincount(path, w) for w in (lengths, marks, links))
    ratio = length / n * (1 + mark / n) * (1 - link / np.maximum(length, 1))
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(path)), kernel, "full")[REACH:-REACH]
    return ratio[path], np.convolve(ratio[path], kernel, "full")[REACH:-REACH] / weight


def _container(page: Page, mass: dict[int, float]) -> int:
    """The deepest path that holds at least two thirds of the score of the content blocks' parents."""
    total = dict.fromkeys(range(len(page.parents)), 0.0)
    children: dict[int, list[int]] = {}
    # a block's own element is a leaf; containers are what is above it
    for path, m in mass.items():
        total[max(page.parents[path], 0)] += m
    for path in range(len(page.parents) - 1, 0, -1):
        # parents are numbered before their children
        total[page.parents[path]] += total[path]
        children.setdefault(page.parents[path], []).append(path)
    at, wanted = 0, total[0] * 2 / 3
    while True:
        down = next((c for c in children.get(at, ()) if total[c] >= wanted), None)
        if down is None or total[down] <= 0:
            return at
        at = down


def content_blocks(page: Page) -> list[int]:
    """Numbers of the blocks that are main text."""
    if not page.blocks:
        return []
    ratios, scores = path_scores(page)
    share: dict[int, list[int]] = {}
    for k, (text, path, linked, _, _) in enumerate(page.blocks):
        links = share.setdefault(path, [0, 0, 0, 0])
        for i, x in enumerate((1, len(text), linked, text.count(" ") + 1)):
            links[i] += x

    def link_list(k: int) -> bool:
        n, length, linked, words = share[page.blocks[k][1]]
        return page.tags[page.blocks[k][1]] == "li" and n >= 3 and linked >= 0.9 * length and words <= 4 * n

    everything = range(len(page.blocks))
    articles = [k for k in everything if page.blocks[k][3]]
    mains = [k for k in everything if page.blocks[k][4]]
    headed = any("h1" == page.tags[page.blocks[k][1]] for k in articles)
    if articles and (page.articles == 1 or headed or scores[articles].sum() >= 0.3 * scores.sum()):
        of = {}
        for k in articles:
            of[page.blocks[k][3]] = of.get(page.blocks[k][3], 0.0) + scores[k]
        # the articles whose score stands beside that of the best: one text, or parts of one
        kept = {a for a, s in of.items() if s >= 0.3 * max(of.values())}
        return [k for k in articles if page.blocks[k][3] in kept and not link_list(k)]
    if mains:
        return [k for k in mains if not link_list(k)]
    content = {page.blocks[k][1] for k in everything if scores[k] >= scores.std() and ratios[k] >= LEAST_RATIO * ratios.max() and not link_list(k)}
    best: dict[int, float] = {}
    for k in everything:
        if page.blocks[k][1] in content:
            best[page.blocks[k][1]] = best.get(page.blocks[k][1], 0.0) + scores[k]
    if not best:
        return []
    box = _container(page, best)
    inside = np.zeros(len(page.parents), bool)
    inside[box] = True
    for path in range(box + 1, len(page.parents)):
        inside[path] = inside[page.parents[path]]
    chosen = [k for k in everything if page.blocks[k][1] in content and inside[page.blocks[k][1]]]
    if not chosen:
        return []
    first, last = chosen[0], chosen[-1]
    while first > 0 and page.tags[page.blocks[first - 1][1]] in HEADINGS:
        first -= 1
    return [k for k in range(first, last + 1) if (inside[page.blocks[k][1]] or page.tags[page.blocks[k][1]] in HEADINGS) and not link_list(k)]


def main_text(source: str) -> str:
    """The main text of one page: its blocks in page order, joined by an empty line."""
    page = Page(source)
    return "\n\n".join(page.blocks[k][0] for k in content_blocks(page))


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: id, url, text, n_chars (code points)."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in (id_col, url_col)}

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(s) for s in strings(batch.column(2))]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                [id_col, url_col, "text", "n_chars"])

        return work

    rows = pages.select(id_col, url_col, html_col)
    return rows.mapInArrow(per_slice(make, html_col), f"`{id_col}` {kinds[id_col]}, `{url_col}` {kinds[url_col]}, text string, n_chars long")
