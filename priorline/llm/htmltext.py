"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_texts, map_batches, type_of

# fixed values: element names of HTML, and the words by which page parts are named
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "s", "samp",
          "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
ASIDE = {"aside", "button", "canvas", "dialog", "footer", "form", "header", "iframe", "menu", "nav", "noscript", "object", "option", "script", "select", "style", "svg",
         "template", "textarea", "title", "head"}
ASIDE_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "form", "toolbar"}
ASIDE_NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "adbox", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "commentlist", "respond", "disqus", "consent",
               "cookie", "cookies", "gdpr", "footer", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "overlay", "popup", "promo",
               "promotion", "related", "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
NAME_PARTS = {"area", "bar", "block", "body", "bottom", "box", "buttons", "container", "fixed", "form", "global", "icons", "inner", "item", "items", "left", "link", "links", "list", "main",
              "media", "page", "panel", "posts", "primary", "right", "secondary", "section", "site", "sticky", "text", "thread", "top", "wrap", "wrapper"}
HEADS = {"article", "entry", "post", "story", "title"}  # before "header": the heading of a text
MAIN = {"article", "main"}
MAIN_ASIDE = {"header"}  # an article's own header holds its heading
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
LISTS = {"ul", "ol", "dl", "menu"}
# elements of running text; any other block can hold a part of the page
FLOW = {"p", "blockquote", "pre", "address", "figure", "figcaption", "li", "dt", "dd", "table", "caption", "thead", "tbody", "tfoot", "tr", "td", "th"} | HEADINGS | LISTS
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
ENDS_PARAGRAPH = {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "menu",
                  "nav", "ol", "p", "pre", "section", "table", "ul"}
SIGMA = 1.0  # lines, of the smoothing
REACH = 3


class Line(NamedTuple):
    text: str
    tags: int  # seen since the line before
    beside: bool  # in a part that is named as not being main text
    box: int  # the block that the line's running text stands in
    main: int  # the outermost article, else the outermost main element, else -1
    menu: int  # the outermost list of the box, -1 outside of lists
    linked: bool  # all of it is links
    links: int
    heading: bool


def names_aside(value: str) -> bool:
    """Whether one class or id names a part beside the main text.

    The whole name counts: "cookie-banner" and "site-header" are made of such words only; "no-sidebar", "social-science" and
    "post-header" are not.
    """
    parts = [w for w in re.split("[-_]+", value) if w]
    hits = [w for w in parts if w in ASIDE_NAMES]
    return bool(hits) and all(w in ASIDE_NAMES or w in NAME_PARTS or w.isdigit() for w in parts)


class Lines(HTMLParser):
    """Turns a page's events into lines: a line is the text of one block and the number of tags seen since the line before.

    ``unclosed`` are the numbers of elements beside the main text that a first reading found without an end tag: an article
    that starts inside of one ends it.
    """

    def __init__(self, unclosed: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.unclosed = unclosed
        self.stack: list[tuple[str, bool, int]] = []  # open elements, whether each is beside the main text, and their numbers
        self.open: Counter[str] = Counter()  # their names
        self.boxes, self.mains, self.articles = [-1], [], []  # numbers of the open ones
        self.menus: list[tuple[int, int]] = []  # lists with the box that each stands in
        self.beside = 0
        self.number = 0
        self.suspects: set[int] = set()  # open elements that an article began in
        self.left_open: set[int] = set()
        self.read_main = False
        self.lines: list[Line] = []
        self.words: list[str] = []
        self.tags = self.links = self.plain = self.heading = 0

    def end_line(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            box = self.boxes[-1]
            main = self.articles[0] if self.articles else self.mains[0] if self.mains else -1
            menu = next((number for number, at in self.menus if at == box), -1)
            self.lines.append(Line(text, self.tags, self.beside > 0, box, main, menu, not self.plain, self.links, bool(self.heading)))
            self.tags = 0
        self.words = []
        self.links = self.plain = self.heading = 0

    def drop(self, keep: int, ended: bool = False) -> None:
        """Close the elements from ``keep`` on; the first of them by its end tag if ``ended``."""
        while len(self.stack) > keep:
            name, beside, number = self.stack.pop()
            self.open[name] -= 1
            self.beside -= beside
            if number in self.suspects and not (ended and len(self.stack) == keep):
                self.left_open.add(number)
            for kind in (self.boxes, self.mains, self.articles):
                if kind and kind[-1] == number:
                    kind.pop()
            if self.menus and self.menus[-1][0] == number:
                self.menus.pop()

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        elif tag == "br":
            self.words.append(" ")
        if tag in VOID:
            return
        if tag == "a" and self.open["a"]:
            self.handle_endtag("a")
            self.tags -= 1
        values = dict(attrs)
        names = f"{values.get('class') or ''} {values.get('id') or ''}".lower().split()
        named = [n for n in names if names_aside(n)]
        if tag in MAIN and self.beside and not self.read_main and not (tag == "article" and named):
            # what was left open before the main text ends here
            self.suspects.update(number for _, beside, number in self.stack if beside)
            first = next((k for k, (_, beside, number) in enumerate(self.stack) if beside and number in self.unclosed), None)
            if first is not None and not any(beside for _, beside, _ in self.stack[:first]):
                self.drop(first)
        if tag in ENDS_PARAGRAPH or tag in CLOSES:
            shut = {"p"} if tag in ENDS_PARAGRAPH else CLOSES[tag]
            for k in range(len(self.stack) - 1, -1, -1):
                name = self.stack[k][0]
                if name in shut:
                    self.drop(k)
                    break
                if name not in INLINE and name not in CLOSES:
                    break
        inside = bool(self.mains or self.articles)
        heads = any("header" in n and not HEADS.isdisjoint(re.split("[-_]+", n)) for n in names)
        beside = ((tag in ASIDE and not (tag in MAIN_ASIDE and (inside or heads)))
                  or (tag not in ("html", "body", "main") and any(not (inside and n == "header") for n in named))
                  or (tag not in MAIN and tag not in ("html", "body") and (values.get("role") or "").lower() in ASIDE_ROLES)
                  or (tag not in ("html", "body") and ("hidden" in values or values.get("aria-hidden") == "true")))
        self.number += 1
        self.stack.append((tag, beside, self.number))
        self.open[tag] += 1
        self.beside += beside
        if tag in LISTS:
            self.menus.append((self.number, self.boxes[-1]))
        if tag not in FLOW and tag not in INLINE:
            self.boxes.append(self.number)
        if tag in MAIN and not self.beside:
            (self.articles if tag == "article" else self.mains).append(self.number)
            self.read_main = True
        if tag in HEADINGS:
            self.heading = 1
        if tag == "a":
            self.links += 1

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        if self.open[tag]:
            k = len(self.stack) - 1
            while self.stack[k][0] != tag:
                k -= 1
            self.drop(k, True)

    def handle_data(self, data):
        self.words.append(data)
        if not self.open["a"] and any(c.isalnum() for c in data):
            self.plain = 1

    def close(self):
        # a comment, declaration or tag that the page ends in is markup, not text, and is read once, not again from each "<"
        if self.rawdata.startswith(("<!--", "<?")) or (self.rawdata.startswith("<") and ">" not in self.rawdata and self.cdata_elem is None and self.rawdata[1:2].isalpha()):
            self.rawdata = ""
        super().close()
        self.end_line()
        self.drop(0)


def smooth(ratio: np.ndarray, sigma: float = SIGMA, reach: int = REACH) -> np.ndarray:
    weight = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    return np.convolve(np.pad(ratio, reach), weight / weight.sum(), "valid")


def read_lines(html: str) -> list[Line]:
    parser = Lines()
    parser.feed(html)
    parser.close()
    if parser.left_open:
        parser = Lines(frozenset(parser.left_open))
        parser.feed(html)
        parser.close()
    return parser.lines


def menu_lines(lines: list[Line]) -> list[bool]:
    """Which lines belong to a menu that nothing names: a list, or a line of several links, that consists of links.

    Outside of main elements it is a menu unless running text of the same block stands before and after it; inside, if no other
    text stands before it.
    """
    groups: list[tuple[int, int]] = []  # first and last line of each run of one list, or single line
    for k, line in enumerate(lines):
        if groups and line.menu >= 0 and lines[k - 1].menu == line.menu and not line.beside and not lines[k - 1].beside:
            groups[-1] = groups[-1][0], k
        else:
            groups.append((k, k))
    menu = [False] * len(lines)
    linked = [not lines[i].beside and all(lines[k].linked for k in range(i, j + 1)) and (lines[i].menu >= 0 or lines[i].links > 1) for i, j in groups]
    text = [k for g, (i, j) in enumerate(groups) if not linked[g] for k in range(i, j + 1) if not lines[k].beside]
    firsts: dict[tuple[str, int], int] = {}
    lasts: dict[tuple[str, int], int] = {}
    for k in text:
        for key in (("box", lines[k].box), ("main", lines[k].main)):
            firsts.setdefault(key, k)
            lasts[key] = k
    for g, (i, j) in enumerate(groups):
        if linked[g]:
            if lines[i].main >= 0:
                kept = firsts.get(("main", lines[i].main), len(lines)) < i
            else:
                kept = firsts.get(("box", lines[i].box), len(lines)) < i and lasts.get(("box", lines[i].box), -1) > j
            menu[i:j + 1] = [not kept] * (j + 1 - i)
    return menu


def main_text(html: str) -> str:
    """The text of the content regions, one block a line.

    Lines of page parts that are named as such, and unnamed menus, have ratio 0 and part the rest into regions; so do the bounds
    of main elements.  The smoothed ratios are split at their standard deviation; a region with a line above it is content as a
    whole, so that its short lines stay.  So is a region in the same block or the same article as one, as short paragraphs
    after an advert are, and a heading inside a main element.  Where a main element holds content, what is outside of them is none.
    """
    lines = read_lines(html)
    if not lines:
        return ""
    out = [line.beside or menu for line, menu in zip(lines, menu_lines(lines))]
    ratio = np.array([0.0 if o else len(line.text) / max(line.tags, 1) for line, o in zip(lines, out)])
    level = smooth(ratio)
    bar = min(float(level.std()), float(level.max()))
    regions: list[list[int]] = []
    for k, line in enumerate(lines):
        if out[k]:
            continue
        if regions and regions[-1][-1] == k - 1 and lines[k - 1].main == line.main:
            regions[-1].append(k)
        else:
            regions.append([k])
    content = [r for r in regions if level[r].max() >= bar]
    inside = any(lines[r[0]].main >= 0 for r in content)
    content = [r for r in content if lines[r[0]].main >= 0 or not inside]
    boxes, mains = {lines[k].box for r in content for k in r}, {lines[r[0]].main for r in content if inside}

    def kept(k: int) -> bool:
        line = lines[k]
        return line.main in mains or (line.box in boxes if not inside else line.main >= 0 and (line.box in boxes or line.heading))

    whole = {r[0] for r in content}
    return "\n".join(lines[k].text for r in regions for k in r if r[0] in whole or kept(k))


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of ``pages``, in its partition; nothing is shuffled.

    A null or empty page and one without content have the empty text.  Character references are decoded, markup left open is closed as
    browsers do, white space inside a block becomes one space.  Repeated rows give equal texts; an empty table gives no rows.
    """

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [main_text(h) for h in arrow_texts(batch.column(2))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                          ["page_id", "url", "text", "n_chars"])

    base = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return map_batches(base, run, f"page_id {type_of(pages, id_col)}, url string, text string, n_chars long")
