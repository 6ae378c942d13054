"""Main text of HTML pages by text-to-tag ratios (operator 6).

Pages stream through the standard library's parser.  Its events make *lines*, one per
block element, each with its characters, tags and link characters.  The text-to-tag
ratio of the lines (characters per tag) is smoothed with a Gaussian; lines above the
threshold, the standard deviation of the smoothed ratios, are content.  A line's region is its
innermost sectioning element, but an outermost <article> or <main> is one region with all in it.
Regions most of whose characters are in content lines and that are not mostly links, and articles
with a content line, are selected whole, so a short paragraph between long ones stays.  Menus, page headers, footers, sidebars,
notices, adverts, forms, scripts, styles and reader comments are told by element or by the
names in class, id and role, and never make lines.  A name is a whole token or the head of a
compound ("site-header", "comment-list"), not a word in passing ("has-sidebar",
"content-sidebar-wrap").  <main> starts anew inside dropped elements that do not surely hold
something else, such as a form or a banner, or a layout named like a sidebar; <article> does
so too, but not inside what is named like a sidebar, an advert or related pages, whose articles
are teasers.

White space inside a line becomes one space, character references are decoded, and
lines are joined in page order by one newline.

Defined results: a null or empty page, and one without content, gives an empty text; text outside
of any element is a line of the page; unclosed and misnested elements end with the
element around them; a page cut in the middle of a tag loses that tag only; rows with a null
id or url stay; repeated rows are extracted each; other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIGMA, RADIUS = 1.0, 2
MOST_LINKS = 0.5

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
          "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "br", "ruby", "rt", "rp", "map", "area",
          "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "mstyle", "merror", "mpadded", "mphantom", "mfenced", "menclose",
          "msub", "msup", "msubsup", "munder", "mover", "munderover", "mmultiscripts", "mprescripts", "none", "mtable", "mtr", "mtd", "maction", "semantics",
          "annotation", "annotation-xml"}
SECTION = {"html", "body", "article", "main", "section", "div", "td", "ul", "ol", "table", "dl", "blockquote", "center"}
DROPPED = {"script", "style", "noscript", "template", "head", "title", "nav", "footer", "aside", "form", "iframe", "object", "svg", "canvas",
           "button", "select", "textarea", "input", "dialog", "menu", "video", "audio", "annotation", "annotation-xml"}
# Names in class, id or role of a part which is not the article.
NAMES = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "banner", "breadcrumb", "breadcrumbs", "byline", "comment", "comments",
         "complementary", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
         "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "replies", "search", "share", "sharing", "sidebar",
         "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget", "widgets"}
# Of these, names of parts in which no <article> and no <main> is the page's own, and those in which an <article> is a teaser.
SURE = {"breadcrumb", "breadcrumbs", "comment", "comments", "contentinfo", "disqus", "footer", "menu", "nav", "navbar", "navigation", "pager", "pagination", "replies"}
ASIDE = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "complementary", "promo", "promoted", "recommended", "related", "sidebar",
         "sponsor", "sponsored", "widget", "widgets"}
# In a compound: first words that only tell of a part, last words that hold more than the part,
# words whose header is the article's own, and last words that leave the head to the first.
TELLS = {"has", "have", "is", "no", "not", "non", "with", "without", "hide", "show", "toggle", "one", "two", "three", "after", "before", "above", "below", "under"}
AROUND = {"wrap", "wrapper", "layout", "page", "grid"}
OWN = {"article", "post", "entry", "story", "content", "section", "chapter", "page"}
PARTS = {"area", "bar", "block", "body", "box", "button", "buttons", "column", "container", "form", "icons", "inner", "item", "items", "link", "links", "list", "message",
         "overlay", "panel", "posts", "respond", "section", "slot", "stories", "text", "thread", "title", "unit"}
OPEN, SOFT, TEASERS, CLOSED = range(4)                  # how firmly an element is dropped
KEPT = {"html", "body", "article", "main"}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_SECTION = re.compile(r"<!\[(?:temp|cdata|ignore|include|rcdata)(?![-_.a-z0-9])", re.I)


class Lines(HTMLParser):
    """Collects lines: [text parts, characters, tags, link characters, region, in article]."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int, int, bool]] = [("", OPEN, 0, False)]       # tag, dropped, region, in article
        self.places: dict[str, list[int]] = {}          # of the open elements of a name in the stack
        self.blocks = [0]                               # places of the open elements that are not inline
        self.lines: list[list] = []
        self.open: list | None = None
        self.tags = self.regions = self.links = 0

    def end_line(self):
        self.open = None

    def handle_starttag(self, tag, attrs):
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
            if self._inside_p():
                self._pop_to("p")
        if tag in VOID:
            return
        _, dropped, region, article = self.stack[-1]
        if tag in ("article", "main"):
            dropped = OPEN if dropped <= (SOFT if tag == "article" else TEASERS) else dropped
            dropped = max(dropped, _hidden(attrs))
        elif dropped < CLOSED:
            own = SOFT if tag == "form" or (tag == "header" and not article) else CLOSED if tag in DROPPED else OPEN
            dropped = max(dropped, own, _hidden(attrs), OPEN if tag in KEPT else _named(attrs, article))
        if not article and (tag in SECTION or tag == "main"):
            self.regions += 1
            region = self.regions
        if tag == "a":
            self.links += 1
        self.places.setdefault(tag, []).append(len(self.stack))
        if tag not in INLINE:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, dropped, region, article or tag in ("article", "main")))

    def _inside_p(self):
        return self.stack[self.blocks[-1]][0] == "p"

    def _pop_to(self, tag):
        for _ in range(len(self.stack) - self.places[tag][-1]):
            name = self.stack.pop()[0]
            self.places[name].pop()
            if name not in INLINE:
                self.blocks.pop()
            if name == "a":
                self.links -= 1

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        self.tags += 1
        if tag not in INLINE:
            self.end_line()
        if self.places.get(tag) and (tag not in INLINE or self.places[tag][-1] > self.blocks[-1]):
            self._pop_to(tag)                           # an inline end does not close a block

    def handle_data(self, text):
        _, dropped, region, article = self.stack[-1]
        if dropped:
            return
        if self.open is None:
            if text.isspace():
                return
            self.open = [[], 0, self.tags, 0, region, article]
            self.lines.append(self.open)
            self.tags = 0
        self.open[0].append(text)
        n = len(text.strip())
        self.open[1] += n
        if self.links > 0:
            self.open[3] += n
        self.open[2] += self.tags
        self.tags = 0

    def parse_marked_section(self, i, report=1):
        # The parser ends the page at a '<![' with a name it does not know; as in browsers it is a
        # comment up to the next '>'.
        if _SECTION.match(self.rawdata, i):
            return super().parse_marked_section(i, report)
        return self.parse_bogus_comment(i, report)

    def unknown_decl(self, data):
        return


def _hidden(attrs) -> int:
    return max((CLOSED for key, value in attrs
                if key == "hidden" or (key == "style" and value and "display:none" in value.replace(" ", "").lower())), default=OPEN)


def _named(attrs, article: bool) -> int:
    """How firmly class, id and role drop an element."""
    names = [_name([w.lower() for w in _WORDS.findall(token)], article)
             for key, value in attrs if key in ("class", "id", "role") and value for token in value.split()]
    return max((CLOSED if x in SURE else TEASERS if x in ASIDE else SOFT for x in names if x), default=OPEN)


def _name(words: list[str], article: bool) -> str | None:
    """The name out of ``NAMES`` that a token of these words stands for."""
    if not words or words[0] in TELLS or words[-1] in AROUND:
        return None
    name = words[-1] if words[-1] in NAMES else words[0] if words[-1] in PARTS else None
    if name in ("header", "masthead") and (article or OWN & set(words)):
        return None
    return name if name in NAMES else None


def smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel, "full")[RADIUS:-RADIUS]
    return np.convolve(x, kernel, "full")[RADIUS:-RADIUS] / weight


def main_text(html: str | None) -> str:
    parser = Lines()
    # <br> separates words of its line.
    parser.feed(_BR.sub(" ", html or ""))
    parser.close()
    lines = [x for x in parser.lines if x[1]]
    if not lines:
        return ""
    chars = np.array([x[1] for x in lines], float)
    ratio = smooth(chars / np.maximum(1, [x[2] for x in lines]))
    content = ratio >= min(ratio.std(), ratio.max())
    region = np.array([x[4] for x in lines])
    total = np.bincount(region, weights=chars)
    marked = np.bincount(region, weights=chars * content, minlength=len(total))
    linked = np.bincount(region, weights=[x[3] for x in lines], minlength=len(total))
    whole = np.zeros(len(total), bool)
    whole[[x[4] for x in lines if x[5]]] = True
    chosen = np.where(whole, marked > 0, (linked <= MOST_LINKS * total) & (2 * marked >= total))
    out = []
    for x in lines:
        if chosen[x[4]]:
            out.append(" ".join("".join(x[0]).split()))
    return "\n".join(x for x in out if x)


# A line break with any attributes, quoted ones that hold > included.
_BR = re.compile(r"""<br(?=[\s/>])(?:"[^"]*"|'[^']*'|[^"'>])*>""", re.I)


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``df``."""
    rows = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
    return rows.mapInArrow(run, f"page_id {df.schema[id_col].dataType.simpleString()}, url string, text string, n_chars long")
