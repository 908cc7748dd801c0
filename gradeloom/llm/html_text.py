"""Main text of web pages by text-to-tag ratios (operator 6).

The standard library's parser streams events; each block of text becomes a line with its
characters and its tags. Ratios of text to tags are smoothed along the page with a Gaussian
kernel, and lines above a threshold form the content cluster. The region is the innermost
element that holds all lines of the cluster: all its lines are the article, also
short ones, apart from menus, headers, footers, sidebars, notices, adverts, forms and reader
comments, which are told by tag, role or class and are never lines. Class names and ids count
as wholes or by known first words, and not on headings; what they mark is read all the same
if it holds the page's article, its h1 or most of its text, and so is a form, since some sites wrap the
whole page in one. If the region has no h1, the last one before it is its headline and goes first. An h1 in
a header stands apart like all of the header, inside an article too.

Elements point to the ones around them, so a page takes memory linear in its length, however deep.

Null html counts as empty; a page without content has an empty text. Broken and cut
markup is read as far as it goes. Every page comes back, repeated rows included.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.batches import text_groups

# Fixed values of HTML: elements without an end tag; elements that stand inside a line.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
INLINE = set(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark "
    "nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
# Elements whose content is never article text.
APART = set(
    "aside audio button canvas datalist dialog embed footer head header iframe input map menu "
    "meter nav noscript object option output progress script select style svg template textarea "
    "title video".split()
)
ROLES = set(
    "alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search "
    "toolbar".split()
)
# Class names and ids that mark what stands apart, alone or with words that say where or how.
MARKS = set(
    "ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments consent "
    "cookie cookies disqus footer gdpr header masthead menu nav navbar navigation newsletter "
    "notice notices popup promo promoted related replies reply respond responses share sharing "
    "sidebar signup social sponsor sponsored subscribe teaser toolbar widget".split()
)
# Elements that can be a region; a paragraph ends where one of them begins.
REGIONS = set("article body center div html main section table td tr tbody".split())
_ENDS_P = REGIONS | set(
    "address blockquote dd dl dt fieldset figure figcaption footer form h1 h2 h3 h4 h5 h6 header hr li "
    "nav ol p pre ul aside".split()
)
WHERE = set(
    "area bar block body bottom bottoms box button buttons center col column container content desktop "
    "footer global group header holder icon icons inner item items left link links list main mobile outer page "
    "panel placeholder primary right row secondary section site slot small sticky top unit wrap wrapper zone".split()
)
# First or last words of names that mark what stands apart whatever else the name says, but
# for words of a state the element or its neighbours are in.
KNOWN = set(
    "ad ads adv advert advertisement advertising breadcrumb breadcrumbs comment comments consent cookie "
    "cookies disqus gdpr newsletter popup promoted share sharing social sponsor sponsored".split()
)
STATES = set(
    "accepted active close closed disabled enabled fixed free has hidden is js loaded no not off on open "
    "shown visible with without".split()
)
# Reader comments often have more text than the article.
COMMENTS = set("comment comments disqus replies reply respond responses".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
_TOKEN = re.compile(r"[a-z]+")

# Lines of the Gaussian kernel to either side, and its width.
RADIUS, SIGMA = 2, 1.0


class _Lines(HTMLParser):
    """Collects lines: text with the innermost marked element around each part, tags, and the innermost region.

    Regions and marked elements are numbered in page order; `-1` is none. The element around one
    has a smaller number.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.raw: list[tuple[list[tuple[str, int]], int, int, bool]] = []
        self._open: list[tuple[str, bool, int, int]] = []  # tag, apart, innermost region and mark
        self._count: Counter[str] = Counter()  # open elements by tag
        self._text: list[tuple[str, int]] = []
        self._tags = 1
        self.around: list[int] = []  # the region around each region
        self._outer: list[int] = []  # the marked element around each marked one
        self._comments: list[bool] = []  # of each marked element, whether it is for comments
        self._article: list[int] = []  # mark around each article or main element
        self._title: list[int] = []  # and around each h1

    def _apart(self) -> bool:
        return bool(self._open) and self._open[-1][1]

    def _inside(self) -> tuple[int, int]:
        return self._open[-1][2:] if self._open else (-1, -1)

    def end_line(self) -> None:
        if self._text:
            self.raw.append((self._text, self._tags, self._inside()[0], self._count["h1"] > 0))
        self._text, self._tags = [], 1

    def handle_starttag(self, tag, attrs):
        if tag in _ENDS_P and any(t == "p" for t, *_ in self._open[-8:]):
            self._close("p")
        if tag not in INLINE:
            self.end_line()
        elif tag == "br":
            self._text.append((" ", self._inside()[1]))
        self._tags += 1
        if tag in VOID:
            return
        region, mark = self._inside()
        if tag in REGIONS:
            self.around.append(region)
            region = len(self.around) - 1
        apart = self._apart() or _stands_apart(tag, attrs)
        if not apart:
            name = _mark(attrs)
            if tag in ("article", "main"):
                if not name:
                    self._article.append(mark)
            elif tag == "h1":
                self._title.append(mark)
            elif tag == "form" or name and tag not in HEADINGS and tag not in ("html", "body"):
                self._outer.append(mark)
                self._comments.append(not COMMENTS.isdisjoint(_TOKEN.findall(name)))
                mark = len(self._outer) - 1
        self._open.append((tag, apart, region, mark))
        self._count[tag] += 1

    def lines(self) -> list[tuple[str, int, int, bool]]:
        """Text, tags, region and whether in an h1, of the lines without what marked elements hold."""
        mass = [0] * len(self._outer)
        total = 0
        for chunks, *_ in self.raw:
            for text, mark in chunks:
                size = len(text.strip())
                total += size
                if mark >= 0:
                    mass[mark] += size
        mass = summed_up(mass, self._outer)
        articles, titles = ([0] * len(self._outer) for _ in range(2))
        for held, found in ((articles, self._article), (titles, self._title)):
            for mark in found:
                if mark >= 0:
                    held[mark] += 1
        articles, titles = summed_up(articles, self._outer), summed_up(titles, self._outer)

        def holds_article(m: int) -> bool:
            if self._article and articles[m] == len(self._article) or self._title and titles[m] == len(self._title):
                return True
            known = articles[m] < len(self._article)
            return mass[m] * 2 > total and not known and not self._comments[m]

        gone: list[bool] = []
        for m, outer in enumerate(self._outer):
            gone.append(outer >= 0 and gone[outer] or not holds_article(m))
        out = []
        for chunks, tags, region, heading in self.raw:
            text = " ".join("".join(t for t, mark in chunks if mark < 0 or not gone[mark]).split())
            if text:
                out.append((text, tags, region, heading))
        return out

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self._open and self._open[-1][0] == tag and tag != "p":
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if tag in VOID:
            return
        self._tags += 1
        self._close(tag)

    def _close(self, tag):
        """Ends the innermost open element of the name, and what is open inside it."""
        if not self._count[tag]:
            return
        for i in range(len(self._open) - 1, -1, -1):
            if self._open[i][0] == tag:
                if any(t not in INLINE for t, *_ in self._open[i:]):
                    self.end_line()
                self._count.subtract(t for t, *_ in self._open[i:])
                del self._open[i:]
                return
            if self._open[i][0] in REGIONS and tag in INLINE | {"p", "li"}:
                return  # an end tag without a start inside this region

    def handle_data(self, data):
        if not self._apart():
            self._text.append((data, self._inside()[1]))


def summed_up(values: list[int], outer: list[int]) -> list[int]:
    """Values of elements with those of all elements inside them."""
    out = values[:]
    for i in range(len(out) - 1, -1, -1):
        if outer[i] >= 0:
            out[outer[i]] += out[i]
    return out


def _stands_apart(tag: str, attrs: list[tuple[str, str | None]]) -> bool:
    if tag in APART:
        return True
    if tag in ("html", "body", "article", "main"):
        return False
    for name, value in attrs:
        if name == "role" and value and value.strip().lower() in ROLES:
            return True
        if name in ("hidden", "aria-hidden") and (value is None or value.lower() != "false"):
            return True
    return False


def _mark(attrs: list[tuple[str, str | None]]) -> str:
    """The first class name or id that marks what stands apart, or nothing."""
    for name, value in attrs:
        if name in ("class", "id") and value:
            for one in value.lower().split():
                words = [w for w in _TOKEN.findall(one) if len(w) > 1]
                if MARKS.isdisjoint(words) or not STATES.isdisjoint(words):
                    continue
                if all(w in MARKS or w in WHERE for w in words) or not KNOWN.isdisjoint((words[0], words[-1])):
                    return one
    return ""


def main_text(html: str) -> str:
    """The article's blocks in page order, joined by line breaks."""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines()
    if not lines:
        return ""
    sizes = np.array([len(t) for t, *_ in lines], float)
    ratio = sizes / np.array([line[1] for line in lines], float)
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    padded = np.pad(ratio, RADIUS, mode="edge")
    smooth = np.convolve(padded, kernel / kernel.sum(), mode="valid")
    content = smooth >= _threshold(smooth)
    holds = [0] * len(parser.around)
    for (_, _, where, _), is_content in zip(lines, content):
        if is_content and where >= 0:
            holds[where] += 1
    # Of the elements around every line of the cluster the one opened last is the innermost.
    holds = summed_up(holds, parser.around)
    region = max((r for r, n in enumerate(holds) if n == content.sum()), default=-1)
    if region < 0:
        return "\n".join(t for t, *_ in lines)
    inside: list[bool] = []
    for r, around in enumerate(parser.around):
        inside.append(r == region or around >= 0 and inside[around])
    kept = [where >= 0 and inside[where] for _, _, where, _ in lines]
    if not any(k and heading for k, (_, _, _, heading) in zip(kept, lines)):
        before = [i for i in range(kept.index(True)) if lines[i][3]]
        if before:
            kept[before[-1]] = True
    return "\n".join(t for k, (t, *_) in zip(kept, lines) if k)


def _threshold(smooth: np.ndarray) -> float:
    """Between the two means that lines of low and high ratio settle at."""
    low, high = smooth.min(), smooth.max()
    for _ in range(20):
        cut = (low + high) / 2
        under, over = smooth[smooth < cut], smooth[smooth >= cut]
        if not len(under) or not len(over):
            break
        new = under.mean(), over.mean()
        if new == (low, high):
            break
        low, high = new
    return min((low + high) / 2, smooth.max())


def extract(pages: DataFrame, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns `keep`, `text`, and `n_chars`, its code points."""
    names = [f"k{i}" for i in range(len(keep))]
    given = pages.select(
        *[F.col(c).alias(n) for c, n in zip(keep, names)], F.col(html_column).alias("html")
    )
    out = ", ".join(f"{n} {given.schema[n].dataType.simpleString()}" for n in names)

    def run(batches):
        for b in batches:
            for part, htmls in text_groups(b, "html"):
                texts = [main_text(h or "") for h in htmls]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(texts, pa.string()),
                     pa.array([len(t) for t in texts], pa.int64())],
                    names=[*names, "text", "n_chars"],
                )

    done = given.mapInArrow(run, f"{out}, text string, n_chars long")
    return done.select(*[F.col(n).alias(c) for c, n in zip(keep, names)], "text", "n_chars")
