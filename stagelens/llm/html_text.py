"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering."""

from __future__ import annotations

import heapq
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, text_slices

#: Width of the smoothing, in lines.
SIGMA = 1.0
#: A line is dense when its smoothed ratio is above this part of the page's standard deviation.
CUT = 0.5
#: An element told by name only is the page's content if so much of the dense text, but for other such elements, is in it.
WHOLE = 0.9

# Elements of the HTML standard.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead "
    "title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style noscript template svg math iframe object canvas audio video map select option datalist button textarea".split())
#: Of these, only elements opened inside are closed before their own end tag.
SEALED = frozenset("script style noscript template svg math iframe object select textarea".split())
APART = frozenset("nav aside footer form dialog menu fieldset label legend".split())
OWN = frozenset("article main".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6 dt".split())

ROLES = frozenset(
    "navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status tablist".split()
)
# Words in class and id names that mark what is not the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion outbrain taboola "
    "nav navbar navigation menu submenu topbar toolbar breadcrumb breadcrumbs pagination pager tabs masthead "
    "footer sidebar sidebars aside rail widget widgets "
    "comment comments commentlist disqus respond replies reply discussion "
    "cookie cookies consent gdpr notice notices notification alert popup modal overlay disclaimer newsletter subscribe subscription signup "
    "login paywall share sharing social related recommended recommendations trending popular skip search".split()
)
#: With one of these, a "header" is the article's own.
TITLES = frozenset("article entry post story content".split())
_NAME = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
_SPACE = re.compile(r"\s+")
_COMMENT_END = re.compile(r"--!?>")
_TAG = re.compile(r"<[A-Za-z/!?]")


class _Lines(HTMLParser):
    """Cuts a page's events into lines, one for each block, and keeps for each element what it stands in.

    Elements are numbered in page order, 0 is the page. A line knows the element it
    ends in; the links of elements give what is around it, so the work is
    linear in the page, however deep elements nest.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, int, bool, int]] = []  # name, number, apart, place of the innermost open block
        self.places: dict[str, list[int]] = {}  # name -> places in ``open``
        self.sealed_from = 0  # place of the outermost hidden element
        self.hidden = 0
        self.apart = 0
        self.own = 0
        self.named: set[int] = set()
        # of each element, itself included: the innermost container, article, main and named element, the outermost article
        self.parent, self.container, self.article, self.main, self.name, self.outer = [0], [0], [0], [0], [0], [0]
        self.text: list[str] = []
        self.tags = 0
        self.lines: list[tuple[str, int, int, bool]] = []  # text, tags, element, apart

    def cut(self) -> None:
        text = _SPACE.sub(" ", "".join(self.text)).strip()
        if text or self.tags:
            self.lines.append((text, self.tags, self.open[-1][1] if self.open else 0, self.apart > 0))
        self.text, self.tags = [], 0

    def _enter(self, tag: str, apart: bool, named: bool) -> None:
        above, block = (self.open[-1][1], self.open[-1][3]) if self.open else (0, -1)
        n, place = len(self.parent), len(self.open)
        holds = tag in BLOCKS and tag not in CLOSED_BY_BLOCK and tag != "li"
        self.parent.append(above)
        self.container.append(n if holds else self.container[above])
        self.article.append(n if tag in OWN else self.article[above])
        self.main.append(n if tag == "main" and not self.hidden else self.main[above])
        self.name.append(n if named else self.name[above])
        self.outer.append(self.outer[above] or (n if tag in OWN else 0))
        if named:
            self.named.add(n)
        self.open.append((tag, n, apart, place if tag in BLOCKS else block))
        self.places.setdefault(tag, []).append(place)
        if tag in HIDDEN and not self.hidden:
            self.sealed_from = place
        self.hidden += tag in HIDDEN
        self.apart += apart
        self.own += tag in OWN

    def _is_apart(self, tag: str, attrs) -> bool:
        if tag in APART or (tag == "header" and not self.own):
            return True
        if tag in OWN or tag in ("html", "body"):
            return False
        for key, value in attrs:
            if key == "role" and value and value.strip().lower() in ROLES:
                return True
            if key in ("hidden",) or (key == "aria-hidden" and value == "true"):
                return True
            if key == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return True
        return False

    def _is_named(self, tag: str, attrs) -> bool:
        if tag in OWN or tag in ("html", "body"):
            return False
        words = {w.lower() for key, value in attrs if key in ("class", "id") and value for w in _NAME.findall(value)}
        return bool(NAMES & words or ("header" in words and not self.own and not TITLES & words))

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """A marked section such as ``<![foo[`` is no HTML: a comment up to the next ``>``, or to the end of the page."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else len(self.rawdata)

    def parse_comment(self, i: int, report: int = 1) -> int:
        """A comment that never ends goes to the end of the page; so no page is searched anew for each such comment."""
        rest = self.rawdata.startswith(">", i + 4) and i + 5 or self.rawdata.startswith("->", i + 4) and i + 6
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return rest or (end.end() if end else len(self.rawdata))

    def handle_starttag(self, tag: str, attrs) -> None:
        if self.hidden and tag not in HIDDEN and tag != "body":
            if tag not in VOID:
                self._enter(tag, False, False)
            return
        if tag in BLOCKS:
            if tag == "body":
                self._leave("head")
            if self.open and self.open[-1][0] in CLOSED_BY_BLOCK:
                self._leave(self.open[-1][0])
            elif tag == "p" or tag in ("li", "dd", "dt", "tr", "td", "th"):
                self._imply_end(tag)
            self.cut()
        self.tags += 1
        if tag == "br":
            self.text.append(" ")
        if tag not in VOID:
            self._enter(tag, self._is_apart(tag, attrs), self._is_named(tag, attrs))

    def _imply_end(self, tag: str) -> None:
        """Inline elements left open inside a paragraph or item do not keep the next one from starting anew."""
        place = self.open[-1][3] if self.open else -1
        if place < 0:
            return
        name = self.open[place][0]
        if name == tag or (tag in ("td", "th") and name in ("td", "th")) or (tag in ("dd", "dt") and name in ("dd", "dt")):
            self._leave(name)

    def _place(self, tag: str) -> int:
        """Where the innermost open element of that name stands, -1 if there is none."""
        places = self.places.get(tag)
        return places[-1] if places else -1

    def _leave(self, tag: str) -> None:
        place = self._place(tag)
        while 0 <= place < len(self.open):
            name, _, apart, _ = self.open.pop()
            self.places[name].pop()
            self.hidden -= name in HIDDEN
            self.apart -= apart
            self.own -= name in OWN

    def handle_endtag(self, tag: str) -> None:
        if self.hidden:
            inside = self._place(tag) >= self.sealed_from
            if inside or self.open[self.sealed_from][0] in SEALED:
                # neither the end of a hidden element's child nor a stray one reaches what stands around it
                if inside:
                    if tag in HIDDEN:
                        self.tags += 1
                        if tag in BLOCKS:
                            self.cut()
                    self._leave(tag)
                return
        self.tags += 1
        if tag in BLOCKS:
            self.cut()
        elif not self.open or self._place(tag) <= self.open[-1][3]:
            # the end of an inline element does not close blocks opened since
            return
        self._leave(tag)

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)


def text_ratios(lines) -> np.ndarray:
    """Characters of each line for each of its tags, smoothed over neighbouring lines."""
    ratio = np.array([len(text) / max(tags, 1) for text, tags, *_ in lines], float)
    reach = int(np.ceil(3 * SIGMA))
    bell = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * SIGMA**2))
    return np.convolve(np.pad(ratio, reach, mode="edge"), bell / bell.sum(), "valid")


def _overruled(page: _Lines, usable: list[bool], dense: np.ndarray) -> set[int]:
    """Elements whose name would drop the page's content with them.

    A named element that holds the page's main element is overruled; while no
    article has lines outside all named elements, the named one with the most
    text of articles inside it; and any one with most of the dense text and nearly
    all of what names leave in doubt, unless an article beside it has lines.
    Elements inside an overruled one are then judged by the same rule: each is
    judged once, with sums over what is in it that are made beforehand.
    """
    # of each named element: dense text and article text in it, its last main, and dense text and articles right in it
    weight: Counter[int] = Counter()
    holds: Counter[int] = Counter()
    last: Counter[int] = Counter()
    right_in: Counter[int] = Counter()
    beside: defaultdict[int, set[int]] = defaultdict(set)
    for (text, _, at, _), good, thick in zip(page.lines, usable, dense, strict=True):
        if not good:
            continue
        n, size = page.name[at], len(text) if thick else 0
        weight[n] += size
        right_in[n] += size
        last[n] = max(last[n], page.main[at])
        if page.article[at]:
            holds[page.name[page.article[at]]] += len(text)
            beside[n].add(page.outer[at])
    inside: defaultdict[int, list[int]] = defaultdict(list)
    for n in sorted(page.named, reverse=True):
        above = page.name[page.parent[n]]
        inside[above].append(n)
        weight[above] += weight[n]
        holds[above] += holds[n]
        last[above] = max(last[above], last[n])
    total, free, near = weight[0], 0, set()
    over: set[int] = set()
    with_main, by_text, large = [], [], []
    new = 0
    while True:
        # what stands right in the element decided last is free of names now, the named ones in it are judged next
        free += right_in[new]
        near |= beside[new]
        for n in inside[new]:
            if last[n] > n:
                with_main.append(n)
            elif holds[n]:
                heapq.heappush(by_text, (-holds[n], n))
            if 2 * weight[n] > total:
                large.append(n)
        while by_text and by_text[0][1] in over:
            heapq.heappop(by_text)
        if with_main:
            new = with_main.pop()
        elif by_text and not near:
            new = heapq.heappop(by_text)[1]
        else:
            whole = (n for n in large if n not in over and weight[n] > WHOLE * (weight[n] + free))
            new = next((n for n in whole if near <= {page.outer[page.parent[n]]} - {0}), 0)
        if not new:
            return over
        over.add(new)


def main_text(html: str) -> str:
    """The article of a page, blocks joined by newlines; empty where there is none.

    Lines whose smoothed text-to-tag ratio lies above the threshold are dense.
    Content regions are the containers of dense lines. Every line of a region, or
    of an element in one, is kept, short ones too, but for those inside menus,
    forms, notices, adverts, comments and the like, told by element or role, or by
    class or id where that does not drop the page's content. Where most of the
    dense text lies in article or main elements, only regions in them count, and
    lines of elements around these regions, such as headings, are kept as well.
    """
    page = _Lines()
    # a tag that the end of the page cuts off is no text
    cut_off = _TAG.search(html, html.rfind(">") + 1)
    page.feed(html[: cut_off.start()] if cut_off else html)
    page.close()
    page.cut()
    lines = page.lines
    usable = [bool(text) and not apart for text, _, _, apart in lines]
    if not any(usable):
        return ""
    smooth = text_ratios(lines)
    enough = lambda: smooth >= min(CUT * smooth.std(), max(s for s, u in zip(smooth, usable, strict=True) if u))
    dense = enough()
    if page.named:
        over = _overruled(page, usable, dense) | {0}
        usable = [u and page.name[at] in over for u, (_, _, at, _) in zip(usable, lines, strict=True)]
        if not any(usable):
            return ""
        dense = enough()
    chosen = [i for i, u in enumerate(usable) if u and dense[i]]
    if not chosen:
        return ""
    weight = lambda at: sum(len(lines[i][0]) for i in at)
    owned = [i for i in chosen if page.article[lines[i][2]]]
    in_articles = bool(owned) and 2 * weight(owned) >= weight(chosen)
    regions = {page.container[lines[i][2]] for i in (owned if in_articles else chosen)}
    kept_in = set(regions)
    for n in range(1, len(page.parent)):
        above = page.container[page.parent[n]]
        if page.container[n] == n and above and above in kept_in:
            kept_in.add(n)
    if in_articles:
        around: set[int] = set()
        for n in regions:
            n = page.container[page.parent[n]]
            while page.article[n] and n not in around:
                around.add(n)
                n = page.container[page.parent[n]]
        kept_in |= around
    kept = [i for i, u in enumerate(usable) if u and page.container[lines[i][2]] in kept_in and (page.article[lines[i][2]] or not in_articles)]
    return "\n".join(lines[i][0] for i in kept)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in text_slices(batch, "html"):
            texts = [main_text(html) for html in part.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )


def extract_pages(pages: DataFrame, html: str = "html", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, url, text and n_chars (code points) of the main text of each page, one row per row of ``pages``.

    A null or empty page, or one without an article, gives an empty text. Pages
    are parsed whole. Ids and addresses may be null or repeat; no rows give no
    rows; other columns are ignored. There is no shuffle.
    """
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text_or_empty(html).alias("html"))
    kinds = dict(rows.dtypes)
    return rows.mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
