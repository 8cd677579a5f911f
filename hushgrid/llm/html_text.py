"""Main text of HTML pages: parser events, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's streaming parser cuts a page into lines, one for each block of running text. A line's
ratio is its characters outside links over its tags, up to that of running text; blocks that markup declares to be something else
(navigation, adverts, comments ...) have ratio zero and never belong to the article. Ratios are smoothed along
the page. Lines from ``HIGH`` on seed a cluster, which grows to both sides through lines from ``LOW`` of that on.
The smallest container with all seeds is the content region, where a declared article or main only decides if
nothing below the body has them all. The text runs from the region's first clustered line to its last, short
lines between them included. Inside an article, a name that its own parts may also have (related, discussion,
search ...) counts only where the block has little text for its tags, or mostly links.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never the article's.
SKIP = set("script style noscript template svg annotation annotation-xml canvas iframe object audio video head title form button select option textarea fieldset label nav aside footer menu dialog".split())
#: Elements that stay inside a line of text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark math q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
INLINE |= set("semantics mrow mi mn mo ms mtext msup msub msubsup mfrac msqrt mroot mover munder munderover mtable mtr mtd mspace mstyle mpadded mphantom menclose mmultiscripts merror".split())
HEADING = set("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role that name what is not the article.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|notices|popup|modal|newsletter|subscribe|signup|nav|navbar|navigation|menu|breadcrumbs?|"
    r"sidebar|side|aside|widget|footer|header|masthead|toolbar|pagination|pager|share|sharing|social|related|recommend\w*|comments?|commentlist|disqus|replies|respond|responses|discussion|dialog|login|search|contentinfo|complementary|alert)(?=$|[\s_-])",
    re.I,
)
#: Of these, the words that parts of an article are not named by.
SURE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|cookies?|consent|gdpr|newsletter|subscribe|navbar|breadcrumbs?|commentlist|disqus)(?=$|[\s_-])", re.I)
#: Characters for a tag below which, and share of link text from which, a block of an article is what its name says.
LOW_RATIO, LINKS = 10, 0.5
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
REGION = set("article main section div td body html center blockquote".split())
SIGMA = 2.0
#: Level of a seed, as a share of the highest one where the mean is above it; and of a line that joins a cluster, as a share of that.
HIGH, LOW = 0.5, 0.1
#: Ratio from which a line is running text; longer ones count no more, so that one huge paragraph does not hide short ones.
FULL = 20


class Line(NamedTuple):
    text: str
    links: int  # characters of links
    tags: int
    skip: bool
    region: int  # number of the innermost container; 0 outside all
    doubt: int  # number of the innermost element whose name alone speaks against it; 0 if none
    glued: bool  # whether it goes on in the word that the line before ends in


class Open(NamedTuple):
    tag: str
    skip: bool
    region: int
    doubt: int


class Lines(HTMLParser):
    """Collects lines from parser events. Elements hold no more than what their parent knows, so nesting of any depth costs linear time."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[Open] = []
        self.of: Counter = Counter()  # open elements by name
        self.lines: list[Line] = []
        self.names: dict[int, str] = {}  # containers by number; a part has a greater number than the whole
        self.parent: dict[int, int] = {}  # container -> the one around it
        self.doubted: dict[int, list[int]] = {}  # element -> its characters, start tags, characters of links
        self.around: dict[int, int] = {}  # doubted element -> the one around it
        self.made = 0
        self.loose = True
        self.text: list[str] = []
        self.tags = self.links = 0

    @property
    def top(self) -> Open:
        return self.open[-1] if self.open else Open("", False, 0, 0)

    def cut(self, within: bool = False) -> None:
        """End the line; ``within``: where running text goes on."""
        raw = "".join(self.text)
        text = " ".join(raw.split())
        if text or self.tags:
            top = self.top
            self.lines.append(Line(text, min(self.links, len(text)), self.tags, top.skip, top.region, top.doubt, not self.loose and bool(raw) and not raw[0].isspace()))
        if raw or not within:
            self.loose = not within or raw[-1].isspace()
        self.text, self.tags, self.links = [], 0, 0

    def close_to(self, k: int) -> None:
        for e in self.open[k:]:
            self.of[e.tag] -= 1
        del self.open[k:]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in INLINE:
            self.cut()
        self.tags += 1
        if tag in VOID:
            return
        if tag in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):
            self.close_implied(tag)
        top = self.top
        named = _CAMEL.sub("-", " ".join(v for k, v in attrs if k in ("class", "id", "role") and v))
        hidden = any(k == "hidden" or k == "aria-hidden" and v == "true" or k == "style" and v and re.search(r"display\s*:\s*none", v) for k, v in attrs)
        skip, doubt = top.skip, False
        if not skip and tag not in ("html", "body", "article", "main", "h1"):
            inside = self.of["article"] or self.of["main"]
            skip = tag in SKIP or tag == "header" and not inside or hidden
            if not skip and named and MARKED.search(named):
                if not inside or SURE.search(named):
                    skip = True
                elif tag not in HEADING and tag != "math" and not self.of["math"]:
                    doubt = True
        if (skip or doubt) and not top.skip:
            self.cut(within=tag in INLINE)  # text before belongs to what is kept
        self.made += 1
        region, own = top.region, top.doubt
        if tag in REGION:
            self.names[self.made], self.parent[self.made] = tag, region
            region = self.made
        if doubt:
            self.doubted[self.made], self.around[self.made] = [0, 0, 0], own
            own = self.made
        if own:
            self.doubted[own][1] += 1
        self.open.append(Open(tag, skip, region, own))
        self.of[tag] += 1

    def close_implied(self, tag: str) -> None:
        """An open p, li ... ends where its successor begins, up to the nearest container."""
        if not self.of[tag]:
            return
        for k in range(len(self.open) - 1, -1, -1):
            name = self.open[k].tag
            if name == tag:
                self.cut()
                self.close_to(k)
                return
            if name in REGION or name in ("ul", "ol", "dl", "table", "tbody", "nav"):
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID or tag not in INLINE:
            self.handle_starttag(tag, attrs)
            if tag not in VOID:
                self.handle_endtag(tag)
        else:
            self.tags += 1

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.cut()
        self.tags += 1
        if not self.of[tag]:
            return
        k = len(self.open) - 1
        while self.open[k].tag != tag:
            k -= 1
        before = self.open[k - 1] if k else Open("", False, 0, 0)
        if self.top.skip and not before.skip or self.open[k].doubt != before.doubt:
            self.cut(within=tag in INLINE)
        self.close_to(k)

    def handle_data(self, data: str) -> None:
        self.text.append(data)
        n = len(data.strip())
        link = n if self.of["a"] else 0
        self.links += link
        top = self.top
        if top.doubt and not top.skip:
            own = self.doubted[top.doubt]
            own[0] += n
            own[2] += link

    def settled(self) -> list[Line]:
        """The lines, those skipped too that lie in a doubted element of little text or many links."""
        for n in reversed(self.doubted):  # parts come after the whole
            if up := self.around[n]:
                self.doubted[up] = [a + b for a, b in zip(self.doubted[up], self.doubted[n])]
        out: set[int] = set()
        for n, (chars, tags, links) in self.doubted.items():
            if chars < LOW_RATIO * tags or links >= LINKS * chars or self.around[n] in out:
                out.add(n)
        return [line._replace(skip=True) if line.doubt in out else line for line in self.lines]


def smooth(values: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing, renormalised at the ends."""
    reach = int(3 * sigma)
    kernel = np.exp(-(np.arange(-reach, reach + 1) ** 2) / (2 * sigma**2))
    total = np.convolve(values, kernel, mode="full")[reach : reach + len(values)]
    return total / np.convolve(np.ones(len(values)), kernel, mode="full")[reach : reach + len(values)]


def ratios(lines: list[Line]) -> np.ndarray:
    """Characters outside links over tags, ``FULL`` at most; zero for what is skipped."""
    return np.array([0.0 if line.skip else min(FULL, (len(line.text) - line.links) / max(1, line.tags)) for line in lines])


def clusters(level: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(seeds, members) among the ``live`` lines: those of a high level, and with them the runs of lines around of a level not low."""
    high = min(level.mean(), level.max() * HIGH)
    seeds = live & (level >= high)
    run = live & (level >= high * LOW)
    number = np.cumsum(np.concatenate([[False], run[1:] & ~run[:-1]]))
    return seeds, run & np.isin(number, number[seeds])


def main_text(html: str | None) -> str:
    """The article's blocks in page order, joined by one space; empty for null, empty or article-less pages."""
    if not html:
        return ""
    parser = Lines()
    parser.feed(html)
    parser.close()
    parser.cut()
    lines = parser.settled()
    ratio = ratios(lines)
    live = ratio > 0
    if not live.any():  # nothing but links
        live = np.array([bool(line.text) and not line.skip for line in lines], dtype=bool)
        if not live.any():
            return ""
        ratio = live.astype(float)
    # lines that are skipped or empty part nothing: a cluster goes on behind them
    shown = np.array([bool(line.text) and not line.skip for line in lines], dtype=bool)
    level = smooth(ratio)
    seeds, members = np.zeros(len(lines), dtype=bool), np.zeros(len(lines), dtype=bool)
    seeds[shown], members[shown] = clusters(level[shown], np.ones(int(shown.sum()), dtype=bool))
    seeds &= live
    if not seeds.any():
        seeds = live & members if (live & members).any() else live
        members = members | seeds
    # text of the seeds in each container, its parts included
    mass = dict.fromkeys(parser.names, 0)
    total = 0
    for k in np.flatnonzero(seeds).tolist():
        total += len(lines[k].text)
        if lines[k].region:
            mass[lines[k].region] += len(lines[k].text)
    for n in reversed(parser.names):
        if up := parser.parent[n]:
            mass[up] += mass[n]
    region = max((n for n in mass if mass[n] == total), default=0)  # the innermost container with all seeds
    if parser.names.get(region, "body") in ("body", "html"):
        declared = [n for n, name in parser.names.items() if name in ("article", "main") and 2 * mass[n] >= total]
        region = max(declared, key=lambda n: (mass[n], n), default=region)
    inside = {region}
    for n in parser.names:
        if parser.parent[n] in inside:
            inside.add(n)
    whole = parser.names.get(region, "body") in ("body", "html")
    mine = [k for k in np.flatnonzero(shown).tolist() if whole and not region or lines[k].region in inside]
    # without a container of its own, an article has no link lists in it
    own = [k for k in mine if members[k] and (live[k] or not whole)]
    kept = own if whole else [k for k in mine if own and own[0] <= k <= own[-1]]
    return "".join(("" if not at or lines[k].glued and kept[at - 1] == k - 1 else " ") + lines[k].text for at, k in enumerate(kept))


def extract(html: Column) -> Column:
    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        return common.by_parts(lambda part: pa.array([main_text(p) for p in part.to_pylist()], type=pa.string()))(pages)

    return run(html)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with text and n_chars (columns of these names are replaced).

    Null and empty pages give an empty text. Broken markup is read as far as it goes. Repeated rows give equal
    results; an empty table stays empty.
    """
    return pages.withColumn("text", extract(F.col(html_col))).withColumn("n_chars", F.length("text").cast("long"))


def op6_html_extraction(spark, sf_dir: str) -> DataFrame:
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select("page_id", "url", "text", "n_chars")
