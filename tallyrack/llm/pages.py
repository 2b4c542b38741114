"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clusters.

The standard library's parser streams events. A line is the text between two block boundaries; its
ratio is the characters outside links over the tags met in it. Ratios are smoothed along the page,
lines above the threshold (one standard deviation, as usual for this ratio) form clusters, and the
element that holds most of the clusters' text is the article; so are ``article`` elements beside it that
hold a fair part as much. All its lines count, short ones too, but for parts that are no article text
wherever they stand: menus, forms, adverts, comments and the like, known by element, role or class.
A class or id says so only of a block outside program text, and only if all words of one of its
names do: ``cookie-notice`` and ``ad-box`` do, ``notice-period`` and ``related-work`` don't.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tallyrack.llm.common import small_batches

# Element and attribute vocabularies: fixed values.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset(
    "script style noscript template svg math canvas iframe object audio video nav footer aside form button select textarea menu dialog title".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination "
    "popup promo promoted promotion recommended related replies respond share sharing sidebar signup social sponsor sponsored subscribe "
    "subscription toolbar widget".split()
)
#: Words that a name of such a part may have besides.
NEUTRAL = frozenset(
    "area articles bar block bottom box buttons container content footer form group holder inner item items left links list main outer page panel "
    "posts right section site slot top unit wrap wrapper".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Standard deviation of the smoothing in lines, and the share of the clusters' text that leads on to a child element.
SIGMA = 1.0
HOLDS = 0.8
#: ``article`` elements side by side count together down to this share of the heaviest.
BESIDE = 0.25
#: A list is a menu if more than this share of it is linked and its lines are shorter than this, on average.
LINKED, SHORT = 0.8, 40
_WORD = re.compile(r"[a-z]+")
_KERNEL = np.exp(-0.5 * (np.arange(-3, 4) / SIGMA) ** 2)
_KERNEL /= _KERNEL.sum()


@dataclass
class Line:
    text: str
    ratio: float
    linked: int
    home: int
    list: int


class LineParser(HTMLParser):
    """Lines of a page outside the parts that are never article text. Open inline tags don't matter.

    Block elements are numbered as they open, so a parent's number is below its children's; 0 is the page.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int]] = []
        self.within: Counter[str] = Counter()
        self.kinds, self.parents = ["page"], [0]
        self.skip, self.depth = "", 0
        self.parts: list[str] = []
        self.lists: list[int] = []
        self.tags, self.link, self.link_chars, self.code = 0, 0, 0, 0

    def _end_line(self) -> None:
        text = " ".join("".join(self.parts).split())
        # of an article's own header only the headings are article
        if text and not (self.within["header"] and not any(self.within[h] for h in HEADINGS)):
            free = max(0, len(text) - self.link_chars)
            home = self.open[-1][1] if self.open else 0
            self.lines.append(Line(text, free / max(1, self.tags), len(text) - free, home, self.lists[-1] if self.lists else -1))
        self.parts, self.tags, self.link_chars = [], 0, 0

    def _push(self, tag: str) -> None:
        self.parents.append(self.open[-1][1] if self.open else 0)
        self.open.append((tag, len(self.kinds)))
        self.kinds.append(tag)
        self.within[tag] += 1
        if tag in ("ul", "ol", "dl"):
            self.lists.append(self.open[-1][1])

    def _pop(self) -> str:
        tag, number = self.open.pop()
        self.within[tag] -= 1
        if self.lists and self.lists[-1] == number:
            self.lists.pop()
        return tag

    def _excluded(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if tag in NEVER:
            return True
        if tag == "header" and not self.within["article"]:
            return True
        for name, value in attrs:
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return tag not in ("html", "body")
            if not value:
                continue
            if name == "role" and value.strip().lower() in ROLES:
                return tag not in ("html", "body", "main", "article")
            if name == "style" and "display:none" in value.replace(" ", "").lower():
                return tag not in ("html", "body")
            if name in ("class", "id") and tag in BLOCKS and tag not in HEADINGS and tag not in ("html", "body", "main") and not (self.within["pre"] or self.code):
                if any(self._says(token, tag) for token in value.lower().split()):
                    return True
        return False

    def _says(self, token: str, tag: str) -> bool:
        words = set(_WORD.findall(token))
        known = words & NAMES
        if "header" in known and (tag == "header" or self.within["article"]):  # an article's own
            return False
        return bool(known) and words <= NAMES | NEUTRAL

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.skip:
            if not (self.skip == "p" and tag in BLOCKS):  # a paragraph ends where the next block begins
                self.depth += tag == self.skip
                return
            self.skip = ""
        self.tags += 1
        block = tag in BLOCKS
        if block:
            self._end_line()
            self.tags = 1
            if self.open and self.open[-1][0] in ("p", *HEADINGS):
                self._pop()
            if tag in ("li", "dd", "dt", "tr") and self.open and self.open[-1][0] == tag:
                self._pop()
        elif tag in ("br", "td", "th"):
            self.parts.append(" ")
        if tag in VOID:
            return
        if self._excluded(tag, attrs):
            self.skip, self.depth = tag, 1
        elif block:
            self._push(tag)
        elif tag == "a":
            self.link += 1
        elif tag == "code":
            self.code += 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)  # a slash ends nothing but void elements

    def handle_endtag(self, tag: str) -> None:
        if self.skip:
            if tag == self.skip:
                self.depth -= 1
                if not self.depth:
                    self.skip = ""
                return
            if not (self.skip in ("p", "li") and tag in BLOCKS and self.within[tag] and tag != "p"):
                return
            self.skip = ""  # left open inside an element that ends here
        self.tags += 1
        if tag == "a":
            self.link = max(0, self.link - 1)
        elif tag == "code":
            self.code = max(0, self.code - 1)
        if tag in BLOCKS:
            self._end_line()
            if self.within[tag]:
                while self._pop() != tag:
                    pass

    def handle_data(self, data: str) -> None:
        if self.skip:
            return
        self.parts.append(data)
        if self.link:
            self.link_chars += len(data)

    def close(self) -> None:
        super().close()
        self._end_line()


def clusters(ratios: np.ndarray) -> np.ndarray:
    """Which lines belong to a content cluster: the smoothed ratio reaches one standard deviation of it."""
    padded = np.pad(ratios, 3, mode="edge")
    smooth = np.convolve(padded, _KERNEL, mode="valid")
    return smooth >= min(smooth.std(), smooth.max())


def main_text(html: str) -> str:
    """The article's blocks in page order, one a line; empty if the page has none."""
    parser = LineParser()
    cut = html.rfind("<")
    if cut >= 0 and ">" not in html[cut:] and re.match(r"<[/!?a-zA-Z]", html[cut:]):
        html = html[:cut]  # a tag that the page's end cuts off is no text
    parser.feed(html)
    parser.close()
    lines = parser.lines
    if not lines:
        return ""
    content = clusters(np.array([x.ratio for x in lines]))
    parents = parser.parents
    mass = [0] * len(parents)
    for line, good in zip(lines, content):
        if good:
            mass[line.home] += len(line.text)
    for i in range(len(parents) - 1, 0, -1):  # children before parents
        mass[parents[i]] += mass[i]
    homes, sure = _homes(parser.kinds, parents, mass)
    inside = [0 in homes] * len(parents)
    for i in range(1, len(parents)):
        inside[i] = inside[parents[i]] or i in homes
    menus = set() if sure else _menus(lines)
    return "\n".join(x.text for x in lines if inside[x.home] and x.list not in menus)


def _menus(lines: list[Line]) -> set[int]:
    """Lists that are short links as a whole, where the page doesn't say what its article is."""
    total: dict[int, list[int]] = {}
    for line in lines:
        if line.list >= 0:
            sums = total.setdefault(line.list, [0, 0, 0])
            sums[0] += 1
            sums[1] += len(line.text)
            sums[2] += line.linked
    return {at for at, (n, chars, linked) in total.items() if linked > LINKED * chars and chars < SHORT * n}


def _homes(kinds: list[str], parents: list[int], mass: list[int]) -> tuple[set[int], bool]:
    """The elements that are the article (0: the page), and whether the page itself says so."""
    best = {}
    for kind in ("article", "main"):
        found = [i for i, k in enumerate(kinds) if k == kind and mass[i]]
        if found:
            best[kind] = max(found, key=lambda i: (mass[i], -i))
    if "article" in best and mass[best["article"]] * 2 >= (mass[best["main"]] if "main" in best else 0):
        top = best["article"]
    elif "main" in best:
        return {best["main"]}, True
    elif "article" in best:
        top = best["article"]
    else:
        top = 0
    if top:
        beside = {i for i, k in enumerate(kinds) if k == "article" and parents[i] == parents[top] and mass[i] >= BESIDE * mass[top]}
        return beside, True
    heaviest: dict[int, int] = {}
    for i in range(1, len(parents)):
        if kinds[i] not in ("p", "ul", "ol", "li", *HEADINGS) and mass[i] > mass[heaviest.get(parents[i], i)] - (parents[i] not in heaviest):
            heaviest[parents[i]] = i
    while top in heaviest and mass[heaviest[top]] >= max(1, HOLDS * mass[0]):
        top = heaviest[top]
    return {top}, False


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every row; whole pages are read.

    A null page counts as empty: text is empty then, as it is where nothing but boilerplate stands.
    Repeated rows give repeated rows; null ids and urls stay null.
    """
    small_batches(pages.sparkSession, 256)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x or "") for x in batch.column("html").to_pylist()]
            yield pa.record_batch(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=["page_id", "url", "text", "n_chars"],
            )

    schema = StructType([*pages.select("page_id", "url").schema, StructField("text", StringType()), StructField("n_chars", LongType())])
    return pages.select("page_id", "url", F.col("html").cast("string")).mapInArrow(read, schema)
