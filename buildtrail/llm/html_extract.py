"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block element that holds text. A line weighs its length, or nothing where
markup says that it isn't the article: text in navigation, forms, adverts and the like (by element, role, class or id),
outside the article where the page names one (article, main), or mostly links. Weights are summed over sliding windows of
``WINDOW`` lines. A surge point is where a window's sum reaches the threshold (any weight in a named article, ``SURGE``
characters elsewhere), a dive point where it falls to nothing. What weighs between a surge and its dive is kept.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import LongType, StringType, StructType

from buildtrail.ship import ship

WINDOW, SURGE, LINKS = 3, 80, 0.6

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody tfoot thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = frozenset("nav footer aside form head menu button select dialog object audio video canvas datalist".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROOTS = frozenset("article main".split())
ROLES = frozenset("navigation banner complementary contentinfo search form alert alertdialog dialog menu menubar toolbar".split())
# Words of class names and ids that mark what isn't the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adbox banner banners breadcrumb breadcrumbs byline-share comment comments commentlist consent cookie cookies"
    " disclaimer disqus footer gdpr header login masthead menu menus modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall"
    " popup promo promoted promotion related recommend recommended recommendations replies reply respond search share sharing sidebar sidebars signup skip skyscraper"
    " social sponsor sponsored sponsors subscribe subscription tags teaser toolbar topbar widget widgets".split()
)
# Names that mark such parts also in compounds, and what may stand beside them there.
STRONG = frozenset("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer menu modal nav navbar navigation newsletter popup promo related sidebar signup sponsor sponsored subscribe".split())
PLACES = frozenset("area bar block bottom box container global inner left list page right section site slot top user wrapper".split())

#: Quotes part a value only after "=" and where they are closed. Nothing is tried twice, so time is in proportion to the page.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|svg)\b[^>]*+(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|<(/?)([a-z][^\s/>]*+)((?>[^>\"'=]+|=\s*\"[^\"]*\"|=\s*'[^']*'|[\"'=])*+)(?:>|\Z)|<[!?][^>]*+(?:>|\Z)|</[^a-z>][^>]*+(?:>|\Z)|</?(?:>|\Z)",
    re.S | re.I,
)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
SPACE = re.compile(r"\s+")


def _marks(word: str) -> bool:
    """Whether a class name or id marks boilerplate: one of NAMES, a compound of them, or a strong one with a place."""
    if word in NAMES:
        return True
    parts = [p for p in re.split(r"[-_]+", word) if p]
    return len(parts) > 1 and (NAMES.issuperset(parts) or not STRONG.isdisjoint(parts) and (NAMES | PLACES).issuperset(parts))


def _is_boilerplate(name: str, attributes: str, in_root: bool) -> bool:
    if name in SKIPPED or name == "header" and not in_root:
        return True
    if not attributes or name in ("html", "body") or name in ROOTS:
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
        if key == "hidden" or key == "aria-hidden" and value == "true":
            return True
        if key == "role" and value in ROLES or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True
        if (key == "class" or key == "id" and name not in HEADINGS) and any(_marks(word) for word in value.split()):
            return True
    return False


class Line:
    __slots__ = ("parts", "links", "rooted", "skipped")

    def __init__(self, rooted: bool, skipped: bool):
        self.parts: list[str] = []
        self.links = 0
        self.rooted, self.skipped = rooted, skipped

    def text(self) -> str:
        return SPACE.sub(" ", html.unescape("".join(self.parts))).strip()


class Open:
    """The open elements: (name, whether it is in boilerplate, whether it is in the article); a close that fits none costs no search."""

    def __init__(self):
        self.stack: list[tuple[str, bool, bool]] = []
        self.blocks: Counter[str] = Counter()
        self.inline: list[Counter[str]] = [Counter()]  # names opened since each open block
        self.aside: int | None = None  # place of the inline element that boilerplate began with, where it is one

    def state(self) -> tuple[bool, bool]:
        return self.stack[-1][1:] if self.stack else (False, False)

    def in_aside(self) -> bool:
        """Whether all here is an inline part in boilerplate, whose blocks don't end the line around it."""
        return self.aside is not None and self.state()[0]

    def push(self, name: str, skipped: bool, rooted: bool) -> None:
        if skipped and not self.state()[0] and name not in BLOCKS and self.aside is None:
            self.aside = len(self.stack)
        self.stack.append((name, skipped, rooted))
        if name in BLOCKS:
            self.blocks[name] += 1
            self.inline.append(Counter())
        else:
            self.inline[-1][name] += 1

    def pop(self) -> str:
        name = self.stack.pop()[0]
        if self.aside is not None and len(self.stack) <= self.aside:
            self.aside = None
        if name in BLOCKS:
            self.blocks[name] -= 1
            self.inline.pop()
        else:
            self.inline[-1][name] -= 1
        return name

    def close(self, name: str) -> None:
        if (self.blocks if name in BLOCKS else self.inline[-1])[name]:
            while self.pop() != name:
                pass

    def close_like(self, name: str) -> None:
        """p, li and their like end one of their own that is open right here."""
        for depth in range(1, min(4, len(self.stack)) + 1):
            if self.stack[-depth][0] == name:
                for _ in range(depth):
                    self.pop()
                return
            if self.stack[-depth][0] in BLOCKS:
                return


def lines_of(page: str) -> list[Line]:
    """One line for each block of the page that holds text, in order."""
    out: list[Line] = []
    open_ = Open()
    now = Line(False, False)
    links = at = 0

    def turn() -> None:
        nonlocal now
        if any(not p.isspace() for p in now.parts):
            out.append(now)
        skipped, rooted = open_.state()
        now = Line(rooted, skipped)

    def say(text: str) -> None:
        """Put text to the line. An inline part in boilerplate is left out of a line that isn't, and what follows it goes on in the same line."""
        if not text:
            return
        skipped = open_.state()[0]
        if skipped != now.skipped and not text.isspace():
            if not any(not p.isspace() for p in now.parts):
                now.skipped = skipped
            elif not skipped:
                turn()
        if not skipped or now.skipped:
            now.parts.append(text)
            if links:
                now.links += len(text.strip())

    for m in TOKEN.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        closing, attributes = bool(m[2]), m[4] or ""
        if name in ("br", "td", "th"):
            now.parts.append(" ")
        if name == "a":
            links = 0 if closing else 1
        if closing:
            open_.close(name)
            if name in BLOCKS and not open_.in_aside():
                turn()
            continue
        if name in VOID or attributes.endswith("/") and name not in BLOCKS:
            if name == "hr":
                turn()
            continue
        skipped, rooted = open_.state()
        if name in ROOTS and not rooted:
            comment = _is_boilerplate("div", attributes, False)
            skipped, rooted = comment, not comment  # an article ends what was left open before it
        else:
            if name in ("p", "li", "dt", "dd", "tr", "option"):
                open_.close_like(name)
                skipped, rooted = open_.state()
            skipped = skipped or _is_boilerplate(name, attributes, rooted)
        open_.push(name, skipped, rooted)
        if name in BLOCKS and not open_.in_aside():
            turn()
    say(page[at:])
    turn()
    return out


def surges(weights: list[int], least: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """(first, end) of the lines from each surge to its dive; lines that lead to a surge without a gap are part of it."""
    n = len(weights)
    total = [0, *accumulate(weights)]
    sums = [total[min(n, i + window)] - total[i] for i in range(n)]
    out: list[tuple[int, int]] = []
    i = 0
    while i < n:
        if not weights[i] or sums[i] < least[i]:
            i += 1
            continue
        start = end = i
        while start and weights[start - 1]:
            start -= 1
        while end < n and sums[end]:
            end += 1
        out.append((start, end))
        i = end
    return out


def main_text(page: str | None, surge: int = SURGE, window: int = WINDOW) -> list[str]:
    """The blocks between surge and dive points."""
    lines = [(x, t) for x in lines_of(page or "") if (t := x.text())]
    named = any(x.rooted and not x.skipped for x, _ in lines)

    def weight(x: Line, text: str) -> int:
        return 0 if x.skipped or (not x.rooted if named else x.links > LINKS * len(text)) else len(text)

    weights = [weight(x, t) for x, t in lines]
    most = max((sum(weights[i : i + window]) for i in range(len(weights))), default=0)
    least = [1 if named else min(surge, most)] * len(weights)
    return [lines[i][1] for a, b in surges(weights, least, window) for i in range(a, b) if weights[i]]


def extract(pages: DataFrame, html_col: str = "html", text_col: str = "text", joint: str = "\n\n") -> DataFrame:
    """pages less html_col, with text_col (blocks joined by ``joint``, "" if none) and n_chars; columns of these names are replaced.

    Null, empty or unreadable html gives ""; every row gives a row.
    """
    ship(pages.sparkSession)
    others = [c for c in pages.columns if c not in (html_col, text_col, "n_chars")]
    picked = pages.select(*others, pages[html_col].cast("string").alias(html_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [joint.join(main_text(x.as_py())) for x in batch.column(len(others))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*others, text_col, "n_chars"])

    schema = StructType([pages.schema[c] for c in others]).add(text_col, StringType()).add("n_chars", LongType())
    return picked.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
