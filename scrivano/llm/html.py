"""Main text of HTML pages by two-pass block rules.

A page is cut into blocks at block-level tags and at double line breaks. The first pass labels each block by its length, its
density of stop words and the share of its letters that stand in links: long running text is good; blocks that are mostly
links, and long text without stop words, are bad; short text is undecided. Where no listed language fits the page (few of all
its words are stop words) length and links decide alone. In the second pass an undecided block takes the label of its nearest
decided neighbours; a heading that of the next decided block.

Markup is a prior. What stands in elements for menus, page headers and footers, side bars and forms, or in elements whose
class, id or role is made of nothing but words for such things (notices, adverts, reader comments and so on), or is hidden, is bad
and counts as a bad neighbour; but not where a class or a form is around an article or main element or around most of the
page's text. Inside an article or main element links make only lists bad, text without stop words is undecided, and what is
undecided is good; beside one, undecided text is bad.

Null and empty pages give an empty text. Nothing is cut off, whatever the length, and time grows with the length alone.
Repeated pages give repeated results; other columns pass through, as this is a column function.
"""

from __future__ import annotations

import html
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from scrivano.llm.store import claim, small_batches

# Elements, and words of which the names of boilerplate are made.
BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea noscript template iframe noembed noframes xmp".split())
OUTSIDE = frozenset("nav footer aside form menu dialog select button head object svg math canvas audio video".split())
IN_HEAD = frozenset("head base link meta title style script noscript template".split())
LISTS = frozenset("ul ol dl menu dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSED_BY_THEMSELVES = frozenset("p li dt dd option tr td th".split())
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs captcha comment comments commentlist consent contentinfo cookie cookies disqus footer gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice pager pagination popup promo promotion promoted related replies reply respond search share sharing sidebar sidenav signup social sponsor sponsored subscribe subscription toolbar widget complementary".split())
FILLERS = frozenset("and area articles bar block body bottom box button buttons container content form global google group holder icon icons inline inner item items large left link links list main media mobile module new outer page panel policy post posts primary right row secondary section site slot small sticky stories story text the thread this to top unit us user widgets wrap wrapper".split())
#: Common words of English, French, German and Spanish.
STOP = frozenset("a an and are as at be by for from had has have he her his in is it its not of on or that the their they this to was were which with you au aux avec ce dans de des du elle en est et il la le les mais ne nous on ou par pas pour qu que qui sa se ses son sur un une vous aber als am auch auf aus bei das dass dem den der des die ein eine einen er es für hat ich im ist mit nicht noch nur oder sich sie sind so und von war was wie wir zu zum al como con del el ella era este lo los las más me mi muy no para pero por sin sobre su sus también una y ya".split())

#: Letters of a short and of a long block; densities of stop words in good text and in a page of a listed language; most links.
SHORT, LONG, STOP_DENSITY, LISTED_DENSITY, LINK_DENSITY = 70, 200, 0.18, 0.06, 0.5

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s>/]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</([a-zA-Z][^\s>/]*)[^>]*>|<[a-zA-Z!?/][^>]*(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|style|aria-hidden)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)(?=[\s/]|$)""", re.I)
WORD = re.compile(r"[^\W\d_]+")
APART = re.compile(r"[^a-z]+")


class Block(NamedTuple):
    text: str
    links: float  #: share of letters in links
    outside: bool
    article: bool
    listed: bool  #: in a list
    heading: bool


def _named(name: str, passed: frozenset) -> bool:
    """Whether a class, id or role is made of words for boilerplate, and of fillers and numbers, alone."""
    parts = [p for p in APART.split(name) if p]
    return any(p in MARKS and p not in passed for p in parts) and all(p in MARKS or p in FILLERS or len(p) == 1 for p in parts)


def _marked(attributes: str, passed: frozenset) -> tuple[bool, bool]:
    """Whether an element is hidden, and whether its class, id or role names boilerplate."""
    hides = names = False
    for name, a, b, c, hidden in ATTRIBUTE.findall(attributes):
        value, name = (a or b or c).lower(), name.lower()
        hides |= bool(hidden) or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", "")
        names |= name in ("class", "id", "role") and any(_named(x, passed) for x in value.split())
    return hides, names


class _Element:
    """An open element; `out`: boilerplate begins here, which `soft` takes back if it turns out to hold the page's text."""

    __slots__ = ("name", "out", "soft", "main", "listed", "letters", "holds_main")

    def __init__(self, name: str, out: bool, soft: bool, main: bool):
        self.name, self.out, self.soft, self.main, self.listed = name, out, soft, main, name in LISTS
        self.letters, self.holds_main = 0, False


class _Cutter:
    """Cuts a page into blocks. Open elements are found by name through their places, so that no end tag searches for them."""

    def __init__(self):
        self.blocks: list[tuple] = []
        self.parts: list[str] = []
        self.stack: list[_Element] = []
        self.places: dict[str, list[int]] = {}
        self.mains: list[int] = []
        #: Boilerplate elements around the present place, the outermost first.
        self.outs: list[_Element] = []
        self.lists = self.linked = self.breaks = 0
        self.anchor = -1  # depth at which a link is open
        self.heading = False
        self.hard = 0  # elements around the present place that are boilerplate whatever they hold
        self.letters = 0.0  # outside of links, of all blocks in none of those

    def add(self, text: str) -> None:
        if text:
            self.parts.append(text)
            if not text.isspace():
                self.breaks = 0
                self.linked += len(text) if self.anchor >= 0 else 0

    def end(self) -> None:
        """Ends the open block."""
        if self.parts:
            words = html.unescape("".join(self.parts)).split()
            if words:
                text = " ".join(words)
                links = min(1.0, self.linked / len(text))
                free = len(text) * (1 - links)
                if not self.hard:
                    self.letters += free
                for x in self.outs[:4]:  # deeper ones hold no more than these
                    x.letters += free
                self.blocks.append((text, links, tuple(self.outs[:4]), bool(self.mains), self.lists > 0, self.heading))
            self.parts.clear()
        self.linked = self.breaks = 0

    def open(self, name: str, attributes: str) -> None:
        inside = bool(self.mains)
        hidden, named = _marked(attributes, frozenset(["header"]) if inside else frozenset()) if attributes and name not in ("html", "body") else (False, False)
        if name in ("article", "main") and not inside:
            named = False  # an article in an article may be a reader's comment
        hard = hidden or name in OUTSIDE and name != "form" or name == "header" and not inside
        x = _Element(name, hard or named or name == "form", not hard, name in ("article", "main") and not hidden and not named)
        if x.main and not self.hard:
            for o in self.outs[:4]:
                o.holds_main = True
        if x.out:
            if name not in BLOCKS:
                self.end()
            self.outs.append(x)
            self.hard += not x.soft
        if x.main:
            self.mains.append(len(self.stack))
        self.lists += x.listed
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append(x)

    def pop(self) -> None:
        x = self.stack.pop()
        self.places[x.name].pop()
        if x.out:
            if x.name not in BLOCKS:
                self.end()
            self.outs.pop()
            self.hard -= not x.soft
        if x.main:
            self.mains.pop()
        self.lists -= x.listed
        if self.anchor > len(self.stack):
            self.anchor = -1

    def close(self, name: str) -> None:
        at = self.places.get(name)
        # A stray end tag closes nothing, and none but these closes an article from inside.
        if at and (not self.mains or at[-1] >= self.mains[-1] or name in ("body", "html", "main", "article")):
            depth = at[-1]
            if any(x.out for x in self.stack[depth:]):
                self.end()
            while len(self.stack) > depth:
                self.pop()


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order."""
    c, at, raw = _Cutter(), 0, page.lower()
    same = len(raw) == len(page)
    while m := TAG.search(page, at):
        c.add(page[at : m.start()])
        at = m.end()
        opened, attributes, closed = m[1], m[2], m[3]
        if opened:
            name = opened.lower()
            if name == "br":
                c.breaks += 1
                if c.breaks > 1:
                    c.end()
                    c.breaks = 1
                else:
                    c.parts.append(" ")
                continue
            if name in RAW:
                stop = raw.find(f"</{name}", at) if same else next((x.start() for x in re.compile(f"</{name}", re.I).finditer(page, at)), -1)
                at = len(page) if stop < 0 else page.find(">", stop) + 1 or len(page)
                continue
            if name in BLOCKS:
                c.end()
                if name not in IN_HEAD and c.stack and c.stack[-1].name == "head":
                    c.pop()
                c.heading = name in HEADINGS
            if name in VOID or attributes.endswith("/") and name not in BLOCKS:
                continue
            if name == "a":
                c.anchor = len(c.stack)
            elif name in BLOCKS or name in OUTSIDE or attributes:
                if name in CLOSED_BY_THEMSELVES and c.stack and c.stack[-1].name == name:
                    c.pop()
                c.open(name, attributes)
        elif closed:
            name = closed.lower()
            if name == "a":
                c.anchor = -1
                continue
            if name in BLOCKS or name in OUTSIDE:
                c.end()
                c.heading = False
            c.close(name)
    c.add(page[at:])
    c.end()

    def drops(x: _Element) -> bool:
        return not x.soft or not x.holds_main and 2 * x.letters <= c.letters

    return [Block(text, links, any(map(drops, outs)), article, listed, heading) for text, links, outs, article, listed, heading in c.blocks]


def first_pass(found: list[Block]) -> list[bool | None]:
    """Each block's label by its own length, stop words and links: good, bad or undecided."""
    counts = []
    for b in found:
        words = WORD.findall(b.text.lower())
        counts.append((sum(w in STOP for w in words), len(words)))
    inside = [n for n, b in zip(counts, found) if not b.outside]
    stops, total = sum(s for s, _ in inside), sum(n for _, n in inside)
    known = stops >= LISTED_DENSITY * total
    labels: list[bool | None] = []
    for b, (stop, words) in zip(found, counts):
        n = len(b.text)
        if b.outside or b.links > LINK_DENSITY and (b.listed or not b.article):
            labels.append(False)
        elif n < SHORT:
            labels.append(None)
        elif known:
            labels.append(True if stop >= STOP_DENSITY * max(1, words) else False if n >= LONG and not b.article else None)
        else:
            labels.append(True if n >= LONG else None)
    return labels


def second_pass(found: list[Block], labels: list[bool | None]) -> list[bool]:
    """Undecided blocks take the label of their nearest decided neighbours, headings that of the next, articles' blocks are good."""
    n = len(labels)
    far = n + 1
    before, after = [-far] * n, [2 * far] * n
    last = -far
    for i in range(n):
        last = i if labels[i] is not None else last
        before[i] = last
    last = 2 * far
    for i in range(n - 1, -1, -1):
        last = i if labels[i] is not None else last
        after[i] = last
    beside = any(b.article and not b.outside and label is not False for b, label in zip(found, labels))
    out = []
    for i, b in enumerate(found):
        good = labels[i]
        if good is None:
            if b.article or beside:
                good = b.article
            elif b.heading and after[i] < n:
                good = labels[after[i]]
            else:
                near = min(i - before[i], after[i] - i)
                nearest = [labels[j] for j in (before[i], after[i]) if abs(i - j) == near and near < far]
                good = any(nearest) or not nearest
        out.append(bool(good))
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    found = blocks(page)
    return "\n".join(b.text for b, good in zip(found, second_pass(found, first_pass(found))) if good)


def extract(spark: SparkSession, page: Column) -> Column:
    """The main text of a page; empty where there is none."""
    small_batches(spark)

    @F.arrow_udf("string")
    def run(pages: pa.Array) -> pa.Array:
        claim("html")
        return pa.array([main_text(x) for x in pages.to_pylist()], pa.string())

    return run(page)
