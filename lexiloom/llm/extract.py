"""The main text of web pages by line-block distribution.

A page's markup is stripped into lines: one per block element, in page order, white space in
it turned into one space, character references decoded. A line knows the elements it stands in,
so that it is dead where one of them is no article text by its tag, role or class (menus, page
headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden parts, reader
comments). A live line weighs its text without its links' text, a line of mostly links nothing.
Weights are summed over sliding windows of ``WINDOW`` lines. Text surges where the sum rises
above ``SURGE`` characters and dives where it falls to nothing; of the stretches between, the
one with most text is the page's core.

Where an ``article`` or ``main`` element holds at least half of the core, the surge and dive
points move to the ends of the innermost such element, so that its short first and last
paragraphs stay; else the stretches of the core and of its neighbours with a like share of text
(``LIKE`` of the core's) stay. All live lines from surge to dive stay, links among them too.

Defined cases: null and empty pages give an empty text; a page without markup is one line; a
page whose lines are all lighter than ``SURGE`` has its heaviest stretch as the core; unclosed
elements end with their parent, ``p``, ``li`` and the like also where the next one begins; an
unclosed comment, script or style runs to the end of the page; a tag cut off by the page's end
is dropped. Repeated pages give repeated rows. Pages are independent, so nothing is shuffled.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

WINDOW = 3  # lines
SURGE = 86  # characters in a window
LIKE = 0.3  # share of the core's text that another stretch needs where no element marks the article

_TAG = re.compile(r"""<(?:!--.*?(?:-->|--!>|\Z)|[!?][^>]*(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|/?[a-zA-Z][^>]*(?:>|\Z))""", re.S)
_NAME = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_PART = re.compile(r"[a-z0-9]+|[A-Z]+(?![a-z])|[A-Z][a-z0-9]*")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Their content isn't markup; it ends at their own end tag only.
RAW = frozenset("script style textarea title noembed noframes iframe xmp".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark math meter nobr output picture progress q "
    "rp rt ruby s samp small span strike strong sub sup time tt u var wbr br input select button svg td th".split()
)
DEAD_TAGS = frozenset("head script style title noscript template nav footer aside form button select input textarea label menu dialog iframe object svg canvas audio video noembed noframes".split())
DEAD_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
DEAD_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar sidenav widget widgets menu submenu nav navbar navigation "
    "breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe subscription signup login share sharing "
    "social related recommended recommendations comment comments commentlist respond reply replies disqus pagination pager toolbar skip copyright alert banner form search".split()
)
#: Elements that a class can't make dead: a page or article as a whole, and its headings.
WHOLE = frozenset("html body article main h1 h2 h3 h4 h5 h6".split())
#: Elements that end where one of their kind begins, and the elements that hide an open one.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


def is_dead(tag: str, attributes: str, in_article: bool) -> bool:
    """Whether an element is none of the article's text, by its own tag and attributes."""
    if tag in DEAD_TAGS or (tag == "header" and not in_article):
        return True
    if not attributes or attributes.isspace():
        return False
    found = {}
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        found.setdefault(name.lower(), a or b or c)
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower():
        return True
    if found.get("role", "").lower() in DEAD_ROLES:
        return True
    if tag in WHOLE and not (tag == "article" and in_article):
        return False
    words = {w.lower() for w in _PART.findall(f"{found.get('class', '')} {found.get('id', '')}")}
    return bool(words & DEAD_WORDS) or (not in_article and "header" in words)


class Line:
    """A block's text, its length without links, whether it is dead, and its article elements."""

    __slots__ = ("holders", "text", "weight")

    def __init__(self, text: str, weight: int, holders: tuple[int, ...]):
        self.text, self.weight, self.holders = text, weight, holders


def lines(page: str) -> list[Line]:
    """The live lines of a page, and a None for each run of dead text between them."""
    out: list[Line | None] = []
    open_: list[tuple[str, bool, int]] = []  # tag, dead, number of the article element or 0
    text: list[str] = []
    linked: list[str] = []
    dead = links = elements = 0
    at, n, lower = 0, len(page), None

    def add(piece: str) -> None:
        if dead:
            if out and out[-1] is not None and not text and not piece.isspace():
                out.append(None)
            return
        text.append(piece)
        if links:
            linked.append(piece)

    def end_line() -> None:
        if not text:
            return
        whole = " ".join(references.unescape("".join(text)).split())
        if whole:
            in_links = len(" ".join(references.unescape("".join(linked)).split())) if linked else 0
            weight = 0 if 2 * in_links > len(whole) else len(whole) - in_links
            out.append(Line(whole, weight, tuple(e for _, _, e in open_ if e)))
        text.clear()
        linked.clear()

    def close(depth: int) -> None:
        nonlocal dead, links
        if len(open_) > depth and any(t not in INLINE for t, _, _ in open_[depth:]):
            end_line()
        while len(open_) > depth:
            tag, was_dead, _ = open_.pop()
            dead -= was_dead
            links -= tag == "a"

    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            add(page[at:])
            break
        found = _TAG.match(page, begin)
        if not found:  # a lone "<" is text
            add(page[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            add(page[at:begin])
        at = found.end()
        closing, name, attributes = found.group(1, 2, 3)
        if name is None:
            broken = _NAME.match(found.group())
            if broken is None or not found.group().endswith(">"):
                continue  # a comment, a declaration or a tag cut off by the end
            closing, name, attributes = "/" if found.group()[1] == "/" else "", broken.group(1), ""
        name = name.lower()
        if closing:
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][0] == name:
                    close(depth)
                    break
            else:
                if name not in INLINE:
                    end_line()
            if name in ("td", "th"):
                add(" ")
            continue
        if name in RAW:
            lower = page.lower() if lower is None else lower
            end = lower.find("</" + name, at) if len(lower) == n else -1
            if len(lower) != n:  # lower-casing changed the length: search without it
                again = re.compile("</" + name, re.I).search(page, at)
                end = again.start() if again else -1
            close_at = page.find(">", end) if end >= 0 else -1
            if name not in INLINE:
                end_line()
            at = n if close_at < 0 else close_at + 1
            continue
        if name not in INLINE:
            for depth in range(len(open_) - 1, -1, -1):  # a block ends an open paragraph
                if open_[depth][0] == "p":
                    close(depth)
                    break
                if open_[depth][0] not in INLINE:
                    break
        if name in SIBLINGS:
            kin, walls = SIBLINGS[name]
            for depth in range(len(open_) - 1, -1, -1):
                if open_[depth][0] in kin:
                    close(depth)
                    if name != "tr" or open_ and open_[-1][0] not in kin:
                        break
                elif open_[depth][0] in walls:
                    break
        if name not in INLINE:
            end_line()
        if name in VOID:
            if name in ("br", "img", "wbr"):
                add(" " if name != "wbr" else "")
            continue
        in_article = any(e for _, _, e in open_)
        gone = is_dead(name, attributes, in_article)
        if gone:
            add(" ")
        number = 0
        if not gone and (name in ("article", "main") or re.search(r"""role\s*=\s*["']?(?:main|article)\b""", attributes)):
            elements += 1
            number = elements
        if not attributes.rstrip().endswith("/") or name not in ("svg", "path", "span", "div", "a"):
            open_.append((name, gone, number))
            dead += gone
            links += name == "a"
    end_line()
    return out


def stretches(weights: list[int]) -> list[tuple[int, int]]:
    """The runs [surge, dive) of lines that sliding windows of weights find."""
    n = len(weights)
    sums = [sum(weights[i : i + WINDOW]) for i in range(n)]
    level = SURGE if max(sums, default=0) > SURGE else 0
    out, i = [], 0
    while i < n:
        if sums[i] <= level or not weights[i]:
            i += 1
            continue
        j = i
        while j < n and sums[j] > 0:
            j += 1
        out.append((i, j))
        i = j
    return out


def main_text(page: str) -> str:
    """The page's main text, its blocks joined by one line break; empty if there is none."""
    found = lines(page)
    weights = [0 if line is None else line.weight for line in found]
    runs = stretches(weights)
    if not runs:  # nothing but links, or nothing
        held = [i for i, line in enumerate(found) if line is not None and line.holders]
        return "\n".join(found[i].text for i in held)
    mass = lambda run: sum(weights[run[0] : run[1]])
    core = max(runs, key=mass)
    inside: dict[int, int] = {}
    for line, weight in zip(found[core[0] : core[1]], weights[core[0] : core[1]]):
        for holder in line.holders if line is not None else ():
            inside[holder] = inside.get(holder, 0) + weight
    holders = [h for h, weight in inside.items() if 2 * weight >= mass(core)]
    if holders:
        innermost = max(holders)  # numbered as they open
        kept = [line.text for line in found if line is not None and innermost in line.holders]
    else:
        like = [run for run in runs if mass(run) >= LIKE * mass(core)]
        kept = [line.text for a, b in like for line in found[a:b] if line is not None]
    return "\n".join(kept)


def _extract(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in source:
        texts = [main_text(page.as_py() or "") for page in batch.column("html")]
        out = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(out, names=["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page (page_id, url, html); other columns aren't read."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return scratch.arrow(rows, _extract, "page_id long, url string, text string, n_chars long")
