"""Main text of web pages by line-block distribution.

A page is stripped of markup and of what its own structure marks as not being
the article; every block-level boundary ends a line.  Over sliding windows of
lines the text lengths are summed.  The text surges where a window passes the
threshold and dives where the windows have fallen to nothing; the surge with
most text, from its first long line to its last, is the body.  Elements can only
widen it: to the article or main that holds it, or to the element in which its
long lines themselves stand, so that other surges of the same article and short
paragraphs at either end stay whole.  Where its long lines stand in several
elements, headings before it and paragraphs after it are all that joins it.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.runtime import per_text

#: Lines in a window, and the characters with which a window is a surge.
WINDOW = 3
SURGE_CHARS = 80
#: Characters of a long line, which is a surge by itself.
LONG_LINE = SURGE_CHARS

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|iframe|svg|math|object|title)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S | re.I,
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output q s samp small span strike strong sub sup time tt u var wbr img".split())
SKIPPED = frozenset("head nav aside footer form select button dialog menu audio video canvas fieldset".split())
#: Elements that can hold a whole body.
HOLDERS = frozenset("article main section div td body html".split())
SKIPPED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
WORDS = (
    r"ads?|advert\w*|adsense|adbox|sponsor\w*|promo\w*|promotion\w*|banner\w*|commercial"
    r"|nav|navbar|navigation|menu\w*|breadcrumbs?|crumbs?|pagination|pager|toc|skip"
    r"|header|masthead|topbar|footer|foot|copyright|legal|colophon"
    r"|sidebar\w*|side|aside|rail|widgets?|related|recommend\w*|popular|trending|tags?|taglist"
    r"|notice\w*|cookies?|consent|gdpr|popup|modal|overlay|alert|newsletter|subscribe|subscription|signup|login|paywall"
    r"|comments?|commentlist|replies|respond|disqus|discussion|reviews?"
    r"|share|sharing|social|search|form|hidden"
)
NAMED = re.compile(rf"(?:^|[\s_-])(?:{WORDS})(?=$|[\s_-])", re.I)
MARK = re.compile(r"""\b(class|id|role|hidden|style)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)


HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
NO, MODIFIED, YES = range(3)


def _mark(name: str, attrs: str, inside_article: bool) -> int:
    """Whether an element is marked as not being part of the article.

    ``MODIFIED``: only by a word within a class or id that starts with another, as in ``has-sidebar``.
    """
    if name in SKIPPED or name == "header" and not inside_article:
        return YES
    if not attrs or name in ("html", "body", "article", "main"):
        return NO
    found = NO
    for key, *values in MARK.findall(attrs):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            value = re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value)
            if NAMED.search(value):
                if any(NAMED.match(x) for x in value.split()):
                    return YES
                found = MODIFIED
        if key == "role" and value.lower() in SKIPPED_ROLES or key == "hidden" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return YES
    return found


Path = tuple[tuple[int, str], ...]
Line = tuple[str, Path, str]


def lines_of(html: str) -> list[Line]:
    """(text, holders around it, innermost element) of each block outside marked elements; holders are numbered in page order.

    An element marked by a modifier stays if no article or main is outside it
    and it holds one, or most of the text.
    """
    lines, modified, articles, chars = _lines(html, frozenset())
    gone = frozenset(at for at, (inside, size) in modified.items() if articles > inside or not inside and 2 * size <= chars)
    return _lines(html, gone)[0] if gone else lines


def _lines(html: str, gone: frozenset[int]) -> tuple[list[Line], dict[int, list[int]], int, int]:
    """The lines without the modified elements that start at ``gone``; (articles, characters) in each other one, and of the page."""
    lines: list[Line] = []
    modified: dict[int, list[int]] = {}
    within: list[tuple[int, int]] = []  # open modified elements: depth in the stack, start
    started = chars = 0
    stack: list[tuple[str, bool]] = []  # block elements: name, marked
    open_: Counter[str] = Counter()  # how many of each name are in the stack
    path: list[tuple[int, str]] = []  # the open holders
    here: Path | None = ()  # ``path`` as lines keep it, or None when that has changed
    holders: list[int] = []  # depths in the stack of the open holders
    text: list[str] = []
    skipped = articles = number = at = 0

    def end_line():
        nonlocal chars, here
        if text:
            line = " ".join(unescape("".join(text)).split())
            text.clear()
            if line:
                here = tuple(path) if here is None else here
                lines.append((line, here, stack[-1][0] if stack else ""))
                chars += len(line)
                for _, start in within:
                    modified[start][1] += len(line)

    def pop():
        nonlocal skipped, articles, here
        name, marked = stack.pop()
        open_[name] -= 1
        skipped -= marked
        articles -= name in ("article", "main")
        if within and within[-1][0] == len(stack):
            within.pop()
        if holders and holders[-1] == len(stack):
            holders.pop()
            path.pop()
            here = None

    for m in TOKEN.finditer(html):
        if not skipped and m.start() > at:
            text.append(html[at : m.start()])
        at = m.end()
        name = m["name"]
        if not name:
            continue
        name = name.lower()
        if name in INLINE and not m["attrs"]:
            continue
        if m["close"]:
            if name in INLINE and not open_[name]:
                continue
            end_line()
            if open_[name]:
                while stack[-1][0] != name:
                    pop()
                pop()
            continue
        mark = _mark(name, m["attrs"], articles > 0)
        marked = mark == YES or mark == MODIFIED and m.start() in gone
        if name in INLINE and not mark:
            continue
        end_line()
        if name in VOID or m["attrs"].endswith("/"):
            continue
        if name in ("p", "li", "td", "tr", "dt", "dd", "option") and stack and stack[-1][0] == name:
            pop()
        if name in HOLDERS and not marked:
            number += 1
            path.append((number, name))
            here = None
            holders.append(len(stack))
        if mark == MODIFIED and not marked and not skipped:
            within.append((len(stack), m.start()))
            modified[m.start()] = [0, 0]
        stack.append((name, marked))
        open_[name] += 1
        skipped += marked
        if name in ("article", "main"):
            articles += 1
            if not skipped:
                started += 1
                for _, start in within:
                    modified[start][0] += 1
    if not skipped and at < len(html):
        text.append(html[at:])
    end_line()
    return lines, modified, started, chars


def surges(sizes: list[int], window: int = WINDOW, least: int = SURGE_CHARS) -> list[tuple[int, int]]:
    """The runs of lines from a surge to its dive; that with most text is the first."""
    n = len(sizes)
    blocks = [sum(sizes[i : i + window]) for i in range(n)]
    least = min(least, max(blocks, default=0))
    runs, i = [], 0
    while i < n:
        if blocks[i] < least or not sizes[i]:
            i += 1
            continue
        j = i
        while j < n and blocks[j] >= min(least, blocks[i]) // 2:
            j += 1
        j = min(n, max(j, i + 1))
        runs.append((i, j))
        i = j
    return sorted(runs, key=lambda r: -sum(sizes[slice(*r)]))


def _holding(body: list[Line], kind: str) -> Path:
    """The path to the outermost element of ``kind`` with over half of the text, if lines are in no second one; else empty."""
    sizes: dict[Path, int] = {}
    for text, path, _ in body:
        at = next((i for i, (_, name) in enumerate(path, 1) if name == kind), 0)
        sizes[path[:at]] = sizes.get(path[:at], 0) + len(text)
    out = sizes.pop((), 0)
    return next((p for p, n in sizes.items() if n > out), ()) if len(sizes) == 1 else ()


def _common(paths: list[Path]) -> Path:
    low, high = min(paths), max(paths)
    n = 0
    while n < min(len(low), len(high)) and low[n] == high[n]:
        n += 1
    return low[:n]


def main_text(data: bytes | None) -> str:
    """The main text of a page; empty if it has none."""
    lines = lines_of(data.decode()) if data else []
    if not lines:
        return ""
    (start, end), *others = surges([len(t) for t, _, _ in lines])
    long = [i for i in range(start, end) if len(lines[i][0]) >= LONG_LINE] or range(start, end)
    start, end = long[0], long[-1] + 1
    body = [lines[i] for i in long]
    common = _common([path for _, path, _ in body])
    whole = _holding(body, "article") or _holding(body, "main")
    if whole:
        return _joined(lines, whole)
    names = [name for _, name in common]
    if names[-1:] == ["section"] and names[-2:-1] not in ([], ["body"], ["html"]):
        # Sections of one element are one text where another of them surges too.
        if any(path[: len(common) - 1] == common[:-1] for a, b in others for _, path, _ in lines[a:b]):
            return _joined(lines, common[:-1])
    inside = sum(len(t) for t, path, _ in body if path == common)
    if names[-1:] not in ([], ["body"], ["html"]) and 2 * inside > sum(len(t) for t, _, _ in body):
        return _joined(lines, common)
    while start and lines[start - 1][2] in HEADINGS:
        start -= 1
    while end < len(lines) and lines[end][2] == "p" and lines[end][1][: len(common)] == common:
        end += 1
    return _joined(lines[start:end], ())


def _joined(lines: list[Line], inside: Path) -> str:
    return " ".join(t for t, path, _ in lines if path[: len(inside)] == inside)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """``id_col``, the columns ``keep``, ``text`` and ``n_chars`` (code points) of every row's whole page.

    A null or empty page has an empty text; repeated rows stay; an empty table
    gives none.  Other columns are not read.
    """
    both = pages.select(F.struct(id_col, *keep).alias("k"), F.col(html_col).alias("t"))

    def kernel(data: bytes | None):
        text = main_text(data)
        return text, len(text)

    return per_text(both, "k", "t", kernel, "text string, n_chars long").select(*(F.col(f"k.{c}").alias(c) for c in (id_col, *keep)), "text", "n_chars")
