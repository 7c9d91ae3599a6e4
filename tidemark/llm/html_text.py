"""Main text of HTML pages by tag-path ratios.

A page is cut into blocks of text, each with the path of block elements from the root to it. Blocks under elements that are
never content (scripts, menus, forms, ...) or whose class, id or role says so leave first. Over the rest, text length,
punctuation and link text are summed per path; the path's score is the log of its text per block, without links, times the
punctuation per block. Scores are smoothed along the page, fused with the shares of the page's text that the path's containers
hold (and with a prior for article and main), and paths over a part of the best score are content. They choose the content
root, the deepest container that holds nearly all of their text. All blocks under the root are kept, lists and tables
included, and blocks of content paths outside it.

Nulls and odd input: null or empty html gives an empty text; text outside any element is a block of the root; unclosed or
crossed tags close as their parents do; what is cut off at the end is read as far as it goes; repeated rows stay rows; columns
of the input are kept, but one named text is replaced; each page is judged by itself, so ties and other pages don't matter.
"""

from __future__ import annotations

import html
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field
from math import exp, log, log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.llm._common import with_arrow

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|textarea|select|iframe|object|math)\b[^>]*+>.*?(?:</\1\s*>|\Z)"
    r"|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
NAMES = re.compile(r"\b(?:class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img".split())
NEVER = frozenset("head title nav footer header aside form button menu dialog figure fieldset".split())
NEVER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising alert alerts banner banners breadcrumb breadcrumbs comment comments commentlist consent contentinfo cookie cookies disqus footer form header login masthead"
    " menu modal nav navbar navigation newsletter notice notices pagination pager popup promo recommended related search share sharing sidebar social sponsor sponsored subscribe toolbar widget complementary".split()
)
#: Words that make a known compound with one of NEVER_NAMES (site-footer, ad-slot), while any other word (has-sidebar) does not.
LAYOUT = frozenset("area bar block bottom box buttons container global icons inner items left links list main page panel posts primary reader readers right row secondary section site slot top unit user users visitor visitors wrap wrapper".split())
#: Elements that no name excludes, and those that can be the content root.
PAGE = frozenset("html body main article".split())
ROOTS = PAGE | frozenset("div section center table tbody tr td".split())
MAIN, MAIN_NAMES = frozenset(("article", "main")), frozenset(("articlebody", "main"))
#: A start tag of the key closes open elements of the values, up to a container.
CLOSES = {t: frozenset(c.split()) for t, c in {"li": "li p", "dt": "dt dd p", "dd": "dt dd p", "tr": "tr td th p", "td": "td th p", "th": "td th p", "option": "option"}.items()}
CLOSES_P = frozenset("address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SCOPE = frozenset("ul ol dl table div section article main body td th blockquote".split())
PUNCTUATION = re.compile(r"[.,;:!?¿¡…。、，！？]")
LEAST, NEARLY_ALL, MAIN_PRIOR, SMOOTHING = 0.15, 0.9, 2.0, [exp(-(d * d) / 2) for d in range(3)]


def excluded(value: str) -> bool:
    """If a class, id or role says that the element is never content: one of its words is in NEVER_NAMES, or a compound of those and of LAYOUT."""
    for word in value.lower().split():
        parts = {x for x in re.split(r"[^a-z0-9]+", word) if x}
        if parts & NEVER_NAMES and parts <= NEVER_NAMES | LAYOUT:
            return True
    return False


@dataclass
class Page:
    """A page's blocks of text, elements and tag paths. Elements and paths are numbered as they open, after a root 0; a parent's number is less than its child's."""

    #: (element, path, never content, in article or main, text, characters in links) of each block, in order.
    blocks: list[tuple[int, int, bool, bool, str, int]] = field(default_factory=list)
    #: Tag and parent of each element, inline ones left out.
    tags: list[str] = field(default_factory=lambda: [""])
    parents: list[int] = field(default_factory=lambda: [0])
    #: Last tag and parent of each tag path.
    last: list[str] = field(default_factory=lambda: [""])
    above: list[int] = field(default_factory=lambda: [0])


def read(page: str) -> Page:
    """Work is in proportion to the page's length, however deep its elements nest."""
    got, paths = Page(), {}
    # (tag, never content, in article or main, number of the last element that is not inline, its path)
    stack: list[tuple[str, bool, bool, int, int]] = [("", False, False, 0, 0)]
    buffer, linked, links, opened = [], 0, 0, Counter()

    def flush() -> None:
        nonlocal linked
        text = " ".join("".join(buffer).split())
        if text:
            _, never, main, number, path = stack[-1]
            got.blocks.append((number, path, never, main, text, linked))
        buffer.clear()
        linked = 0

    def close(to: int) -> None:
        nonlocal links
        for e in stack[to:]:
            links -= e[0] == "a"
            opened[e[0]] -= 1
        del stack[to:]

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw)
        buffer.append(text)
        if links:
            linked += len(text)

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = (m[3] or "").lower()
        if not tag:
            continue
        if tag not in INLINE:
            flush()
        if m[2]:
            if opened[tag]:
                k = len(stack) - 1
                while stack[k][0] != tag and not (tag in INLINE and stack[k][0] not in INLINE):
                    k -= 1
                if stack[k][0] == tag:
                    close(k)
            continue
        if tag in VOID:
            continue
        shut = CLOSES.get(tag, frozenset()) | (frozenset("p") if tag in CLOSES_P else frozenset())
        if any(opened[x] for x in shut):
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] in shut:
                    close(i)
                    break
                if stack[i][0] in SCOPE:
                    break
        if m[4].rstrip().endswith("/") and tag not in INLINE:
            continue
        _, never, main, number, path = stack[-1]
        values = ["".join(n) for n in NAMES.findall(m[4])] if m[4] else []
        hidden = tag in NEVER or (tag not in PAGE and any(map(excluded, values)))
        names = {w for v in values for w in re.split(r"[^a-z0-9]+", v.lower())}
        if tag not in INLINE:
            got.tags.append(tag)
            got.parents.append(number)
            number = len(got.tags) - 1
            if (path, tag) not in paths:
                paths[path, tag] = len(got.last)
                got.last.append(tag)
                got.above.append(path)
            path = paths[path, tag]
        opened[tag] += 1
        stack.append((tag, never or hidden, main or tag in MAIN or bool(names & MAIN_NAMES), number, path))
        links += tag == "a"
    if at < len(page):
        add(re.sub(r"<[a-zA-Z/!][^>]*\Z", "", page[at:]))
    flush()
    return got


def path_scores(page: Page, kept: list[tuple[int, int, bool, bool, str, int]]) -> dict[int, float]:
    """The fused score of each tag path that has blocks."""
    sums: dict[int, list[int]] = defaultdict(lambda: [0, 0, 0, 0])
    for _, path, _, _, text, linked in kept:
        for k, x in enumerate((1, len(text), len(PUNCTUATION.findall(text)), min(linked, len(text)))):
            sums[path][k] += x
    own = {p: log1p(size * (1 - linked / size) / n) * (1 + log1p(marks / n)) for p, (n, size, marks, linked) in sums.items()}
    smooth: dict[int, list[float]] = defaultdict(list)
    for i, block in enumerate(kept):
        near = [(SMOOTHING[abs(i - j)], own[kept[j][1]]) for j in range(max(0, i - 2), min(len(kept), i + 3))]
        smooth[block[1]].append(sum(w * x for w, x in near) / sum(w for w, _ in near))
    # Text under each path, itself left out; then the mean logarithm of the shares of the page's text that the paths above hold.
    under = [0] * len(page.last)
    for p in range(len(under) - 1, 0, -1):
        under[page.above[p]] += under[p] + sums[p][1] if p in sums else under[p]
    total, logs = sum(len(b[4]) for b in kept), [(0.0, 0)] * len(under)
    for p in range(1, len(under)):
        up = page.above[p]
        s, n = logs[up]
        logs[p] = (s + log(under[up] / total), n + 1) if up and under[up] and page.last[up] not in ("html", "body") else (s, n)
    in_main = {b[1] for b in kept if b[3]}
    share = {p: exp(logs[p][0] / logs[p][1]) if logs[p][1] else 0.0 for p in smooth}
    return {p: sum(v) / len(v) * (0.1 + share[p]) * (MAIN_PRIOR if p in in_main else 1) for p, v in smooth.items()}


def main_text(html: str | None) -> str:
    page = read(html or "")
    kept = [b for b in page.blocks if not b[2]]
    if not kept:
        return ""
    fused = path_scores(page, kept)
    least = LEAST * max(fused.values())
    good = {p for p, x in fused.items() if x >= least and x > 0}
    if not good:
        return ""
    held = [0] * len(page.tags)
    for b in kept:
        held[b[0]] += len(b[4]) if b[1] in good else 0
    for e in range(len(held) - 1, 0, -1):
        held[page.parents[e]] += held[e]
    # Elements are numbered as they open, so the last that holds enough is the deepest.
    root = max((e for e in range(len(held)) if held[e] >= NEARLY_ALL * held[0] and (not e or page.tags[e] in ROOTS)), default=0)
    inside = [False] * len(held)
    for e in range(len(held)):
        inside[e] = e == root or inside[page.parents[e]]
    return " ".join(b[4] for b in kept if inside[b[0]] or b[1] in good)


def main_texts(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without html_col, with text."""
    return with_arrow(pages, html_col, lambda: lambda cells: [pa.array([main_text(x) for x in cells.to_pylist()], pa.string())], StructType([StructField("text", StringType())]), drop=True)


def extracted(pages: DataFrame) -> DataFrame:
    """The digest of op3."""
    return main_texts(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
