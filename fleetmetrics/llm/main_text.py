"""Main text of web pages by tag-path ratios.

Every text node has a path of tags from the root. Text length and punctuation are summed per path
and divided by its nodes; the two ratios are smoothed over the nodes in page order, fused by their
geometric mean, and paths above the spread of the page are content. The region of the article is the
article element that holds the content, or else is found from the root down: an element is entered as
long as it holds most of the content, each text on content paths weighing by its length and its path's
ratio. Parts of the region whose text is mostly not on content paths go; headings, lists and short
paragraphs between content belong to it. Elements that are never an article's text (menus, notices, adverts, comments, ...) are left
out first, by tag name or by a word of their class, id or role. A name alone does not decide: a named
element or form that wraps the page's article, or nearly all text on paths above the threshold, is no
such element, and neither is a section of an article, named by its id, whose text is above it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|title|iframe|svg|select|object|canvas)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][\w:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][\w:-]*+)([^>]*+)>|<[!?/][^>]*+>", re.DOTALL | re.IGNORECASE)
_NAMES = re.compile(r"\b(?:class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_ID = re.compile(r"\bid\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'>]+)", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr label img math mi mn mo ms mtext mrow msup msub msubsup mfrac msqrt mroot mover munder semantics annotation".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element of these ends where one of the same group begins.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = frozenset("ul ol dl table article section main div body html td th aside nav footer header form blockquote".split())
NEVER = frozenset("head nav aside footer button dialog menu menuitem fieldset select datalist map audio video".split())
#: Words of a class, id or role that name something beside the article.
BESIDE = frozenset(
    """ad ads advert adverts advertisement advertising advertorial adsense banner promo promos promotion promoted sponsor sponsored sponsors outbrain taboola dfp
    nav navbar navigation navi menu menus submenu breadcrumb breadcrumbs pagination pager toolbar topbar tabs toc skip
    footer foot colophon copyright legal imprint masthead header sitehead
    sidebar sidebars side rail aside widget widgets complementary
    cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay disclaimer paywall
    newsletter subscribe subscription signup login signin register search searchbox form feedback survey
    comment comments commentlist disqus respond reply replies discussion responses
    share sharing social follow related recommended recommendations recommend teaser teasers trending popular tagcloud""".split())
#: Readers' text, which reads as the article's does.
READERS = frozenset("comment comments commentlist disqus respond reply replies responses".split())
#: Of the text above the threshold outside the other named elements, the share of a wrapper (all, if a whole token names it).
WRAPPER = 0.8
#: A header with one of these before it is the article's own.
OWN = frozenset("article content entry post story".split())
REGION = frozenset({"article", "main"})
#: The share of the content that an element must hold to be entered, and blocks that are text, not parts.
MOST = 0.75
TEXT_BLOCKS = HEADINGS | frozenset("p li blockquote pre ul ol dl table tr td".split())
_WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|[A-Z]+(?![a-z])")
PUNCTUATION = re.compile(r"[.,;:!?…،。，、؛؟¿¡]")


def _beside(attributes: str) -> tuple[bool, bool] | None:
    """Whether a word of a name is beside the article: (is a whole token, is of readers' text)."""
    found = None
    for m in _NAMES.finditer(attributes):
        value = m[1] or m[2] or m[3] or ""
        for token in value.split():
            words = [w.lower() for w in _WORDS.findall(token)]
            if len(words) > 1 and words[0] in OWN and words[-1] == "header":
                continue
            if words and (words[0] in BESIDE or words[-1] in BESIDE):
                whole, readers = found or (False, False)
                found = whole or len(words) == 1, readers or words[0] in READERS or words[-1] in READERS
    return found


@dataclass
class Named:
    """An element that its name, or the tag of a form, puts beside the article."""

    whole: bool
    section: bool  # of an article, named by its id only, not of readers' text
    region: bool  # lies in an article or main element


def _struck(named: list[Named], nodes: list[tuple[tuple[str, ...], str, bool, tuple[int, ...]]]) -> set[int]:
    """The named elements to leave out. Those with most text are judged first, as they hold the others."""
    real = [(p, s, out, marks) for p, s, out, marks in nodes if s and not s.isspace()]
    if not named or not real:
        return set(range(len(named)))
    index, of, ratio, limit = _ratios([(p, s) for p, s, _, _ in real])
    above = ratio[of] >= limit
    sizes = [len(" ".join(s.split())) for _, s, _, _ in real]
    inside: list[list[int]] = [[] for _ in named]
    for k, (_, _, out, marks) in enumerate(real):
        if not out:
            for e in marks:
                inside[e].append(k)
    articles = [any(x.split(".")[0] in REGION for x in p) for p, _, _, _ in real]
    article = sum(n for n, a, x in zip(sizes, articles, real, strict=True) if a and not x[2])
    content = sum(n for n, a in zip(sizes, above, strict=True) if a)
    struck = set(range(len(named)))
    for e in sorted(struck, key=lambda e: (-sum(sizes[k] for k in inside[e]), e)):
        own = sum(sizes[k] for k in inside[e] if above[k])
        if not own:
            continue
        if named[e].region:
            # most of its text, short lines and headings aside, is prose
            keep = named[e].section and own >= 0.5 * sum(sizes[k] for k in inside[e])
        elif article:
            keep = sum(sizes[k] for k in inside[e] if articles[k]) >= 0.5 * article
        elif own < 0.5 * content:
            keep = False
        else:
            free = sum(n for n, a, x in zip(sizes, above, real, strict=True) if a and not x[2] and e not in x[3] and not struck.intersection(x[3]))
            keep = own >= (1 if named[e].whole else WRAPPER) * (own + free)
        if keep:
            struck.discard(e)
    return struck


def text_nodes(page: str) -> list[tuple[tuple[str, ...], str, bool]]:
    """(path, text, left out) for each run of text between tags; a border of blocks is an empty path and text."""
    return [x[:3] for x in page_nodes(page)]


def page_nodes(page: str) -> list[tuple[tuple[str, ...], str, bool, tuple[int, ...]]]:
    """``text_nodes`` with the numbers of the elements on each path, which tell elements of one path apart."""
    out: list[tuple[tuple[str, ...], str, bool, tuple[int, ...]]] = []
    numbers: list[tuple[int, ...]] = []
    stack: list[tuple[str, str, bool, tuple[int, ...], int]] = []  # tag, step of the path, left out, named elements around, number
    named: list[Named] = []
    count = 0

    def text(s: str) -> None:
        if s:
            blocks = [x for x in stack if x[0] not in INLINE]
            out.append((tuple([x[1] for x in blocks]), html.unescape(s), *(stack[-1][2:4] if stack else (False, ()))))
            numbers.append(tuple([x[4] for x in blocks]))

    at = 0
    for m in _TOKEN.finditer(page):
        text(page[at : m.start()])
        at = m.end()
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            if m[1] and m[1].lower() != "svg":
                out.append(((), "", False, ()))
                numbers.append(())
            continue
        if tag not in INLINE:
            out.append(((), "", False, ()))
            numbers.append(())
        if m[2] or m[5]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break  # an inline end tag closes nothing outside its block
        elif tag not in VOID:
            attributes = m[4] or m[7] or ""
            if tag == "body":
                stack = [x for x in stack if x[0] == "html"]
            shut = CLOSES.get(tag) or ({"p"} if tag not in INLINE else set())
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] in shut:
                    del stack[k:]
                    break
                if stack[k][0] in SCOPES:
                    break
            within, marks = stack[-1][2:4] if stack else (False, ())
            region = any(x[0] in REGION for x in stack)
            structural = tag in ("html", "body", "main", "article")
            beside = tag in NEVER or (tag == "header" and not region) or (bool(attributes) and (not structural or (tag == "article" and region)) and bool(_HIDDEN.search(attributes)))
            name = _beside(attributes) if attributes and (not structural or (tag == "article" and region)) else None
            if name or tag == "form":
                whole, readers = name or (False, False)
                section = tag == "section" and region and not readers and not _beside(_ID.sub("", attributes))
                named.append(Named(whole, section, region))
                marks = (*marks, len(named) - 1)
            names = " ".join(x[0] or x[1] or x[2] for x in _NAMES.findall(attributes)) if attributes else ""
            if not attributes.rstrip().endswith("/"):
                count += 1
                stack.append((tag, f"{tag}.{names}" if names else tag, within or beside, marks, count))
    text(page[at:])
    struck = _struck(named, out)
    return [(p, s, left_out or not struck.isdisjoint(marks), own) for (p, s, left_out, marks), own in zip(out, numbers, strict=True)]


def _smooth(x: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * np.arange(-2, 3) ** 2)
    weight = np.convolve(np.ones(len(x)), kernel, "same")[: len(x)] if len(x) >= 5 else None
    if weight is None:
        return x
    return np.convolve(x, kernel, "same") / weight


def _ratios(real: list[tuple[tuple[str, ...], str]]) -> tuple[dict[tuple[str, ...], int], np.ndarray, np.ndarray, float]:
    """The paths, the path of each node, the smoothed and fused ratio of each path, and the spread of the page."""
    texts = [" ".join(s.split()) for _, s in real]
    index: dict[tuple[str, ...], int] = {}
    of = np.array([index.setdefault(p, len(index)) for p, _ in real])
    n = np.bincount(of)
    length = np.bincount(of, [len(s) for s in texts]) / n
    stops = np.bincount(of, [len(PUNCTUATION.findall(s)) for s in texts]) / n
    fused = np.sqrt(_smooth(length[of]) * (_smooth(stops[of]) + 0.1))
    return index, of, np.bincount(of, fused) / n, float(fused.std())


def _named_regions(weight: dict[int, float], nodes: list) -> set[tuple[int, ...]]:
    """The article elements that hold at least half of the content, or the main elements that do."""
    for tags in (("article",), tuple(REGION)):
        found: dict[tuple[int, ...], float] = {}
        for k, w in weight.items():
            path, _, _, numbers = nodes[k]
            depth = next((d for d, step in enumerate(path) if step.split(".")[0] in tags), None)
            if depth is not None:
                found[numbers[: depth + 1]] = found.get(numbers[: depth + 1], 0.0) + w
        if found and sum(found.values()) >= 0.5 * sum(weight.values()):
            return set(found)
    return set()


def _step(nodes: list, k: int, region: tuple[int, ...]) -> tuple[int, ...] | None:
    """The block inside ``region`` that holds node ``k``; none where text or a block of text follows."""
    path, _, _, numbers = nodes[k]
    d = len(region)
    return numbers[: d + 1] if len(path) > d and numbers[:d] == region and path[d].split(".")[0] not in TEXT_BLOCKS else None


def _found_region(weight: dict[int, float], nodes: list) -> tuple[int, ...]:
    """From the root down, the element that still holds ``MOST`` of the content."""
    region: tuple[int, ...] = ()
    total = sum(weight.values())
    while True:
        inside: dict[tuple[int, ...], float] = {}
        for k, w in weight.items():
            step = _step(nodes, k, region)
            if step is not None:
                inside[step] = inside.get(step, 0.0) + w
        best = max(inside, key=inside.__getitem__, default=None)
        if best is None or inside[best] < MOST * total:
            return region
        region = best


def selected(nodes: list[tuple[tuple[str, ...], str, bool, tuple[int, ...]]]) -> set[int]:
    """The nodes of the article, by position."""
    real = [k for k, x in enumerate(nodes) if x[1] and not x[1].isspace()]
    kept = [i for i, k in enumerate(real) if not nodes[k][2]]
    if not kept:
        return set()
    _, of, path_ratio, spread = _ratios([nodes[k][:2] for k in real])
    ratio = path_ratio[of]
    limit = min(spread, float(max(ratio[i] for i in kept)))
    size = [len(" ".join(nodes[k][1].split())) for k in real]
    weight = {real[i]: size[i] * float(ratio[i]) for i in kept if ratio[i] >= limit}
    regions = _named_regions(weight, nodes)
    if regions:
        depths = {len(r) for r in regions}
        return {k for k, x in enumerate(nodes) if x[1] and not x[2] and any(x[3][:d] in regions for d in depths)}
    region = _found_region(weight, nodes)
    inside = {k for k, x in enumerate(nodes) if x[1] and not x[2] and x[3][: len(region)] == region}
    # a part of the region is left out if less than half of its text is on content paths
    parts: dict[tuple[int, ...], list[int]] = {}
    for i in kept:
        step = _step(nodes, real[i], region)
        if step is not None:
            both = parts.setdefault(step, [0, 0])
            both[0] += size[i]
            both[1] += size[i] if ratio[i] >= limit else 0
    gone = {step for step, (whole, content) in parts.items() if content < 0.5 * whole}
    return {k for k in inside if nodes[k][3][: len(region) + 1] not in gone}


def main_text(page: str) -> str:
    """The text of the article; empty if the page has none."""
    nodes = page_nodes(page)
    own = selected(nodes)
    if not own:
        return ""
    # a border of blocks is a space
    return " ".join("".join(" " if not x[1] else x[1] for k, x in enumerate(nodes) if not x[1] or k in own).split())


def extract(pages: DataFrame, content: str = "html", into: str = "text") -> DataFrame:
    """Add the main text of every page. Null and empty pages give the empty text, a very long page is
    read whole; repeated rows are worked on each; a column named as ``into`` is replaced; an empty table stays empty."""

    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([main_text(p) for p in batch], dtype="object")

    return pages.withColumn(into, run(F.coalesce(F.col(content), F.lit(""))))
