"""Main text of web pages from flat text blocks and a small decision tree.

A page is read as a flat sequence of text blocks. Each is described by its word count and link density,
those of its neighbours, and where it stands (inside an article, inside a region that its element, role
or class marks as no content, a heading). A decision tree, grown on the labelled table below, keeps or
drops each block: link density comes first and decides menus and link bars wherever they stand; word
counts of block and neighbours decide on pages without an article and boxes inside one; marks and place
tell comments, notices and footers from text of the same shape. Pages are independent rows: no shuffle.

Defined results: null and empty pages, and pages without content, give the empty text; broken markup is
read leniently (an unclosed script or comment hides the rest); very long pages are read whole; repeated
rows and ties are extracted alike; extra columns of any name are not read; an empty table gives an empty
result.
"""

from __future__ import annotations

import html
import re
from collections import namedtuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that part blocks; all others are inline.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split()
)
#: Containers whose marks hold for all that they contain.
CONTAINERS = frozenset(
    "article aside blockquote body dd details dialog div dl fieldset figure footer form header hgroup main menu nav ol section table tbody td tr ul".split()
)
#: Never content, whatever stands around.
NEVER = frozenset("head title noscript template iframe object svg math canvas audio video map select button textarea label datalist form nav aside dialog menu".split())
#: Their content is no markup.
RAW = "script|style|textarea|title|iframe|noframes|xmp|noembed"
#: Words of class, id and role values that mark menus, notices, adverts, comments and the like.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising banner breadcrumb breadcrumbs comment comments commentlist complementary consent contentinfo "
    "cookie cookies copyright dialog disclaimer disqus gdpr login menu menubar modal nav navbar navigation newsletter notice notices pager pagination "
    "paywall popup promo promoted promotion recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored "
    "subscribe subscription tags teaser toc toolbar topbar tracking widget widgets".split()
)
#: Marks only where no other word of the value speaks of content, as in entry-header.
SOFT_MARKS = frozenset("header footer masthead head foot bottom top".split())
CONTENT = frozenset("article body content entry main post story text".split())

_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*+>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*+)(?P<attributes>(?:[^<>\"']|\"[^\"<]*+\"|'[^'<]*+')*+)>|</?[a-z!?][^>]*+(?:>|\Z)",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
_WORD = re.compile(r"[a-z]+", re.I)

#: How sure a mark is: a word beside one of content, or of the whole page's class; a word alone; an element that is never content or hidden.
WEAK, PLAIN, SURE = 1, 2, 3
#: Words of link-poor text without which a page is taken to have lost its main text to marks.
LITTLE = 40

Block = namedtuple("Block", "text words linked article marked heading")


def _marked(tag: str, attributes: str) -> int:
    """How surely an element's name, role, class or visibility marks it as no content; 0 for not at all."""
    if tag in NEVER:
        return SURE
    level = 0
    for name, value in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), value.strip("\"'")
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return SURE
        if name == "style":
            if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return SURE
            continue
        found = {w.lower() for w in _WORD.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", "-", value))}
        if found & MARKS or found & SOFT_MARKS and not found & CONTENT:
            level = max(level, WEAK if found & CONTENT else PLAIN)
    # what the whole page is called says nothing about its parts
    return 0 if tag in ("body", "main") else level


def blocks(page: str | None) -> list[Block]:
    """The page's text blocks in order, white space as single spaces."""
    page, out = page or "", []
    parts, linked, links = [], 0, 0
    stack: list[tuple[str, bool, int]] = []
    article = heading = False
    marked = leaf = 0
    at = 0

    def close() -> None:
        nonlocal parts, linked, heading, leaf
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            words = text.count(" ") + 1
            out.append(Block(text, words, min(linked, words), article, max(marked, leaf), heading))
        parts, linked, heading, leaf = [], 0, False, 0

    def put(text: str) -> None:
        nonlocal linked
        parts.append(text)
        if links:
            linked += len(text.split())

    for token in _TOKEN.finditer(page):
        if token.start() > at:
            put(page[at : token.start()])
        at = token.end()
        tag = token["tag"]
        if tag is None:
            continue
        tag, closing = tag.lower(), token["close"]
        if tag == "a":
            links = max(0, links + (-1 if closing else 1))
        elif tag == "br":
            parts.append(" ")
        elif tag in NEVER or tag in BLOCKS:
            close()
            if tag in CONTAINERS or tag in NEVER:
                if not closing:
                    stack.append((tag, article, marked))
                    own = _marked(tag, token["attributes"])
                    # the header of an article holds its title, that of a page does not
                    if tag == "footer" or tag == "header" and not article:
                        own = SURE
                    article, marked = article or tag in ("article", "main"), max(marked, own)
                elif any(tag == s[0] for s in stack):
                    while stack:
                        name, article, marked = stack.pop()
                        if name == tag:
                            break
                links = 0
            elif not closing:
                heading, leaf = tag[0] == "h" and tag[1:].isdigit(), _marked(tag, token["attributes"])
    put(page[at:])
    close()
    return out


#: words, link share, words before and after, link shares before and after, place (2 in an article, 1 no article on the
#: page, 0 outside of it), marked, heading; content. Blocks of invented pages, labelled by hand.
TABLE = (
    # links in rows and columns: menus, tag lists, teasers, share bars, related stories, with or without a mark, anywhere
    ((1, 1.00, 1, 1, 1.0, 1.0, 1, 0, 0), 0), ((2, 1.00, 0, 2, 0.0, 1.0, 1, 0, 0), 0), ((1, 1.00, 3, 1, 1.0, 1.0, 1, 0, 0), 0),
    ((3, 1.00, 1, 40, 1.0, 0.0, 1, 0, 0), 0), ((4, 0.75, 2, 60, 1.0, 0.0, 1, 0, 0), 0), ((9, 1.00, 8, 7, 1.0, 1.0, 1, 0, 0), 0),
    ((30, 0.80, 6, 25, 1.0, 0.7, 1, 0, 0), 0), ((12, 0.60, 70, 9, 0.0, 1.0, 1, 0, 0), 0), ((6, 1.00, 80, 5, 0.0, 1.0, 1, 0, 0), 0),
    ((1, 1.00, 1, 1, 1.0, 1.0, 0, 1, 0), 0), ((2, 1.00, 1, 9, 1.0, 0.0, 0, 1, 0), 0), ((1, 1.00, 0, 1, 0.0, 1.0, 0, 1, 0), 0),
    ((2, 1.00, 2, 2, 1.0, 1.0, 0, 0, 0), 0), ((7, 1.00, 50, 8, 0.0, 1.0, 0, 0, 0), 0), ((5, 1.00, 9, 0, 1.0, 0.0, 0, 0, 0), 0),
    ((3, 1.00, 66, 70, 0.0, 0.0, 2, 0, 0), 0), ((3, 1.00, 0, 44, 0.0, 0.0, 2, 0, 0), 0), ((2, 1.00, 90, 2, 0.0, 1.0, 2, 0, 0), 0),
    ((8, 0.88, 52, 38, 0.0, 0.0, 2, 0, 0), 0), ((1, 1.00, 1, 1, 1.0, 1.0, 2, 0, 0), 0), ((14, 0.70, 33, 61, 0.0, 0.0, 2, 0, 0), 0),
    ((3, 1.00, 66, 2, 0.0, 1.0, 2, 1, 0), 0), ((6, 0.67, 40, 80, 0.0, 0.0, 2, 0, 0), 0), ((5, 0.60, 24, 0, 0.0, 0.0, 2, 0, 0), 0),
    ((55, 0.95, 70, 8, 0.0, 1.0, 1, 0, 0), 0), ((80, 1.00, 2, 30, 1.0, 0.0, 0, 1, 0), 0), ((42, 0.85, 30, 60, 0.0, 0.0, 2, 0, 0), 0),
    # boxes of few words, a good part of them linked, between paragraphs: adverts and calls
    ((5, 0.40, 55, 64, 0.0, 0.0, 2, 0, 0), 0), ((9, 0.44, 70, 31, 0.0, 0.0, 2, 0, 0), 0), ((7, 0.43, 48, 0, 0.0, 0.0, 2, 0, 0), 0),
    ((5, 0.40, 90, 45, 0.0, 0.0, 1, 0, 0), 0), ((8, 0.38, 62, 77, 0.0, 0.0, 1, 0, 0), 0), ((10, 0.40, 35, 58, 0.0, 0.0, 2, 0, 0), 0),
    # paragraphs with links in them
    ((64, 0.05, 9, 70, 0.0, 0.0, 2, 0, 0), 1), ((22, 0.18, 41, 18, 0.0, 0.1, 2, 0, 0), 1), ((35, 0.30, 60, 28, 0.0, 0.0, 2, 0, 0), 1),
    ((48, 0.36, 20, 66, 0.0, 0.0, 2, 0, 0), 1), ((45, 0.10, 0, 30, 0.0, 0.0, 1, 0, 0), 1), ((72, 0.35, 40, 50, 0.0, 0.1, 1, 0, 0), 1),
    ((15, 0.10, 25, 0, 0.0, 0.0, 2, 0, 0), 1), ((26, 0.38, 58, 44, 0.0, 0.0, 2, 0, 0), 1), ((11, 0.09, 30, 52, 0.0, 0.0, 2, 0, 0), 1),
    ((3, 0.33, 3, 4, 0.0, 0.0, 2, 0, 0), 1), ((6, 0.33, 40, 52, 0.0, 0.0, 2, 0, 0), 1), ((9, 0.33, 60, 12, 0.0, 0.0, 2, 0, 0), 1),
    # headings, linked or not
    ((7, 0.00, 0, 60, 0.0, 0.0, 2, 0, 1), 1), ((9, 0.00, 6, 48, 1.0, 0.0, 2, 0, 1), 1), ((12, 0.00, 5, 14, 0.0, 0.0, 2, 0, 1), 1),
    ((10, 0.00, 8, 10, 0.0, 0.0, 2, 0, 1), 1), ((3, 0.00, 8, 1, 0.0, 0.0, 2, 0, 1), 1), ((8, 0.00, 2, 75, 1.0, 0.0, 1, 0, 1), 1),
    # the article's own text: long, short, first behind a menu or an advert, last before a footer, lists
    ((120, 0.00, 80, 95, 0.0, 0.0, 2, 0, 0), 1), ((210, 0.00, 8, 12, 0.0, 0.0, 2, 0, 0), 1), ((58, 0.00, 7, 36, 0.0, 0.0, 2, 0, 0), 1),
    ((1, 0.00, 40, 52, 0.0, 0.0, 2, 0, 0), 1), ((4, 0.00, 12, 33, 0.0, 0.0, 2, 0, 0), 1), ((3, 0.00, 88, 10, 0.0, 0.0, 2, 0, 0), 1),
    ((2, 0.00, 8, 9, 0.0, 0.0, 2, 0, 0), 1), ((5, 0.00, 3, 11, 0.0, 0.0, 2, 0, 0), 1), ((8, 0.00, 9, 14, 0.0, 0.0, 2, 0, 0), 1),
    ((13, 0.00, 7, 13, 0.0, 0.0, 2, 0, 0), 1), ((1, 0.00, 6, 12, 0.0, 0.0, 2, 0, 0), 1), ((35, 0.00, 2, 13, 0.0, 0.0, 2, 0, 0), 1),
    ((9, 0.00, 1, 8, 1.0, 0.0, 2, 0, 0), 1), ((31, 0.00, 10, 0, 0.0, 0.0, 2, 0, 0), 1), ((6, 0.00, 2, 3, 0.0, 0.0, 2, 0, 0), 1),
    ((18, 0.00, 3, 66, 1.0, 0.0, 2, 0, 0), 1), ((2, 0.00, 44, 5, 0.0, 1.0, 2, 0, 0), 1), ((7, 0.00, 1, 2, 0.0, 0.0, 2, 0, 0), 1),
    ((4, 0.00, 0, 0, 0.0, 0.0, 2, 0, 0), 1), ((11, 0.00, 2, 1, 1.0, 1.0, 2, 0, 0), 1), ((16, 0.00, 0, 3, 0.0, 1.0, 2, 0, 0), 1),
    # marked: notices, adverts, comments, menus and footers without links
    ((8, 0.00, 90, 60, 0.0, 0.0, 2, 1, 0), 0), ((55, 0.00, 70, 20, 0.0, 0.0, 2, 1, 0), 0), ((18, 0.10, 33, 41, 0.0, 0.0, 2, 1, 0), 0),
    ((2, 0.00, 21, 38, 0.0, 0.0, 2, 1, 1), 0), ((130, 0.02, 40, 8, 0.0, 0.0, 2, 1, 0), 0), ((6, 0.00, 14, 9, 0.0, 0.0, 2, 1, 0), 0),
    ((60, 0.00, 70, 20, 0.0, 0.0, 1, 1, 0), 0), ((9, 0.00, 33, 5, 0.0, 0.0, 1, 1, 0), 0), ((28, 0.00, 40, 0, 0.0, 0.0, 1, 1, 0), 0),
    ((14, 0.00, 60, 0, 0.0, 0.0, 0, 1, 0), 0), ((9, 0.00, 1, 8, 1.0, 0.0, 0, 1, 0), 0), ((75, 0.00, 80, 4, 0.0, 0.5, 0, 1, 0), 0),
    ((7, 0.00, 1, 11, 1.0, 0.0, 0, 1, 0), 0), ((16, 0.00, 30, 0, 0.0, 0.0, 0, 1, 0), 0), ((40, 0.00, 12, 9, 0.0, 0.0, 1, 1, 0), 0),
    # outside of the page's article, without a mark
    ((25, 0.20, 90, 0, 0.0, 0.0, 0, 0, 0), 0), ((6, 0.00, 1, 7, 1.0, 0.0, 0, 0, 1), 0), ((40, 0.00, 3, 9, 1.0, 0.0, 0, 0, 0), 0),
    ((110, 0.00, 30, 60, 0.0, 0.0, 0, 0, 0), 0), ((19, 0.00, 24, 31, 0.0, 0.0, 0, 0, 0), 0), ((12, 0.00, 15, 80, 0.0, 0.0, 0, 0, 1), 0),
    # pages without an article: long or well-surrounded text is content, lonely or linked text is not
    ((90, 0.00, 60, 70, 0.0, 0.0, 1, 0, 0), 1), ((20, 0.00, 85, 40, 0.0, 0.0, 1, 0, 0), 1), ((5, 0.00, 70, 66, 0.0, 0.0, 1, 0, 0), 1),
    ((16, 0.00, 55, 4, 0.0, 1.0, 1, 0, 0), 1), ((32, 0.05, 2, 2, 1.0, 1.0, 1, 0, 0), 1), ((12, 0.00, 30, 25, 0.0, 0.0, 1, 0, 0), 1),
    ((3, 0.00, 48, 52, 0.0, 0.0, 1, 0, 0), 1), ((6, 0.00, 0, 60, 0.0, 0.0, 1, 0, 0), 1), ((60, 0.00, 5, 0, 0.0, 0.0, 1, 0, 0), 1),
    ((24, 0.00, 61, 0, 0.0, 0.0, 1, 0, 0), 1), ((7, 0.00, 2, 50, 1.0, 0.0, 1, 0, 0), 1), ((14, 0.00, 18, 22, 0.0, 0.0, 1, 0, 0), 1),
    ((4, 0.00, 2, 3, 1.0, 1.0, 1, 0, 0), 0), ((6, 0.00, 1, 0, 1.0, 0.0, 1, 0, 0), 0), ((5, 0.00, 3, 2, 1.0, 1.0, 1, 0, 0), 0),
    ((3, 0.00, 1, 3, 1.0, 0.0, 1, 0, 0), 0), ((6, 0.00, 64, 0, 0.0, 0.0, 1, 0, 0), 0), ((4, 0.00, 70, 3, 0.0, 1.0, 1, 0, 0), 0),
    ((2, 0.00, 4, 2, 1.0, 1.0, 1, 0, 0), 0), ((7, 0.00, 2, 0, 1.0, 0.0, 1, 0, 0), 0), ((5, 0.00, 44, 2, 0.0, 1.0, 1, 0, 0), 0),
)


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | float:
    """A decision tree by Gini impurity: (feature, threshold, low side, high side), leaves are shares of content."""
    if depth == 0 or len(set(y.tolist())) == 1:
        return float(y.mean())
    best = (1e9, 0, 0.0)
    for j in range(x.shape[1]):
        values = np.unique(x[:, j])
        for cut in (values[1:] + values[:-1]) / 2:
            low = x[:, j] <= cut
            impurity = sum(s.sum() * y[s].mean() * (1 - y[s].mean()) for s in (low, ~low))
            best = min(best, (impurity, j, float(cut)))
    if best[0] >= len(y) * y.mean() * (1 - y.mean()) - 1e-12:
        return float(y.mean())
    _, j, cut = best
    low = x[:, j] <= cut
    return j, cut, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def believed(found: list[Block]) -> int:
    """The lowest level at which the page's marks hold: link-poor text outvotes those that would take the main text away."""
    poor = [0] * (SURE + 1)
    for b in found:
        poor[b.marked] += b.words if 4 * b.linked <= b.words else 0
    if poor[0] + poor[WEAK] < LITTLE <= poor[PLAIN]:
        return SURE
    return PLAIN if poor[WEAK] >= max(LITTLE, poor[0]) else WEAK


def features(found: list[Block]) -> list[tuple]:
    """A row as in the table for each block.

    An article is the page's article only if its unmarked link-poor text is a fifth of the page's; a teaser's is not.
    """
    level = believed(found)
    found = [b._replace(marked=b.marked >= level) for b in found]
    text = [0, 0]
    for b in found:
        text[b.article] += b.words if not b.marked and 4 * b.linked <= b.words else 0
    known = any(b.article for b in found) and 4 * text[1] >= text[0]
    place = [2 if b.article else 0 for b in found] if known else [1] * len(found)
    share = [b.linked / b.words for b in found]
    out = []
    for i, b in enumerate(found):
        before, after = (found[i - 1].words, share[i - 1]) if i else (0, 0.0), (found[i + 1].words, share[i + 1]) if i + 1 < len(found) else (0, 0.0)
        out.append((b.words, share[i], before[0], after[0], before[1], after[1], place[i], int(b.marked), int(b.heading)))
    return out


def judge(tree: tuple | float, row: tuple) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def main_text(page: str | None, tree: tuple | float) -> str:
    found = blocks(page)
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if judge(tree, row))


def extract(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Per page: page_id, url, text, n_chars."""
    tree = grow(np.array([r for r, _ in TABLE], float), np.array([y for _, y in TABLE], float))

    def extracted(batches):
        for batch in batches:
            texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_pydict({"page_id": batch.column("page_id"), "url": batch.column("url"), "text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())})

    read = pages.select(F.col(id_column).alias("page_id"), F.col(url_column).alias("url"), F.col(html_column).alias("html"))
    kind = pages.schema[id_column].dataType.simpleString()
    return read.mapInArrow(extracted, f"page_id {kind}, url string, text string, n_chars long")
