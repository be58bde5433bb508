"""Main text of web pages: flat text blocks classified by a decision tree.

A page is cut into flat blocks at its block-level tags. A block's features are its word count and link density, those of
its neighbours, and what surrounds it: whether it is inside an article, how far the elements around it name themselves boilerplate
(by tag, role, or the words of a class or id: all of them, or some), and whether it is a heading. A decision tree (Gini, grown in numpy)
learns from LABELLED, a small table of hand-labelled blocks.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "article", "boilerplate", "heading")
#: Hand-labelled blocks: FEATURES, then 1 for main text.
LABELLED = (
    # menus
    (6, 1.0, 0, 0.0, 5, 1.0, 0, 1, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 12, 0.0, 0, 1, 0, 0),
    (2, 1.0, 2, 1.0, 2, 1.0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (3, 1.0, 2, 1.0, 80, 0.0, 0, 0, 0, 0), (4, 0.8, 60, 0.0, 3, 1.0, 0, 0, 0, 0),
    # adverts, notices, forms, sidebars
    (8, 0.0, 1, 1.0, 7, 0.0, 0, 1, 0, 0), (25, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0), (60, 0.1, 4, 0.0, 30, 0.0, 0, 1, 0, 0), (14, 0.2, 90, 0.0, 5, 0.0, 0, 1, 0, 0),
    (120, 0.0, 80, 0.0, 40, 0.0, 0, 1, 0, 0), (3, 0.0, 2, 0.0, 3, 0.0, 0, 1, 1, 0), (9, 0.0, 90, 0.0, 70, 0.0, 1, 1, 0, 0), (2, 0.5, 70, 0.0, 3, 1.0, 1, 1, 0, 0),
    # reader comments
    (40, 0.0, 3, 0.0, 35, 0.0, 0, 1, 0, 0), (90, 0.0, 2, 0.0, 3, 0.0, 1, 1, 0, 0), (2, 0.0, 90, 0.0, 40, 0.0, 1, 1, 1, 0), (15, 0.0, 2, 0.0, 20, 0.0, 1, 1, 0, 0),
    # footers
    (10, 0.0, 60, 0.0, 0, 0.0, 0, 1, 0, 0), (6, 0.0, 1, 0.0, 0, 0.0, 0, 1, 0, 0), (7, 0.4, 90, 0.0, 0, 0.0, 0, 0, 0, 0), (5, 0.0, 3, 1.0, 0, 0.0, 0, 0, 0, 0),
    (4, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (3, 0.0, 1, 1.0, 1, 1.0, 0, 0, 1, 0), (5, 0.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0), (8, 0.9, 40, 0.0, 8, 0.9, 0, 0, 0, 0),
    # links inside an article: lists of related pages, share bars
    (2, 1.0, 80, 0.0, 2, 1.0, 1, 0, 0, 0), (3, 1.0, 2, 1.0, 3, 1.0, 1, 0, 0, 0), (6, 1.0, 6, 1.0, 0, 0.0, 1, 0, 0, 0), (5, 0.9, 50, 0.0, 6, 0.9, 1, 0, 0, 0),
    # articles
    (7, 0.0, 8, 0.0, 30, 0.0, 1, 0, 1, 1), (5, 0.0, 1, 1.0, 5, 0.0, 1, 0, 1, 1), (1, 0.0, 90, 0.0, 1, 0.0, 1, 0, 0, 1), (1, 0.0, 1, 0.0, 60, 0.0, 1, 0, 0, 1),
    (2, 0.0, 0, 0.0, 0, 0.0, 1, 0, 0, 1), (30, 0.0, 5, 0.0, 6, 0.0, 1, 0, 0, 1), (80, 0.05, 80, 0.0, 90, 0.0, 1, 0, 0, 1), (200, 0.0, 4, 0.0, 10, 0.0, 1, 0, 0, 1),
    (12, 0.3, 50, 0.0, 60, 0.0, 1, 0, 0, 1), (60, 0.5, 40, 0.0, 30, 0.0, 1, 0, 0, 1), (3, 0.0, 60, 0.0, 80, 0.0, 1, 0, 1, 1), (4, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 1),
    (9, 0.0, 90, 0.0, 8, 0.0, 1, 0, 0, 1), (15, 0.0, 15, 0.0, 15, 0.0, 1, 0, 0, 1), (1, 0.0, 40, 0.0, 6, 0.0, 1, 0, 0, 1), (6, 0.0, 7, 0.0, 8, 0.2, 1, 0, 1, 1),
    (60, 0.0, 80, 0.0, 0, 0.0, 1, 0, 0, 1), (3, 0.0, 60, 0.0, 0, 0.0, 1, 0, 0, 1), (12, 0.0, 2, 0.0, 0, 0.0, 1, 0, 0, 1), (7, 0.0, 0, 0.0, 0, 0.0, 1, 0, 1, 1),
    (5, 0.0, 40, 0.0, 1, 1.0, 1, 0, 0, 1), (90, 0.0, 50, 0.0, 2, 1.0, 1, 0, 0, 1), (15, 0.0, 3, 1.0, 2, 1.0, 1, 0, 0, 1), (8, 0.0, 2, 1.0, 3, 1.0, 1, 0, 1, 1),
    # main text of pages that mark no article
    (80, 0.0, 70, 0.0, 0, 0.0, 0, 0, 0, 1), (40, 0.0, 60, 0.0, 0, 0.0, 0, 0, 0, 1), (35, 0.1, 9, 0.0, 2, 1.0, 0, 0, 0, 1), (90, 0.0, 60, 0.0, 3, 1.0, 0, 0, 0, 1),
    (7, 0.0, 2, 1.0, 60, 0.0, 0, 0, 1, 1), (9, 0.0, 9, 0.0, 80, 0.0, 0, 0, 1, 1), (80, 0.0, 7, 0.0, 70, 0.0, 0, 0, 0, 1), (60, 0.05, 80, 0.0, 90, 0.0, 0, 0, 0, 1),
    (40, 0.1, 2, 1.0, 50, 0.0, 0, 0, 0, 1), (70, 0.0, 60, 0.0, 9, 0.3, 0, 0, 0, 1), (20, 0.0, 60, 0.0, 40, 0.0, 0, 0, 0, 1), (6, 0.0, 50, 0.0, 70, 0.0, 0, 0, 0, 1),
    (2, 0.0, 60, 0.0, 60, 0.0, 0, 0, 0, 1), (4, 0.0, 80, 0.0, 50, 0.0, 0, 0, 1, 1), (30, 0.0, 5, 0.0, 7, 0.4, 0, 0, 0, 1), (25, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    # a single long text between menus
    (80, 0.0, 1, 1.0, 2, 1.0, 0, 0, 0, 1), (120, 0.0, 1, 1.0, 0, 0.0, 0, 0, 0, 1), (60, 0.05, 2, 1.0, 3, 1.0, 0, 0, 0, 1), (45, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 1), (200, 0.1, 3, 1.0, 6, 0.3, 0, 0, 0, 1),
    # parts of articles whose names have a word of boilerplate among others: a callout with a notice, the history of a society
    (40, 0.0, 60, 0.0, 50, 0.0, 1, 0.5, 0, 1), (25, 0.0, 80, 0.0, 70, 0.0, 1, 0.5, 0, 1), (12, 0.0, 30, 0.0, 40, 0.0, 1, 0.5, 0, 1), (60, 0.05, 4, 0.0, 90, 0.0, 1, 0.5, 0, 1),
    (3, 0.0, 50, 0.0, 40, 0.0, 1, 0.5, 1, 1), (9, 0.0, 40, 0.0, 60, 0.1, 1, 0.5, 0, 1), (90, 0.0, 3, 0.0, 0, 0.0, 1, 0.5, 0, 1), (20, 0.0, 70, 0.0, 3, 1.0, 1, 0.5, 0, 1),
    (4, 1.0, 60, 0.0, 3, 1.0, 1, 0.5, 0, 0), (2, 1.0, 2, 1.0, 2, 1.0, 1, 0.5, 0, 0), (6, 0.9, 50, 0.0, 5, 1.0, 1, 0.5, 0, 0), (3, 0.7, 2, 1.0, 40, 0.0, 1, 0.5, 0, 0),
    # the same outside of articles: text among text is main text, what stands by menus is not
    (70, 0.0, 60, 0.0, 80, 0.0, 0, 0.5, 0, 1), (45, 0.0, 50, 0.0, 40, 0.0, 0, 0.5, 0, 1), (8, 0.0, 1, 1.0, 7, 0.0, 0, 0.5, 0, 0), (30, 0.0, 3, 1.0, 6, 0.0, 0, 0.5, 0, 0),
    (15, 0.0, 90, 0.0, 5, 0.0, 0, 0.5, 0, 0), (5, 0.0, 2, 1.0, 2, 1.0, 0, 0.5, 0, 0), (12, 0.0, 4, 0.0, 0, 0.0, 0, 0.5, 0, 0), (3, 1.0, 2, 1.0, 3, 1.0, 0, 0.5, 0, 0),
    # marked text of any length, among long neighbours or not
    (70, 0.0, 60, 0.0, 80, 0.0, 0, 1, 0, 0), (45, 0.0, 60, 0.0, 60, 0.0, 1, 1, 0, 0), (150, 0.0, 90, 0.0, 70, 0.0, 1, 1, 0, 0), (30, 0.0, 80, 0.0, 90, 0.0, 1, 1, 0, 0), (5, 0.0, 60, 0.0, 60, 0.0, 1, 1, 1, 0),
    # what stands between menus, and lines at the end of a page, on pages that mark nothing
    (4, 0.0, 1, 1.0, 1, 1.0, 0, 0, 0, 0), (9, 0.0, 2, 1.0, 3, 1.0, 0, 0, 0, 0), (6, 0.2, 3, 1.0, 4, 1.0, 0, 0, 0, 0), (8, 0.0, 5, 0.9, 0, 0.0, 0, 0, 0, 0), (3, 0.0, 4, 0.0, 0, 0.0, 0, 0, 0, 0),
)

_SKIPPED = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "select", "button", "object", "canvas", "math", "head", "title", "option", "datalist", "audio", "video")
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
_CLOSE = {t: re.compile(rf"</{t}(?![a-zA-Z0-9-])[^>]*(?:>|\Z)", re.I) for t in _SKIPPED if t not in ("head",)}
_BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody tfoot thead tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end may be left out: what ends them, and what they can't be ended through.
_IMPLIED = {
    "p": (frozenset(("p",)), frozenset("td th li dd div section article blockquote body".split())), "li": (frozenset(("li",)), frozenset(("ul", "ol", "menu", "dir"))),
    "td": (frozenset(("td", "th")), frozenset(("table",))), "th": (frozenset(("td", "th")), frozenset(("table",))), "tr": (frozenset(("tr",)), frozenset(("table",))),
    "dt": (frozenset(("dt", "dd")), frozenset(("dl",))), "dd": (frozenset(("dt", "dd")), frozenset(("dl",))),
}
_BOILERPLATE = frozenset("nav aside footer form menu dialog header fieldset search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog form menu menubar toolbar tablist".split())
#: Words of a class or id that name boilerplate, and words that name nothing.
_HINTS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright discussion disqus footer gdpr header login masthead menu modal nav navbar "
    "navigation newsletter notice notices pagination pager popup privacy promo promotion promoted reader recommended related reply replies respond responds responses search share sharing sidebar signup "
    "skip social sponsor sponsored sponsors subscribe subscription toc toolbar topbar widget widgets".split()
)
_NEUTRAL = frozenset("a area article block body bottom box card container content entry first group inner item items js last left list main new page panel post primary right row secondary section site text the top unit user view wrap wrapper".split())
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>"']+))?""")
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_WORD = re.compile(r"\S+")


def _marked(tag: str, attributes: str, in_article: bool = False) -> float:
    """How far an element says that it is boilerplate: 1 by its tag, role, being hidden, or a class or id of such words only; 0.5 by a class
    or id that has other words too. The header of an article is not boilerplate."""
    if tag in _BOILERPLATE and not (tag == "header" and in_article):
        return 1.0
    if not attributes or tag in ("body", "html", "article", "main"):
        return 0.0
    out = 0.0
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            for own in value.split():
                parts = [x for x in re.findall(r"[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", own).lower()) if x not in _NEUTRAL]
                hints = sum(x in _HINTS and not (x == "header" and in_article) for x in parts)
                out = max(out, 1.0 if hints and hints == len(parts) else 0.5 if hints else 0.0)
        value = value.lower()
        if name == "role" and value in _ROLES or name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return 1.0
    return out


def blocks(page: str) -> list[tuple[str, float, bool, float, bool]]:
    """(text, link density, in an article, how far boilerplate, heading) of each flat block, references decoded, white space as one space."""
    out: list = []
    stack: list[tuple[str, float]] = []  # open elements, and how far they or those around them are boilerplate
    articles = 0
    link = False
    parts: list[tuple[str, bool]] = []
    heading = False
    at = 0

    def flush():
        nonlocal parts
        if parts:
            text = " ".join(html.unescape("".join(t for t, _ in parts)).split())
            if text:
                n = len(text.split())
                linked = sum(len(_WORD.findall(t)) for t, a in parts if a)
                out.append((text, min(1.0, linked / n), articles > 0, stack[-1][1] if stack else 0.0, heading))
            parts = []

    def close(k: int):
        nonlocal articles
        if stack[k][0] in ("td", "th") and stack[k][1] != (stack[k - 1][1] if k else 0.0):
            flush()
        articles -= sum(name in ("article", "main") for name, _ in stack[k:])
        del stack[k:]

    def close_implied(tag: str):
        ended, border = _IMPLIED[tag]
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in ended:
                return close(k)
            if stack[k][0] in border:
                return

    while at < len(page):
        m = _TOKEN.search(page, at)
        if m is None:
            parts.append((page[at:], link))
            break
        if m.start() > at:
            parts.append((page[at : m.start()], link))
        at = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag, closing = tag.lower(), bool(m[1])
        if tag in _CLOSE and not closing:
            if not m[3].endswith("/"):
                end = _CLOSE[tag].search(page, at)
                at = end.end() if end else len(page)
            parts.append((" ", link))
            continue
        if tag == "a":
            link = not closing
        elif tag in ("br", "img", "input"):
            parts.append((" ", link))
        elif tag in ("td", "th"):  # cells of a row are one block, but for those that are marked
            if closing or not m[3]:
                parts.append((" ", link))
            else:
                flush()
        elif tag in _BLOCKS:
            flush()
            link = False
        if tag in _HEADINGS:
            heading = not closing
        elif tag in _BLOCKS:
            heading = False
        if tag in _VOID:
            continue
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    close(k)
                    break
        elif not m[3].endswith("/"):
            if tag in _IMPLIED:
                close_implied(tag)
            elif tag in _BLOCKS:
                close_implied("p")
            if tag in _BLOCKS or tag in ("td", "th") or m[3]:
                around = stack[-1][1] if stack else 0.0
                stack.append((tag, max(around, _marked(tag, m[3], articles > 0))))
                articles += tag in ("article", "main")
    flush()
    return out


def features(found: list[tuple[str, float, bool, float, bool]]) -> np.ndarray:
    x = np.zeros((len(found) + 2, 2))
    x[1:-1, 0] = [len(t.split()) for t, *_ in found]
    x[1:-1, 1] = [f[1] for f in found]
    rest = np.array([f[2:] for f in found], float).reshape(-1, 3)
    return np.hstack([x[1:-1], x[:-2], x[2:], rest])


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8):
    """A decision tree by Gini impurity: a share of ones, or (feature, threshold, tree up to it, tree above it)."""
    share = float(y.mean())
    if depth == 0 or share in (0.0, 1.0):
        return share
    best = (2 * share * (1 - share) * len(y) - 1e-9, None)
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            left = y[x[:, f] <= t]
            right = y[x[:, f] > t]
            cost = sum(2 * s.mean() * (1 - s.mean()) * len(s) for s in (left, right))
            if cost < best[0] - 1e-12:
                best = (cost, (f, float(t)))
    if best[1] is None:
        return share
    f, t = best[1]
    low = x[:, f] <= t
    return f, t, grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)


def predict(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    f, t, low, high = tree
    return np.where(x[:, f] <= t, predict(low, x), predict(high, x))


def train(labelled=LABELLED):
    table = np.array(labelled, float)
    return grow(table[:, :-1], table[:, -1])


def main_text(page: str | None, tree) -> str:
    found = blocks(page or "")
    if not found:
        return ""
    return "\n\n".join(f[0] for f, p in zip(found, predict(tree, features(found))) if p >= 0.5)


def extracted(pages, tree=None):
    """page_id, url, text of pages (page_id, url, html): the main text of each row on its own.

    A null or empty page, and one without main text, has empty text; page_id and url may be null or repeat; extra columns are
    ignored. Comments, scripts, styles and cut-off tags at the end are no text.
    """
    tree = train() if tree is None else tree

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p.as_py(), tree) for p in b.column("html")]
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string())], ["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")


def op4_html_extraction(spark, sf_dir):
    out = extracted(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
