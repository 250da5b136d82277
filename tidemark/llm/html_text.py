"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text, with blank lines where a container (division, section, list, table, ...) begins
or ends. Text lengths are summed over sliding windows of lines. A sum that reaches the threshold is a surge, the next sum of zero its dive:
the text between them is dense. What is dense is kept, with everything in the same container, and what stands between the first surge and
the last dive.

Names are hints that weigh lengths: characters in links count for nothing, lines in menus, headers, footers, sidebars, notices, adverts,
forms and reader comments (by element, class, id or role), and lines outside an article that the page marks, for a twentieth. So a short
hinted part is below the threshold, but a long text that happens to be in a block called `related-work` is above it. The threshold is half
of the page's greatest sum, or `enough` characters if that is less; hinted lines always need the half. In a marked article that has dense
text every line is kept that no hint is against, however short. Scripts, styles and hidden parts never count.

Null html counts as empty and gives an empty text, as do pages without text. Very long pages take time in proportion, and are cut nowhere.
Rows are independent; repeated rows give equal results. A kept column named text or n_chars gives way to the operator's own. An empty
table gives no rows.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tidemark.llm.common import mapped, table

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_WORDS = re.compile(r"[a-z0-9]+")

# Element names and words of class, id and role.
#: Content up to the end tag is no markup.
RAW = {"script", "style", "noscript", "template", "textarea", "title", "iframe", "xmp"}
#: Never text.
UNSEEN = {"head", "svg", "canvas", "select", "button", "object", "audio", "video", "math"}
HINTED = {"nav", "header", "footer", "aside", "form", "menu", "dialog"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
CONTAINERS = {"article", "aside", "blockquote", "body", "center", "details", "dialog", "div", "dl", "fieldset", "figure", "footer", "form", "header", "html", "main", "menu", "nav", "ol", "section", "table", "ul"}
BLOCKS = CONTAINERS | {"address", "br", "caption", "dd", "dt", "figcaption", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "legend", "li", "p", "pre", "summary", "tbody", "td", "tfoot", "th", "thead", "tr"}
ARTICLES = {"article", "main"}
#: Their end tag may be missing: the next block ends them.
LOOSE = {"p", "li", "dt", "dd", "td", "th", "tr", "option"}
BOILERPLATE = {"ad", "ads", "advert", "advertisement", "adverts", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "contentinfo", "cookie", "cookies", "disqus", "footer", "gdpr", "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related", "replies", "search", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
OUTSIDE_ARTICLES = {"header", "masthead"}
#: What a hint leaves of a line's length.
WEIGHT = 1 / 20


@dataclass
class Line:
    """container: number of the innermost one; article: of the one that the page marks, or 0. Blank lines have no text."""

    text: str = ""
    linked: int = 0
    container: int = 0
    hinted: bool = False
    article: int = 0


def _hints(name: str, attributes: str, in_article: bool) -> tuple[bool, bool]:
    """Whether an element's names speak against its text, and whether it is hidden."""
    words: set[str] = set()
    if attributes.strip():
        for m in _NAMED.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true":
                return False, name not in ("html", "body")
            words.update(_WORDS.findall(value.lower()))
    if name in ("html", "body"):
        return False, False
    if name in ARTICLES:
        return bool(words & {"comment", "comments", "reply", "replies"}), False
    if name == "header" and in_article:
        return bool(words & BOILERPLATE), False
    return name in HINTED or bool(words & BOILERPLATE) or not in_article and bool(words & OUTSIDE_ARTICLES), name in UNSEEN


def lines(html: str, gap: int) -> tuple[list[Line], list[int]]:
    """The page as lines, with `gap` blank ones at the edges of containers and hinted parts; and each container's parent (the first is the
    page)."""
    out: list[Line] = []
    parents = [0]
    # open elements that matter: name, container, hinted, hidden, article
    stack: list[tuple[str, int, bool, bool, int]] = [("", 0, False, False, 0)]
    text: list[str] = []
    linked = at = 0
    in_link = False

    def end_line(blank: bool = False) -> None:
        nonlocal linked
        line = " ".join("".join(text).split())
        if line:
            _, container, hinted, _, article = stack[-1]
            out.append(Line(line, min(linked, len(line)), container, hinted, article))
        text.clear()
        linked = 0
        if blank and out and out[-1].text:
            out.extend([Line()] * gap)

    def take(part: str) -> None:
        nonlocal linked
        if part and not stack[-1][3]:
            part = unescape(part)
            text.append(part)
            if in_link:
                linked += len(part.strip())

    def close(name: str) -> None:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == name:
                end_line(True)
                del stack[i:]
                return
            if stack[i][0] in ARTICLES and name not in ("article", "main", "body", "html"):
                return  # an end tag inside an article does not end what began outside it

    while m := _TAG.search(html, at):
        take(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        name, closing = m[2].lower(), bool(m[1])
        if name in RAW and not closing:
            end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(html, at)
            at = end.end() if end else len(html)
            continue
        if name == "a":
            in_link = not closing
            continue
        if closing:
            if name in BLOCKS:
                end_line()
            close(name)
            continue
        if name in BLOCKS or name in LOOSE:
            end_line()
            if stack[-1][0] in LOOSE and (name in LOOSE or name in CONTAINERS):
                end_line(True)
                stack.pop()  # a new paragraph, item or container ends the one before it
        if name in VOID:
            continue
        _, container, hinted, hidden, article = stack[-1]
        against, unseen = _hints(name, m[3], article > 0)
        if name in CONTAINERS or against or unseen:
            end_line(True)
            if name in CONTAINERS:
                parents.append(container)
                container = len(parents) - 1
            if name in ARTICLES and not against:
                hinted, article = False, article or container
            stack.append((name, container, hinted or against, hidden or unseen, article))
    take(html[at:])
    end_line()
    return out, parents


def block_sums(lengths: list[float], window: int) -> list[float]:
    """Sums over lines i - window + 1 .. i, for each line i and window - 1 more."""
    padded = np.r_[np.zeros(window), np.cumsum(np.r_[lengths, np.zeros(window - 1)])]
    return (padded[window:] - padded[:-window]).tolist() if len(lengths) else []


def main_text(html: str | None, window: int = 8, share: float = 0.5, enough: float = 200, links: float = 0.5) -> str:
    """The main text. window: lines of a block, and blank lines between containers. links: a stretch outside marked articles stays if no
    larger part of it is links."""
    rows, parents = lines(html or "", window)
    marked = any(r.article and r.text for r in rows)
    size = []
    for r in rows:
        against = r.hinted + (marked and not r.article)
        size.append(len(r.text) * WEIGHT**against if r.article and not r.hinted else (len(r.text) - r.linked) * WEIGHT**against)
    sums = block_sums(size, window)
    peak = max(sums, default=0.0)
    if not peak:
        return ""
    # stretches: from where the sum leaves zero to where it is zero again; of each, whether a sum in it surges
    stretches: list[tuple[int, int, bool]] = []
    at = 0
    while at < len(rows):
        if not rows[at].text:
            at += 1
            continue
        end = at
        while end < len(rows) and rows[end].text:
            end += 1
        weak = rows[at].hinted or marked and not rows[at].article
        need = share * peak if weak else min(share * peak, enough)
        stretches.append((at, end, max(sums[at : end + window - 1]) >= need - 1e-9 and max(size[at:end]) > 0))
        at = end
    dense = [(a, z) for a, z, surges in stretches if surges]
    first, last = dense[0][0], dense[-1][1]
    articles = {rows[a].article for a, _ in dense} - {0}
    held = {rows[a].container for a, _ in dense}
    around = set.intersection(*(_above(c, parents) for c in held))

    def stays(a: int, z: int, surges: bool) -> bool:
        r = rows[a]
        if surges or r.article in articles and not r.hinted:
            return True
        if r.hinted or marked:
            return False
        if sum(x.linked for x in rows[a:z]) > links * sum(len(x.text) for x in rows[a:z]):
            return False
        up = _above(r.container, parents)
        return r.container in held or bool((held - {0}) & up) and parents[max((held - {0}) & up)] != 0 or first <= a < last and bool(around & up)

    return " ".join(r.text for a, z, surges in stretches if stays(a, z, surges) for r in rows[a:z])


def _above(container: int, parents: list[int]) -> set[int]:
    """A container and all that it is in."""
    out = {container}
    while container:
        container = parents[container]
        out.add(container)
    return out


def extracted(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars (code points)."""

    def extract(pages: list) -> list[pa.Array]:
        texts = [main_text(h) for h in pages]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return mapped(pages, html, keep, T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]), lambda: extract)


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages", "page_id", "url", "html"))
