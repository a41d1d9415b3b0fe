"""Main-text extraction by line-block distribution.

Markup is stripped into one line per block element. A line's weight is the
length of its text, or 0 where most of it is links. Menus, sidebars, footers,
dialogs, hidden elements and reader comments are no lines at all. Lines fall
into up to three sequences in page order: those inside ``article`` or
``main`` weigh SURGE more each; those outside weigh a FAINT part where there
are any inside; those in forms and in boxes whose class or id names them
furniture (adverts, notices, sharing ...) weigh a FAINT part of that.

In each sequence weights are summed over sliding windows of WINDOW lines.
Text surges where a sum exceeds SURGE (on a page without such a window, half
of its largest sum) and dives where the sum falls to 0. What lies between is
kept whole, with the weighted lines that lead up to the surge. So a class word
takes weight away but cannot drop an article, nor a box with much text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from strandsift.llm.common import field, sliced, tuned

WINDOW = 3
#: Characters in a window that count as a surge.
SURGE = 90
#: What is left of the weight of a line outside the article, and of one in a box that its name calls furniture.
FAINT = 0.1

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    # skipped with what they hold: to the end of the page without an end tag where browsers read them so, else the tag alone
    r"|<(?:svg|math)(?=[\s/>])(?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+(?<=/)>"
    r"|<(script|style|textarea)(?=[\s/>])(?:.*?</\1\s*>|.*\Z)"
    r"|<(template|svg|object)(?=[\s/>]).*?</\2\s*>"
    r"|<(noscript|iframe|select|button|canvas|audio|video)(?=[\s/>])(?:(?!<\3[\s/>]).)*?</\3\s*>"
    r"|<head(?:\s[^>]*)?>.*?(?:</head\s*>|(?=<body\b)|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|</?[a-zA-Z][^>]*>"
    r"|<[!?/][^>]*>"
    r"|<[a-zA-Z/!?][^<>]*\Z",
    re.S | re.I,
)
_NAMED = re.compile(r"(?:\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?)", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

_INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q ruby rb rp rt s samp "
    "small span strike strong sub sup time tt u var wbr "
    "math annotation merror mfenced mfrac mi mmultiscripts mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup "
    "mtable mtd mtext mtr munder munderover semantics".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose end tag matters to what is furniture.
_BOXES = frozenset(
    "article aside blockquote body details dialog div dl fieldset figure footer form header html main menu nav ol section table ul".split()
)
_FURNITURE = frozenset("nav aside footer menu dialog".split())
_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog toolbar".split())
_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox adslot sponsor sponsored sponsors promo promotion banner menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar sidebars widget widgets masthead topbar cookie cookies consent gdpr notice notices notification "
    "popup modal overlay newsletter subscribe subscription signup login signin share sharing social related recommended recommendations "
    "search searchform pager pagination copyright toolbar skip aside footer".split()
)
_COMMENTS = frozenset("comment comments commentlist disqus replies reply respond".split())
#: With these, a name still means the element; with others, as in "recommended-reading-notes", it need not.
_NEUTRAL = frozenset(
    "area bar block body bottom box button buttons card cards col column container content feed form group header holder icons inner item items layer left "
    "links list main module outer page panel popular post posts primary right row secondary section site slot story stories text thread title "
    "top unit wrap wrapper block".split()
)

#: What an element does to the lines in it.
_DARK, _SAID, _DIM = "dark", "said", "dim"


def _kind(tag: str, attrs: str, in_body: bool) -> str | None:
    """_DARK: no lines; _SAID: reader comments, no lines either; _DIM: faint lines."""
    if tag in _FURNITURE or (tag == "header" and not in_body):
        return _DARK
    found = _DIM if tag == "form" else None
    if not attrs or tag in ("html", "body", "main"):
        return found
    for m in _NAMED.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "role" and value.lower() in _ROLES):
            return _DARK
        if name in ("class", "id"):
            for one in value.split():
                words = {w.lower() for w in _PART.findall(one) if not w.isdigit()}
                if words & _COMMENTS and words <= _COMMENTS | _WORDS | _NEUTRAL:
                    return _SAID
                if tag != "article" and words <= _WORDS | _NEUTRAL and (words & _WORDS or ("header" in words and not in_body and tag != "h1")):
                    found = _DIM
    return found


class Line(NamedTuple):
    text: str
    #: Characters outside links.
    free: int
    #: In an article or main element.
    inside: bool
    #: The number of the faint box that it stands in, or 0.
    box: int


def lines_of(page: str) -> list[Line]:
    """The lines of a page that are not in furniture, in page order."""
    lines: list[Line] = []
    buf: list[str] = []
    free = 0  # characters outside links
    links = 0
    boxes: list[tuple[str, int, int, int, int]] = []  # name, and outside it: dark, said, faint box, body depth
    dark, said, dim, body = 0, 0, 0, 0
    named = 0

    def flush() -> None:
        nonlocal free
        if buf:
            text = " ".join(html.unescape("".join(buf)).split())
            if text and not dark and not said:
                lines.append(Line(text, min(free, len(text)), body > 0, dim))
            buf.clear()
        free = 0

    at = 0
    for m in _TOKEN.finditer(page):
        if m.start() > at:
            piece = page[at : m.start()]
            buf.append(piece)
            if not links:
                free += len(piece.strip())
        at = m.end()
        tag = m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if tag in _INLINE:
            if tag == "a":
                links = 0 if m[4] else 1
            elif tag == "br":
                buf.append(" ")
            continue
        flush()
        links = 0
        if tag not in _BOXES or tag in _VOID:
            continue
        if m[4]:
            for k in range(len(boxes) - 1, -1, -1):
                if boxes[k][0] == tag:
                    _, dark, said, dim, body = boxes[k]
                    del boxes[k:]
                    break
        elif not m[6].endswith("/"):
            boxes.append((tag, dark, said, dim, body))
            kind = _kind(tag, m[6], body > 0)
            if kind == _DARK:
                dark += 1
            elif kind == _SAID:
                said += 1
            elif kind == _DIM:
                named += 1
                dim = named
            elif tag in ("article", "main"):
                if not body:
                    dark = dim = 0  # an unclosed menu before it, or a box around it
                body += 1
    if at < len(page):
        buf.append(page[at:])
        if not links:
            free += len(page[at:].strip())
    flush()
    return lines


def sequences(lines: list[Line]) -> list[list[tuple[float, int]]]:
    """The (weight, number of the line) of the lines inside the article, outside it, and in faint boxes, which are kept apart by empty windows."""
    within = any(x.inside and not x.box for x in lines)
    inside: list[tuple[float, int]] = []
    outside: list[tuple[float, int]] = []
    faint: list[tuple[float, int]] = []
    last = 0
    for i, x in enumerate(lines):
        weight = float(len(x.text)) if 2 * x.free >= len(x.text) else 0.0
        part = FAINT if within and not x.inside else 1.0
        if x.box:
            if x.box != last:
                faint += [(0.0, -1)] * WINDOW
                last = x.box
            faint.append((weight * part * FAINT, i))
        elif x.inside:
            inside.append((len(x.text) + SURGE, i))
        else:
            outside.append((weight * part, i))
    return [inside, outside, faint]


def windows_of(weights: list[float]) -> list[float]:
    return [sum(weights[i : i + WINDOW]) for i in range(len(weights))]


def between(weights: list[float], threshold: float) -> list[int]:
    """The places from each surge, with the weighted ones that lead up to it, to the dive after it."""
    window = windows_of(weights)
    out: list[int] = []
    i, n = 0, len(weights)
    while i < n:
        if not (window[i] > threshold and weights[i] > 0):
            i += 1
            continue
        first, floor = i, out[-1] + 1 if out else 0
        while first > floor and weights[first - 1] > 0:
            first -= 1
        while i < n and window[i] > 0:
            i += 1
        out.extend(range(first, i))
    return out


def kept_lines(lines: list[Line]) -> list[int]:
    """The numbers of the lines between surges and dives, in page order."""
    rows = sequences(lines)
    most = max((w for row in rows for w in windows_of([x for x, _ in row])), default=0.0)
    threshold = min(SURGE, most / 2)
    return sorted(row[k][1] for row in rows for k in between([x for x, _ in row], threshold) if row[k][1] >= 0)


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line; '' for a null or empty page."""
    if not page:
        return ""
    lines = lines_of(page)
    return "\n\n".join(lines[i].text for i in kept_lines(lines))


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in sliced(it, "html"):
        out = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(out, pa.string()), pa.array([len(x) for x in out], pa.int64())],
            names=["page_id", "url", "text", "n_chars"],
        )


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of every page; null html gives the empty text.

    Rows stay as they are: repeated rows give repeated results, null ids and
    urls are carried along, an empty table gives an empty result, other
    columns are not read whatever their names. Very long pages are taken
    whole, one at a time.
    """
    tuned(pages.sparkSession)
    narrow = pages.select(field(id_col).cast("long").alias("page_id"), field(url_col).cast("string").alias("url"), field(html_col).cast("string").alias("html"))
    return narrow.mapInArrow(_batches, "page_id bigint, url string, text string, n_chars bigint")


def op5_line_blocks(spark, sf_dir: str) -> DataFrame:
    return extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))
