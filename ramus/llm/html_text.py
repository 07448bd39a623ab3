"""HTML extraction by line-block distribution.

Markup is stripped to lines, one for each block of the page. A line's length counts only text
that can be article text: none inside elements or classes that hold page furniture, none outside
<article> or <main> where the page has one, none in lines made mostly of links (a page's <h1> may be one). Headings and
paragraphs inside <article> or <main> are text, linked or short. Lengths are summed over sliding
windows of lines; text starts where the sums surge and ends where they dive to zero, and everything
between is kept, short lines too.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

WINDOW = 3
#: A window sum that marks a surge, and the share of the page's largest that does so in small pages.
SURGE, SHARE = 80, 0.25

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_RAW = {t: re.compile(rf"</{t}\b[^>]*>", re.I) for t in ("script", "style", "textarea", "template", "noscript", "svg", "iframe", "title")}
_INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_CORE = frozenset(("article", "main"))
#: Elements whose end tag is often left out; the next of its kind ends them.
_LOOSE = frozenset("p li dt dd tr td th option".split())
_FURNITURE = frozenset("nav footer header aside form menu button select dialog fieldset".split())
_BODY = frozenset("h1 h2 h3 h4 h5 h6 p".split())
#: Class and id names of furniture, and roles.
_COMMENTS = frozenset("comment comments commentlist commentary disqus discussion replies reply respond".split())
_CLASSES = _COMMENTS | frozenset(
    "ad ads advert advertisement adverts banner breadcrumb breadcrumbs consent cookie cookies disclaimer footer header masthead menu modal nav navbar "
    "navigation newsletter notice notices pager pagination popup promo promotion related share sharing sidebar skip social sponsor sponsored "
    "subscribe subscription toolbar widget widgets".split()
)
_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog menu menubar navigation search toolbar".split())
#: What may follow a furniture word in a name (ad-slot, comment-list); other words make it a name of something else.
_PLACES = frozenset(
    "area author bar block body bottom box button buttons col column container content form group icons inner item items left links list main message meta "
    "outer overlay panel posts primary right secondary section slot stories text thread title top unit wrap wrapper".split()
)
#: What a name says of its element, not that the element is it (has-sidebar, no-comments).
_QUALIFIERS = frozenset("has hide is js no non not show with without".split())
_OWN = frozenset("article content entry news page post story".split())
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CONCEALED = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")


def _names_furniture(name: str, words: frozenset[str]) -> bool:
    """Whether a class or id, taken as a whole, names furniture of these kinds."""
    if name.lower() in words:
        return True
    parts = [x.lower() for x in _PARTS.findall(name)]
    if len(parts) < 2 or parts[0] in _QUALIFIERS:
        return False
    if parts[-1] == "header" and parts[0] in _OWN:  # an article's own title
        return False
    return parts[-1] in words or parts[0] in words and all(x in _PLACES or x.isdigit() for x in parts[1:])


def is_furniture(tag: str, attrs: str) -> str:
    """"comments" or "other" where an element holds reader comments or other furniture, else nothing."""
    if attrs and tag not in ("html", "body", "main"):
        for m in _ATTRIBUTE.finditer(attrs):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" and value.lower() != "until-found" or name == "aria-hidden" and value.lower() == "true" or name == "style" and _CONCEALED.search(value):
                return "other"
            if name == "role" and value.lower() in _ROLES and tag != "article":
                return "other"
            if name in ("class", "id"):
                names = value.split()
                if any(_names_furniture(x, _COMMENTS) for x in names):
                    return "comments"
                if tag not in _CORE and tag not in ("h1", "h2", "h3", "h4", "h5", "h6") and any(_names_furniture(x, _CLASSES) for x in names):
                    return "other"
    return "other" if tag in _FURNITURE else ""


def tags_of(page: str) -> tuple[list[tuple[int, int, str, bool, str]], dict[int, int], set[str]]:
    """(tags, end tag of each start tag, names of elements that aren't all closed). A tag is
    (begin, end, name, is an end tag, attributes); comments and raw elements are tags without a name."""
    tags: list[tuple[int, int, str, bool, str]] = []
    partner: dict[int, int] = {}
    waiting: dict[str, list[int]] = {}
    uneven: set[str] = set()
    at = 0
    while m := _TOKEN.search(page, at):
        at = m.end()
        tag, ending = (m[2] or "").lower(), m[1] == "/"
        if tag in _RAW and not ending:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else len(page)
            tag = ""
        elif ending:
            if waiting.get(tag):
                partner[waiting[tag].pop()] = len(tags)
            else:
                uneven.add(tag)
        elif tag and tag not in _VOID and not m[3].rstrip().endswith("/"):
            waiting.setdefault(tag, []).append(len(tags))
        tags.append((m.start(), at, tag, ending, m[3] or ""))
    return tags, partner, uneven | {t for t, open_ in waiting.items() if open_}


def _skipped(k: int, kind: str, tags, partner: dict[int, int], uneven: set[str]) -> int:
    """Index of the tag after a piece of furniture that begins with tag k."""
    tag = tags[k][2]
    if tag in _LOOSE and (tag == "p" or k not in partner):
        stop = next((i for i in range(k + 1, len(tags)) if tags[i][2] and tags[i][2] not in _INLINE and (tag == "p" or tags[i][2] == tag or tags[i][3])), len(tags))
        return stop + 1 if stop < len(tags) and tags[stop][2] == tag and tags[stop][3] else stop
    end = partner.get(k, len(tags))
    if end < len(tags) and (kind == "comments" or tag not in uneven):
        return end + 1
    # perhaps never closed: an article ends it
    return next((i for i in range(k + 1, end) if tags[i][2] in _CORE and not tags[i][3] and not is_furniture(tags[i][2], tags[i][4])), min(end + 1, len(tags)))


def _holds_article(k: int, tags, partner: dict[int, int]) -> bool:
    """Whether a form is one around the page, not one to fill in."""
    return any(not e and (t in _CORE or t == "h1") for _, _, t, e, _ in tags[k + 1 : partner.get(k, len(tags))])


def lines_of(page: str, core: bool = True) -> list[tuple[str, int, int, bool]]:
    """(text, characters, of those in links, heading or paragraph of <article> or <main>) for each block
    with text; furniture gives one empty line. With core, a page's <article> and <main> hold all its text."""
    tags, partner, uneven = tags_of(page)
    out: list[tuple[str, int, int, bool]] = []
    text: list[str] = []
    linked = in_link = inside = 0
    has_core = body = title = False

    def close():
        nonlocal linked
        joined = " ".join(html.unescape("".join(text)).split()) if text else ""
        if joined:
            out.append((joined, len(joined), 0 if title else min(linked, len(joined)), body))
        text.clear()
        linked = 0

    k = at = 0
    while k <= len(tags):
        begin, end, tag, ending, attrs = tags[k] if k < len(tags) else (len(page), len(page), "", False, "")
        if at < begin and (inside or not has_core):
            text.append(page[at:begin])
            if in_link:
                linked += begin - at
        at, k = end, k + 1
        if not tag:
            continue
        kind = "" if ending or tag in _VOID else is_furniture(tag, attrs)
        if kind and not (tag == "header" and inside) and not (tag == "form" and _holds_article(k - 1, tags, partner)):
            close()
            out.append(("", 0, 0, False))
            body = False
            if not attrs.rstrip().endswith("/"):
                k = _skipped(k - 1, kind, tags, partner, uneven)
                at = tags[k - 1][1] if k <= len(tags) and tags[k - 1][3] else tags[k][0] if k < len(tags) else len(page)
        elif core and tag in _CORE:
            close()
            if not ending and not has_core:  # what stood before isn't article text
                out.clear()
                has_core = True
            inside = max(0, inside - 1) if ending else inside + 1
            body = False
        elif tag == "a":
            in_link = 0 if ending else 1
        elif tag not in _INLINE:
            close()
            in_link = 0
            if tag not in _VOID:
                body = bool(inside) and not ending and tag in _BODY
                title = tag == "h1" and not ending
    close()
    return out


def main_lines(lines: list[tuple[str, int, int, bool]]) -> list[str]:
    """The lines between surge and dive points of the length distribution."""
    lengths = [n if body or 2 * linked <= n else 0 for _, n, linked, body in lines]
    if not any(lengths):
        return []
    sums = [sum(lengths[i : i + WINDOW]) for i in range(len(lengths))]
    least = min(SURGE, SHARE * max(sums))
    kept: list[str] = []
    i = 0
    while i < len(lines):
        if not lengths[i] or (sums[i] < least and not lines[i][3]):
            i += 1
            continue
        begin = i
        while begin and lengths[begin - 1]:  # back over the short lines before the surge
            begin -= 1
        end = i
        while end < len(lines) and sums[end]:  # a dive: a whole window without text
            end += 1
        kept += [lines[k][0] for k in range(begin, end) if lines[k][1]]
        i = end
    return kept


def extract(page: str | None) -> str:
    """The main text of one page; empty for null, empty and text-free pages. Where <article> and
    <main> hold none, the whole page is looked at."""
    if not page:
        return ""
    return " ".join(main_lines(lines_of(page)) or main_lines(lines_of(page, core=False)))


def _run(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in frames:
        got = [extract(h) for h in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column(0), b.column(1), pa.array(got, pa.string()), pa.array([len(t) for t in got], pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html).

    Null and empty html, and pages without text, give an empty text. Rows are independent:
    repeated rows and ids are extracted each. Other columns are ignored; an empty table gives no rows.
    """
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(_run, f"page_id {kind}, url string, text string, n_chars long")


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
