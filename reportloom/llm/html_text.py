"""Main text of web pages by line-block distribution.

Markup is stripped into lines (one per block element), with menus, page headers, footers, sidebars, notices, adverts,
forms, scripts, styles and reader comments taken out by element, role or class. Over the lines left, text lengths
(nothing for lines that are mostly links) are summed in a sliding window on every page. Where the sums surge over
``SURGE``, the text reaches from the last dive to ``DIVE`` to the next one; every such stretch is kept. ``article`` and
``main`` elements bound the lines if they hold at least as much as the stretches outside them. A page without a surge
gives all of its lines.

Null and empty pages, and pages without text, give an empty string; very long and broken pages are handled whole,
in time that grows with their length. Every row is
handled alone: repeated rows stay, extra columns are ignored, no rows give no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, SURGE, DIVE = 3, 86, 0
#: Characters of linked text that count as one.
LINK_DISCOUNT = 4

_OPEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)")
_PLAIN = re.compile(r"[^<>\"']*")
_STRICT = re.compile(r"[^<>]*")
#: Elements whose content is no markup; they end at their end tag or where the body begins.
_RAW = frozenset("script style noscript template textarea svg iframe object math title head".split())
_RAW_END = {tag: re.compile(rf"</{tag}\s*>|(?=<body\b)", re.I) for tag in _RAW}
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SKIP = frozenset("nav footer aside form button select option dialog menu menuitem fieldset legend optgroup datalist audio video canvas".split())
_ROLE = re.compile(r"\brole\s*=\s*[\"']?(navigation|banner|contentinfo|complementary|search|alert|alertdialog|dialog|form|menu|menubar|note|status)\b", re.I)
_HIDDEN = re.compile(r"\s(hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true)|display\s*:\s*none", re.I)
_NAMED = re.compile(r"\b(?:class|id)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NOISE = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adsense|banner|sponsor(?:ed)?|promo(?:tion)?|sidebar|side|aside|menu|nav|navbar|navigation|breadcrumbs?|footer|foot|header|masthead|topbar|toolbar|cookies?|consent|gdpr"
    r"|notices?|alert|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|share|sharing|social|comments?|commentlist|disqus|repl(?:y|ies)|respond|reactions|discussion|related|recommended|recommendations|teasers?|widgets?|pagination|pager|search|form|tags|tagcloud|copyright|legal|disclaimer|skip|toc)(?:$|[\s_-]|\d)",
    re.I,
)
#: Names that take out what lies around an article, not blocks of its own.
_AROUND = re.compile(r"(?:^|[\s_-])(?:tags|legal|share|side|toc)(?=$|[\s_-]|\d)", re.I)
_MAIN = frozenset(("article", "main"))


def tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """(start, end, closing, name, attributes) of the tags in order; comments, declarations and raw elements have no name.

    One scan forward. Quoted values may hold < and >. A tag that meets a bare < or the end of the page before its > is text
    up to there; so that a lost quote does not hide the tags behind it, that part is read once more, with quotes as plain
    characters. No character is read more often than that, whatever the page.
    """
    at, strict, size = 0, 0, len(page)
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at) or page.startswith("<![CDATA[", at):
            mark = "-->" if page.startswith("<!--", at) else "]]>"
            found = page.find(mark, at + 4)
            end = size if found < 0 else found + 3
            yield at, end, False, "", ""
            at = end
            continue
        m = _OPEN.match(page, at)
        if page.startswith(("<!", "<?"), at):
            end = _STRICT.match(page, at + 1).end()
            if end < size and page[end] == ">":
                yield at, end + 1, False, "", ""
                end += 1
            at = max(end, at + 1)
            continue
        if m is None:
            at += 1
            continue
        end = m.end()
        if at < strict:
            end = _STRICT.match(page, end).end()
        else:
            while (end := _PLAIN.match(page, end).end()) < size and page[end] in "\"'":
                found = page.find(page[end], end + 1)
                end = size if found < 0 else found + 1
        if end >= size or page[end] == "<":
            if at < strict:
                at = end
            else:
                strict = end
            continue
        name, attributes = m[2].lower(), page[m.end() : end]
        end += 1
        if name in _RAW and not m[1]:
            found = _RAW_END[name].search(page, end)
            end = found.end() if found else size
            name = ""
        yield at, end, bool(m[1]), name, attributes
        at = end




def _noise(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is none of the page's main text. ``inside``: it lies in an article or main element."""
    if tag in _SKIP or tag == "header" and not inside:
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return bool(attributes and tag == "article" and any(re.search(r"(?:^|[\s_-])(?:comment|reply|teaser|ad)s?(?:$|[\s_-])", a or b or c, re.I) for a, b, c in _NAMED.findall(attributes)))
    if _ROLE.search(attributes) or _HIDDEN.search(attributes):
        return True
    names = [a or b or c for a, b, c in _NAMED.findall(attributes)]
    return any(_NOISE.search(_AROUND.sub(" ", n) if inside else n) for n in names)


def lines_of(page: str) -> list[tuple[str, int, int]]:
    """(text, weight, main): lines in page order; ``main`` numbers the outermost main element, 0 outside."""
    out: list[tuple[str, int, int]] = []
    # Of each open element its name, whether it is noise, the main element that it opens, and the open paragraph (its place in
    # the stack) with nothing but inline elements above, -1 if there is none.
    stack: list[tuple[str, bool, int, int]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    skip = main = mains = links = linked = 0

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append((text, max(1, len(text) - linked + linked // LINK_DISCOUNT), main))
            parts.clear()
        linked = 0

    def close(at: int):
        nonlocal skip, main, links
        while len(stack) > at:
            tag, noisy, number, _ = stack.pop()
            opened[tag] -= 1
            skip -= noisy
            links -= tag == "a"
            if number:
                main = 0

    at = 0
    for start, end, closing, tag, attributes in tags(page):
        if not skip and start > at:
            parts.append(text := page[at:start])
            if links > 0:
                linked += len(text)
        at = end
        if not tag:
            continue
        if tag not in _INLINE and (not skip or closing):
            flush()
        if closing:
            if opened[tag] > 0:
                k = len(stack) - 1
                while stack[k][0] != tag:
                    k -= 1
                close(k)
        elif tag not in _VOID and not attributes.endswith("/"):
            if tag not in _INLINE and stack and stack[-1][3] >= 0:  # a block ends an open paragraph
                close(stack[-1][3])
            noisy, number = _noise(tag, attributes, main > 0), 0
            if tag in _MAIN and not main and not skip and not noisy:
                mains += 1
                main = number = mains
            skip += noisy
            links += tag == "a"
            paragraph = len(stack) if tag == "p" else stack[-1][3] if tag in _INLINE and stack else -1
            stack.append((tag, noisy, number, paragraph))
            opened[tag] += 1
    if not skip and at < len(page):
        parts.append(page[at:])
    flush()
    return out


def stretches(lines: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the runs of lines between two dives in which the window sums surge.

    Windows are centred on their line and padded at the ends, so that a short first or last line counts as its neighbours do.
    """
    weights = [0 if w * 2 < len(text) else w for text, w, _ in lines]
    half = WINDOW // 2
    sums = [sum(weights[max(0, i - half) : i + half + 1]) for i in range(len(weights))]
    out, i = [], 0
    while i < len(sums):
        start = i
        while i < len(sums) and sums[i] > DIVE:
            i += 1
        if i > start and max(sums[start:i]) > SURGE:
            held = [k for k in range(start, i) if weights[k]]  # lines of links do not belong to the ends
            out.append((held[0], held[-1] + 1))
        i += i == start
    return out


def extract(page: str | None) -> str:
    """The main text: lines between surge and dive, joined by one space."""
    lines = lines_of(page or "")
    marked, rest = [x for x in lines if x[2]], [x for x in lines if not x[2]]
    if marked and rest:
        # Marked elements bound the text, unless what surges outside is more than they hold.
        outside = sum(x[1] for a, b in stretches(rest) for x in rest[a:b])
        if sum(x[1] for x in marked) >= outside:
            lines = marked
    found = stretches(lines)
    chosen = [x for a, b in found for x in lines[a:b]] if found else lines
    return " ".join(text for text, _, _ in chosen)


def main_text(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars (code points) for every row."""

    def of(batches):
        for b in batches:
            texts = [extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(of, "page_id long, url string, text string, n_chars long")
