"""HTML extraction by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score positive, words in links and tags negative, with weights learned
from labelled pages; one linear scan finds the contiguous region with the largest sum, which holds the main text.
What lies inside the region but in a menu, form, notice and the like is left out, the rest becomes lines. A form
or an element marked by its name that holds most of the page's words, or its heading, is layout, and its words are
scored. Malformed markup: end tags that HTML lets authors leave out are supplied; an element that is never closed
otherwise reaches to the next block if its name marks it; a tag that never ends, ends where the next begins.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections.abc import Iterator
from math import log

import pyarrow as pa
from pyspark.sql import DataFrame

from ledgerloom.llm.labelled_pages import PAGES
from ledgerloom.llm.shared import bounded_batches, lean

#: One comment, raw element, declaration, tag, or run of text. No alternative looks back, so a page takes time in
#: proportion to its length.
PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea)\b(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|(?=<)|\Z)|[^<]+|<",
    re.I | re.S,
)
NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
#: Elements whose text is never content; of these a form may be the layout of the page.
APART = {"nav", "header", "footer", "aside", "form", "head", "title", "select", "button", "dialog", "menu", "object", "label"}
#: Names in class, id or role that mark such an element.
MARKED = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|gdpr|notice|alert|popup|modal|overlay|nav\w*|menu\w*|breadcrumbs?|sidebar\w*"
    r"|footer|header|masthead|comments?|replies|disqus|share|sharing|social|related|recommend\w*|newsletter|subscribe|signup|login|search|pagination|pager|widget|toolbar|tags)(?=$|[\s_-])",
    re.I,
)
#: Names of remarks and offers beside the content, which are not layout while the page has words elsewhere.
BESIDE = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|sponsor\w*|promo\w*|cookies?|consent|gdpr|popup|modal|comments?|replies|disqus|related|recommend\w*|newsletter|subscribe)(?=$|[\s_-])", re.I)
SIDEBAR = re.compile(r"(?:^|[\s_-])(?:sidebars?|widget)(?=$|[\s_-])", re.I)
#: Names that tell what an element has, or of its subject, not what it is.
HAS = re.compile(r"(?<!\S)(?:has|with|no|without|category|tag)[_-]\S*", re.I)
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Tags inside a line of text; all others begin a new block.
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
#: Elements that a tag of the same group ends, where their own end tag is left out; a new block also ends a paragraph.
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
OPTIONAL_END = {"p", *SIBLINGS}
#: What only the page's own text has: an element that holds one isn't beside the content.
HEADING = {"h1", "main"}
#: The article itself: whatever was left open before it ends here, but for closed elements beside the content.
BODY = {"article", "main"}


def kind_of(name: str, attributes: str) -> str:
    """Why an element is left out: ``apart``, ``beside``, ``sidebar`` or ``marked``; '' if it isn't."""
    if name in APART and name != "form":
        return "apart"
    if name in ("html", "body"):
        return ""
    names = [HAS.sub(" ", x.strip("\"'")) for x in NAMES.findall(attributes)] if attributes else []
    for kind, marks in (("beside", BESIDE), ("sidebar", SIDEBAR), ("marked", MARKED)):
        if any(marks.search(x) for x in names):
            return kind
    return "marked" if name == "form" else ""


def element_ends(found: list[tuple[str, str, str | None]]) -> tuple[list[int], list[bool]]:
    """For each opening tag the piece at which its element ends, and whether that is certain: by its own end tag, or
    where HTML supplies one."""
    n = len(found)
    ends, certain = [n] * n, [False] * n
    stack: list[int] = []
    held: dict[str, int] = {}

    def pop_to(k: int, at: int, own: bool) -> None:
        """Ends what lies above place k of the stack, and k itself."""
        while len(stack) > k:
            i = stack.pop()
            tag = found[i][0]
            held[tag] -= 1
            ends[i], certain[i] = at, tag in OPTIONAL_END or own and len(stack) == k

    for at, (tag, _, kind) in enumerate(found):
        if not tag:
            continue
        if tag[0] == "/":
            if held.get(tag[1:]):
                k = len(stack) - 1
                while found[stack[k]][0] != tag[1:]:
                    k -= 1
                pop_to(k, at, True)
            continue
        closes = {"p", *SIBLINGS.get(tag, ())} if tag not in INLINE else set()
        if any(held.get(x) for x in closes):
            k, most = len(stack) - 1, -1
            while k >= 0 and ((top := found[stack[k]][0]) in INLINE or top in OPTIONAL_END):
                if top in closes:
                    most = k
                k -= 1
            if most >= 0:
                pop_to(most, at, False)
        if kind is not None:
            stack.append(at)
            held[tag] = held.get(tag, 0) + 1
    pop_to(0, n, False)
    return ends, certain


def left_out(found: list[tuple[str, str, str | None]]) -> list[bool]:
    """Whether each piece (tag or '', text, kind) lies in an element that is never content."""
    n = len(found)
    ends, certain = element_ends(found)
    bodies = [i for i, (tag, _, _) in enumerate(found) if tag in BODY]
    headings = [i for i, (tag, _, _) in enumerate(found) if tag in HEADING]
    blocks = [i for i, (tag, _, _) in enumerate(found) if tag and tag[0] != "/" and tag not in INLINE]

    def first_in(places: list[int], i: int, last: int) -> int:
        """The first of the places after i, or ``last``."""
        k = bisect_right(places, i)
        return min(last, places[k]) if k < len(places) else last

    def end(i: int) -> int:
        """Where the element that begins at i ends: at an article in it, unless it is closed and beside the content;
        a marked one that isn't closed at the next block."""
        tag, _, kind = found[i]
        if certain[i] and (kind in ("beside", "sidebar") or tag in ("aside", "nav", "footer", "menu", "dialog")):
            return ends[i]
        if not certain[i] and kind != "apart":
            return first_in(blocks, i, ends[i])
        return first_in(bodies, i, ends[i])

    def outside(kinds: tuple[str, ...]) -> list[int]:
        """Running number of words in no element of these kinds, by piece."""
        total, until, out = 0, 0, [0]
        for i, (tag, text, kind) in enumerate(found):
            if not tag and i >= until:
                total += len(text.split())
            elif kind in kinds and i >= until:
                until = end(i)
            out.append(total)
        return out

    words = outside(("apart", "beside"))
    others = words[-1] > 0
    if not others:
        words = outside(("apart",))
    every = outside(("apart",))
    out, until = [], 0
    for i, (_, _, kind) in enumerate(found):
        if kind and i >= until:
            last = end(i)
            inside = words[min(last, ends[i])] - words[i]
            heading = first_in(headings, i, n) < last and 2 * (every[last] - every[i]) > every[-1]
            if kind == "apart" or kind == "beside" and others and not heading or 2 * inside <= words[-1] and not heading:
                until = last
        out.append(i < until)
    return out


def pieces(page: str) -> Iterator[tuple[str, str, bool]]:
    """(tag or '', text, kept) in page order: closing tags begin with ``/``; ``kept`` is False for what is in
    an element that is never content. Comments, scripts and styles are dropped."""
    found: list[tuple[str, str, str | None]] = []  # kind None: a tag that opens nothing
    for m in PIECE.finditer(page):
        if m[3] is None:
            if m[1] is None and not m[0].startswith(("<!", "<?")):
                found.append(("", m[0], ""))
            continue
        name = m[3].lower()
        if m[2]:
            found.append(("/" + name, "", ""))
        else:
            found.append((name, "", None if name in VOID or m[4].endswith("/") else kind_of(name, m[4])))
    for (tag, text, _), out in zip(found, left_out(found), strict=True):
        yield tag, text, not out


def in_links(found: list[tuple[str, str, bool]]) -> Iterator[bool]:
    """Whether each piece lies in a link."""
    inside = False
    for tag, _, _ in found:
        inside = tag == "a" or inside and tag != "/a"
        yield inside


def learn_weights(pages: list[list[tuple[bool, str]]]) -> tuple[float, float, dict[str, float], float]:
    """Weights of a word that may be content, of one in a link, of each tag, and of tags never seen: log odds of
    standing inside the content, smoothed by one; tags and words in links at most -0.1, so they score negative.
    Words in an element left out score nothing: content goes on after it."""
    words, links, tags = [1, 1], [1, 1], {}
    for page in pages:
        text = "".join(x for _, x in page)
        ends, at = [], 0
        for inside, x in page:
            at += len(x)
            ends.append((at, inside))
        at = 0
        found = list(pieces(text))
        for (tag, run, kept), link in zip(found, in_links(found), strict=True):
            # The piece's place is that of its text or of its tag, found in order.
            at = text.index(run if not tag else f"<{tag}", at)
            inside = next(i for end, i in ends if at < end)
            if tag:
                tags.setdefault(tag.lstrip("/"), [1, 1])[inside] += 1
            elif kept or link:
                (links if link else words)[inside] += len(run.split())
    odds = lambda n: log(n[1] / n[0])
    return odds(words), min(-0.1, odds(links)), {t: min(-0.1, odds(n)) for t, n in tags.items()}, -0.5


WORD, LINK_WORD, TAG, TAG_UNSEEN = learn_weights(PAGES)


def best_region(found: list[tuple[str, str, bool]]) -> tuple[int, int]:
    """The contiguous run of pieces of largest summed weight."""
    best, total, start, span = 0.0, 0.0, 0, (0, 0)
    for i, ((tag, text, kept), link) in enumerate(zip(found, in_links(found), strict=True)):
        total += TAG.get(tag.lstrip("/"), TAG_UNSEEN) if tag else (LINK_WORD if link else WORD) * kept * len(text.split())
        if total <= 0:
            total, start = 0.0, i + 1
        elif total > best:
            best, span = total, (start, i + 1)
    return span


def main_text(page: str | None) -> str:
    """The page's main text: its blocks in page order, one a line, white space inside a block as one space."""
    if not page:
        return ""
    found = list(pieces(page))
    lo, hi = best_region(found)
    lines, line = [], []
    for tag, text, kept in found[lo:hi]:
        if not tag:
            if kept:
                line.append(text)
        elif tag.lstrip("/") not in INLINE:
            lines.append("".join(line))
            line = []
        elif tag == "br":
            line.append(" ")
    lines.append("".join(line))
    return "\n".join(x for x in (" ".join(html.unescape(x).split()) for x in lines) if x)


def extract_content(df: DataFrame, html_column: str = "html") -> DataFrame:
    """df with the columns text (empty where a page has none) and n_chars (its code points), in place of its own
    columns of these names and of the html. A null page is an empty one; nothing is dropped or capped; rows that
    repeat are judged alike. No shuffle."""
    bounded_batches(df.sparkSession)
    others = [c for c in df.columns if c not in (html_column, "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x) for x in b.column(html_column).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in others] + [pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=[*others, "text", "n_chars"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in others)
    return df.select(*others, html_column).mapInArrow(lean(run), f"{fields}{', ' if fields else ''}text string, n_chars long")
