"""Main text of HTML pages by tag-path ratios.

A page is read as a stream of tags and text. Text falls into blocks, one per
stretch between block-level tags. A block's tag path is the names of the
block-level tags from the root to it; equal paths are one, wherever on the page they
occur. For each path the text length outside links and the punctuation are added up
over its blocks and divided by their number. Both ratios are smoothed over the
paths in the order of the page, fused as their geometric mean, and paths that reach
SIMILAR of the greatest one are content.

The main text is all of one element: the article or main that holds HOLDS of the
content, else the lowest element that holds all blocks of content paths that are
not short beside them. Nothing below it is dropped but parts that are none of the
article: by their tags or roles everywhere; by words in class or id (comments,
adverts, sidebars and the like) outright where a word can mean nothing else, and for
words that may be the article's own (related, share, notice) only where
the element's text agrees, being mostly links or short pieces.

Elements are numbered as they open and know their parent, so sums run over them once,
however deep they are nested.

Defined results: null or empty html has empty text; a page without content
has empty text; markup that is cut off or badly nested is read as far as it
goes, and a quotation mark that is never closed ends with its tag; repeated rows
are independent; very long pages are read whole; extra columns are ignored."""

from __future__ import annotations

import html as _html
import re

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import input_columns

# Element names of the HTML standard, and words that name parts of a page.
RAW_TEXT = "script style noscript template iframe svg math object canvas textarea xmp noembed noframes".split()
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead title tr ul".split()
)
LEFT_OUT = frozenset("head title nav footer aside form button select option menu dialog fieldset legend input label search".split())
CLOSES_P = BLOCK - frozenset("body head html option optgroup td th tr tbody thead tfoot".split())
# words that name a part wherever they stand, and those that may be the article's own
PARTS = frozenset("ad ads advert adverts advertisement advertising sponsored sidebar sidenav comment comments comentarios kommentare commentaires disqus cookie cookies consent gdpr newsletter popup modal breadcrumb breadcrumbs".split())
MAYBE_PARTS = frozenset(
    "sponsor promo promotion banner menu nav navbar navigation notice notices alert overlay subscribe subscription signup login share sharing social related "
    "recommended reply replies respond discussion footer header masthead pagination pager widget toolbar".split()
)
PART_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(?P<raw>{'|'.join(RAW_TEXT)})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(?P<end2>/)?(?P<tag2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)(?:>|\Z)",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.IGNORECASE)
_PARTS = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？]")
#: Share of the content that one article must hold, and of the greatest score that content paths need.
HOLDS, SIMILAR = 0.5, 0.5
#: An element that may be a part is one where links are this share of its text, or its blocks are shorter on average.
LINKED, SHORT = 0.3, 40
# how an open element of one kind ends at the next: those it closes, and those it doesn't reach beyond
_CLOSES = {
    "p": (("p",), BLOCK - {"p"}), "li": (("li",), frozenset(("ul", "ol", "menu"))), "dt": (("dt", "dd"), frozenset(("dl",))),
    "tr": (("tr",), frozenset(("table",))), "td": (("td", "th"), frozenset(("tr", "table"))), "body": (("head",), frozenset()),
}
_CLOSES |= {"dd": _CLOSES["dt"], "th": _CLOSES["td"]}


class Page:
    """Blocks and elements of a page; elements are numbered as they open, so a parent comes before its children."""

    def __init__(self, page: str):
        self.parent, self.tag, self.maybe = [-1], [""], [False]
        self.path = [0]  # of each element; equal paths have one number
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[tuple[int, str, int]] = []  # element, raw text, length of links
        self._open: list[tuple[str, bool, int]] = []  # tag, whether left out, element
        self._count: dict[str, int] = {}
        self._hidden = self._links = self._linked = 0
        self._text: list[str] = []
        self._element = self._where = 0
        at = 0
        for m in _TOKEN.finditer(page):
            self._take(page[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag:
                self._tag(tag.lower(), bool(m["end"] or m["end2"]), m["rest"] if m["tag"] else m["rest2"])
            elif m[0].startswith("<![CDATA["):
                self._take(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
        self._take(page[at:])
        self._end_block()

    def _take(self, piece: str) -> None:
        if piece and not self._hidden:
            if not self._text:
                self._where = self._element
            self._text.append(piece)
            if self._links:
                self._linked += len(piece)

    def _end_block(self) -> None:
        if self._text:
            self.blocks.append((self._where, "".join(self._text), self._linked))
            self._text, self._linked = [], 0

    def _close(self, index: int) -> None:
        for tag, part, element in reversed(self._open[index:]):
            self._hidden -= part
            self._links -= tag == "a"
            self._count[tag] -= 1
            if element:
                self._element = self.parent[element]
        del self._open[index:]

    def _close_last(self, tags, stop) -> None:
        """Close the innermost open element of these tags, unless one of `stop` is in between."""
        if not any(self._count.get(t) for t in tags):
            return
        for i in range(len(self._open) - 1, -1, -1):
            tag = self._open[i][0]
            if tag in tags:
                return self._close(i)
            if tag in stop:
                return None

    def _tag(self, tag: str, end: bool, rest: str) -> None:
        block = tag in BLOCK
        if block:
            self._end_block()
        if end:
            return self._close_last((tag,), frozenset() if block else BLOCK)
        if tag in VOID:
            return self._take(" " if tag in ("br", "hr", "img", "input") else "")
        if tag in CLOSES_P:
            self._close_last(*_CLOSES["p"])
        if tag in _CLOSES and tag != "p":
            self._close_last(*_CLOSES[tag])
        inside = bool(self._count.get("article") or self._count.get("main"))
        part, maybe = _part(tag, rest, inside)
        if block or maybe:
            number = len(self.parent)
            self.parent.append(self._element)
            self.tag.append(tag)
            self.maybe.append(maybe)
            above = self.path[self._element]
            self.path.append(self.paths.setdefault((above, tag), len(self.paths) + 1) if block else above)
            self._element = number
        else:
            number = 0
        self._open.append((tag, part, number))
        self._count[tag] = self._count.get(tag, 0) + 1
        self._hidden += part
        self._links += tag == "a"
        if rest.rstrip().endswith("/") and not block and tag != "a":
            self._close(len(self._open) - 1)


def _part(tag: str, rest: str, inside: bool) -> tuple[bool, bool]:
    """Whether an element is a part to leave out, and whether it may be one; inside an article only its text can tell."""
    if tag in LEFT_OUT or tag == "header" and not inside:
        return True, False
    maybe = False
    if "=" in rest or "hidden" in rest:
        for m in _ATTRIBUTE.finditer(rest):
            name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "role" and value.lower() in PART_ROLES:
                return True, False
            if name in ("class", "id") and tag not in ("html", "body", "article", "main"):
                words = {w.lower() for w in _PARTS.split(value)}
                if words & PARTS:
                    return True, False
                maybe |= bool(words & MAYBE_PARTS)
    return False, maybe


def _smoothed(x: list[float]) -> list[float]:
    """Half of each value and a quarter of either neighbour's; the ends stand for what is beyond them."""
    return [0.25 * x[max(i - 1, 0)] + 0.5 * v + 0.25 * x[min(i + 1, len(x) - 1)] for i, v in enumerate(x)]


def main_text(page: str | None) -> str:
    """The main text of a page, its blocks joined by line feeds."""
    p = Page(page or "")
    found = []
    for element, raw, linked in p.blocks:
        text = " ".join(_html.unescape(raw).split())
        if text:
            found.append((element, text, min(linked, len(raw))))
    # sums over elements: a child's go to its parent, which has a smaller number
    n = len(p.parent)
    length, links, count = [0] * n, [0] * n, [0] * n
    for element, text, linked in found:
        length[element] += len(text)
        links[element] += linked
        count[element] += 1
    for k in range(n - 1, 0, -1):
        up = p.parent[k]
        length[up] += length[k]
        links[up] += links[k]
        count[up] += count[k]
    gone = [False] * n
    for k in range(1, n):
        gone[k] = gone[p.parent[k]] or p.maybe[k] and (links[k] >= LINKED * length[k] or length[k] < SHORT * count[k])
    found = [(e, t, l) for e, t, l in found if not gone[e]]
    if not found:
        return ""
    # ratios of the tag paths, in the order in which they come on the page
    sums: dict[int, list[float]] = {}
    for element, text, linked in found:
        own = sums.setdefault(p.path[element], [0.0, 0.0, 0.0])
        own[0] += max(0, len(text) - 2 * linked)
        own[1] += len(_PUNCTUATION.findall(text)) if 2 * linked < len(text) else 0
        own[2] += 1
    ratio = [_smoothed([s[k] / s[2] for s in sums.values()]) for k in (0, 1)]
    score = {path: (t * (1 + u)) ** 0.5 * (sums[path][0] > 0) for path, t, u in zip(sums, *ratio)}
    best = max(score.values())
    content = [0] * n
    for element, text, linked in found:
        if score[p.path[element]] >= SIMILAR * best:
            content[element] += max(1, len(text) - 2 * linked)
    held = list(content)
    for k in range(n - 1, 0, -1):
        held[p.parent[k]] += held[k]
    whole = [k for k in range(n) if p.tag[k] in ("article", "main") and held[k] >= HOLDS * held[0]]
    if whole:
        holder = whole[0] if not any(p.tag[k] == "article" for k in whole) else next(k for k in whole if p.tag[k] == "article")
    else:
        # the lowest element that holds all content; blocks short beside the typical one don't widen it
        most = max(content)
        least = held[0] - sum(c for c in content if 10 * c < most)
        holder = max(k for k in range(n) if held[k] >= least)
        while p.tag[holder] not in ("", "html", "body", "td", "div", "section"):
            holder = p.parent[holder]
    inside = [False] * n
    for k in range(n):
        inside[k] = k == holder or k > 0 and inside[p.parent[k]]
    return "\n".join(text for element, text, _ in found if inside[element])


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page (page_id, url, html)."""

    def build(batches):
        for b in batches:
            for s in range(0, b.num_rows, 256):
                part = b.slice(s, 256)
                text = [main_text(h) for h in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return input_columns(pages, "page_id", "url", "html").mapInArrow(build, "page_id long, url string, text string, n_chars long")
