"""HTML to a tree of block elements and the text in them.

A lenient reader in one pass: unclosed paragraphs and list items end where the next block begins, end tags without a start
are ignored, script, style, title and textarea are skipped whole, comments and declarations too; controls and media are skipped
up to their end tag, which must come before the block around them ends, and without one up to the next block's start or end; math
and object are text. Inline elements belong to the
block around them; a line break counts as a blank.

The reader takes time in proportion to the page, however its tags nest or are left open: tags are sought up to the last
``>`` only, open blocks are found by name, and an end that is not there is sought once.
"""

from __future__ import annotations

import re
from html import unescape

#: Element names of HTML.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 "
    "h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea head".split())
#: Controls and media.
ASIDE = frozenset("template noscript iframe select button svg audio video canvas".split())
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"},
         "th": {"tr", "table"}}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"'<]++|\"[^\"<]*+\"|'[^'<]*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>", re.S)
_HAS_ASIDE = re.compile(rf"<(?:{'|'.join(sorted(ASIDE))})[\s/>]", re.I)
_NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_PARTS = re.compile(r"[a-z]+")
_MARK = re.compile(r"\bdata-main\s*=\s*\"([01])\"")


class Tree:
    """Blocks in page order: tag, parent, words of class, id and role, hidden; runs: (block, text, characters in links).

    ``mark`` is what a labelled page says of a block in an attribute ``data-main``; features never see it.
    """

    __slots__ = ("tag", "parent", "names", "hidden", "mark", "runs")

    def __init__(self) -> None:
        self.tag, self.parent, self.names, self.hidden, self.mark = ["#root"], [-1], [()], [False], [None]
        self.runs: list[tuple[int, str, int]] = []


class _Tokens:
    """Tags of a page in order, without those in raw elements. ``tail`` is where the text after the last token ends."""

    def __init__(self, html: str) -> None:
        self.html, self.at, self.last = html, 0, html.rfind(">") + 1
        open_comment = html.find("<!--", self.last)
        self.tail = len(html) if open_comment < 0 else open_comment
        self.no_end: set[str] = set()

    def __iter__(self):
        """(start, match) of each token; ``at`` is its end, and may be moved on by the reader."""
        while m := _TOKEN.search(self.html, self.at, self.last):
            self.at = m.end()
            if m[0].startswith("<!--") and (len(m[0]) < 7 or not m[0].endswith("-->")):
                self.at = self.tail = len(self.html)  # a comment without an end
            yield m.start(), m

    def skip(self, tag: str) -> None:
        """Go on after the end tag of a raw element; without one, the rest of the page belongs to it, but for ``head``, which
        the body ends."""
        m = None
        if tag not in self.no_end:
            m = re.compile(rf"</{tag}\s*+>" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.I).search(self.html, self.at)
        if m:
            self.at = m.end()
        elif tag == "head":
            self.no_end.add(tag)
        else:
            self.at = self.tail = len(self.html)


class _Open:
    """The stack of open blocks: numbers, and for each name the places on the stack where it is."""

    def __init__(self) -> None:
        self.blocks, self.tags, self.places = [0], ["#root"], {}

    def push(self, block: int, tag: str) -> None:
        self.places.setdefault(tag, []).append(len(self.blocks))
        self.blocks.append(block)
        self.tags.append(tag)

    def cut(self, place: int) -> None:
        """Close all blocks from this place on."""
        while len(self.blocks) > place:
            self.places[self.tags.pop()].pop()
            self.blocks.pop()

    def place(self, tags) -> int:
        """The innermost place of one of these tags; 0 if none is open."""
        return max((self.places[x][-1] for x in tags if self.places.get(x)), default=0)


def _aside_ends(html: str) -> dict[int, int]:
    """Start and end of the elements of ``ASIDE`` that end inside the block around them."""
    ends: dict[int, int] = {}
    stack: list[tuple[str, int]] = []
    opened: dict[str, int] = {}
    last: dict[str, int] = {}
    tokens = _Tokens(html)
    for begin, m in tokens:
        name = m[2] or m[5]
        tag, end = (name or "").lower(), bool(m[1] or m[4])
        if tag in RAW:
            if not end and not (m[3] or m[6] or "").endswith("/"):
                tokens.skip(tag)
        elif tag in VOID or tag not in BLOCKS and tag not in ASIDE:
            continue
        elif end:
            while opened.get(tag):
                top, start = stack.pop()
                opened[top] -= 1
                if top == tag:
                    if tag in ASIDE:
                        ends[start] = tokens.at
                    break
        elif tag in BLOCKS or not (m[3] or m[6] or "").endswith("/"):
            if tag in ("button", "select") and opened.get(tag):  # these hold none of their kind: the open one has no end
                stack[last[tag]] = ("", -1)
                opened[tag], opened[""] = opened[tag] - 1, opened.get("", 0) + 1
            last[tag] = len(stack)
            stack.append((tag, begin))
            opened[tag] = opened.get(tag, 0) + 1
    return ends


def parse(html: str) -> Tree:
    t = Tree()
    stack = _Open()
    links = 0  # open links
    text: list[str] = []
    linked = 0
    aside = _aside_ends(html) if _HAS_ASIDE.search(html) else {}
    dropped = False  # after an element of ASIDE without an end, up to the next block

    def flush() -> None:
        nonlocal linked
        whole = " ".join("".join(text).split())
        if whole:
            t.runs.append((stack.blocks[-1], whole, linked))
        text.clear()
        linked = 0

    def add(piece: str) -> None:
        nonlocal linked
        piece = unescape(piece) if "&" in piece else piece
        text.append(piece)
        if links:
            linked += len(piece)

    tokens, at = _Tokens(html), 0
    for begin, m in tokens:
        if begin > at and not dropped:
            add(html[at:begin])
        at = tokens.at
        name = m[2] or m[5]
        if not name:
            continue
        tag, end = name.lower(), bool(m[1] or m[4])
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            links = 0 if end else 1
        elif tag in RAW:
            if not end and not (m[3] or m[6] or "").endswith("/"):
                tokens.skip(tag)
                at = tokens.at
        elif tag in ASIDE:
            if not end and not (m[3] or m[6] or "").endswith("/"):
                dropped = dropped or begin not in aside
                at = tokens.at = aside.get(begin, at)
        elif tag not in BLOCKS:
            continue
        elif end:
            dropped = False
            if place := stack.place((tag,)):
                flush()
                stack.cut(place)
                links = 0
        else:
            dropped = False
            flush()
            links = 0
            if tag in ("html", "body") and stack.place((tag,)):
                continue
            if tag in CLOSED_BY:
                place = stack.place(CLOSED_BY[tag])
                if place > stack.place(HOLDS[tag]):
                    stack.cut(place)
            if stack.tags[-1] == "p":
                stack.cut(len(stack.blocks) - 1)
            if tag in VOID:
                continue
            attrs = m[3] or m[6] or ""
            names: tuple[str, ...] = ()
            if attrs:
                names = tuple(p for v in _NAMES.findall(attrs) for p in _PARTS.findall("".join(v).lower()))
            mark = _MARK.search(attrs) if attrs else None
            t.tag.append(tag)
            t.parent.append(stack.blocks[-1])
            t.names.append(names)
            t.hidden.append(bool(attrs and _HIDDEN.search(attrs)))
            t.mark.append(None if mark is None else mark[1] == "1")
            stack.push(len(t.tag) - 1, tag)
    if not dropped:
        add(html[at : tokens.tail])
    flush()
    return t
