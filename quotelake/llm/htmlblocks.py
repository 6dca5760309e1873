"""Leaf blocks of a page: the text between block-level tags, with the tags and names above it."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

# Elements of the HTML standard that flow inside a line, that are void, and whose content is no text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style template noscript svg math object iframe canvas".split())
#: Of these, the ones that a "/" before the end of the start tag closes at once, and the ones that may hold their like.
FOREIGN = frozenset(("svg", "math"))
NESTING = frozenset("svg math object template canvas".split())
#: Elements that say little about the region they stand in.
PLAIN = frozenset("html body div p ul ol li h1 h2 h3 h4 h5 h6 blockquote pre table tbody tr td th dl dt dd".split())
#: What a start tag closes: an open element of the same kind, as far as the nearest container.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"),
          "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}

#: Elements whose content is text without tags.
WHOLE = frozenset(("title", "textarea"))

_NAME = re.compile(r"[a-z]+")
_MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^<>])*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^<>]*\Z", re.S)
_CLOSING = {tag: re.compile(rf"</{tag}(?=[\s/>])", re.I) for tag in SILENT | WHOLE}
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")


def _closed(attrs: str) -> bool:
    """Whether the start tag ends in a "/" of its own, not in that of an unquoted value."""
    if not attrs.endswith("/"):
        return False
    last = None
    for last in _ATTRIBUTE.finditer(attrs):
        pass
    return last is None or not last[5] or last.end() < len(attrs)


def _skip(html: str, tag: str, at: int) -> int:
    """Where the closing tag of a silent element begins whose content begins at `at`; the page's end if it has none.

    Elements of the same name inside are counted. If some of them are never closed, the last closing tag ends all.
    """
    if tag not in NESTING:
        close = _CLOSING[tag].search(html, at)
        return close.start() if close else len(html)
    depth, stop = 1, len(html)
    while m := _MARK.search(html, at):
        at = m.end()
        name = (m[2] or "").lower()
        if name == tag:
            if m[1]:
                depth, stop = depth - 1, m.start()
                if not depth:
                    return stop
            elif tag not in FOREIGN or not _closed(m[3]):
                depth += 1
        elif name in _CLOSING and name not in NESTING and not m[1]:  # its content is no tags
            close = _CLOSING[name].search(html, at)
            at = close.start() if close else at
    return stop


@dataclass
class Block:
    """Ancestor tags and the words in their names, the same of the nearest ancestor that tells a region, and the text."""

    tags: tuple[str, ...]
    names: tuple[str, ...]
    near: tuple[str, ...]
    text: str
    linked: int


@dataclass
class Page:
    blocks: list[Block] = field(default_factory=list)
    links: list[tuple[str, str]] = field(default_factory=list)
    title: str = ""


class _Reader:
    def __init__(self) -> None:
        self.page = Page()
        self.open: list[tuple[str, tuple[str, ...]]] = []
        self.above: tuple | None = None  # what a block takes from the open elements, until they change
        self.text: list[str] = []
        self.linked = self.in_link = 0

    def read(self, html: str) -> None:
        at = 0
        while m := _MARK.search(html, at):
            if m.start() > at:
                self.data(html[at:m.start()])
            at = m.end()
            name = m[2]
            if name is None:  # comment, declaration or the rest of a tag that never ends
                continue
            tag = name.lower()
            if m[1]:
                self.end(tag)
                continue
            self.start(tag, m[3])
            if (tag in SILENT or tag in WHOLE) and not (tag in FOREIGN and _closed(m[3])):
                stop = _skip(html, tag, at)
                if tag in WHOLE:
                    self.data(html[at:stop])
                at = stop
        self.data(html[at:])
        self.flush()

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            if self.above is None:
                region = next(((t, *n) for t, n in reversed(self.open) if n or t not in PLAIN and t[:2] != "x-"), ())
                self.above = tuple(t for t, _ in self.open), tuple(n for _, names in self.open for n in names), region
            tags, names, region = self.above
            self.page.blocks.append(Block(tags, names, region, text, self.linked))
            if tags and tags[-1] == "title" and not self.page.title:
                self.page.title = text
        self.text, self.linked = [], 0

    def start(self, tag: str, attrs: str) -> None:
        values = {}
        if attrs:
            for name, _, double, single, bare in _ATTRIBUTE.findall(attrs):
                value = double or single or bare
                values.setdefault(name.lower(), unescape(value) if "&" in value else value)
            link = values.get("href") or values.get("src")
            if link:
                self.page.links.append((tag, link))
        if tag in SILENT:
            return
        if tag == "a":
            self.in_link += 1
        if tag in INLINE:
            return
        if tag == "br":
            self.text.append(" ")
            return
        if self.text:
            self.flush()
        self.in_link = 0
        if tag in VOID:
            return
        if self.open and self.open[-1][0] == "p":
            self.open.pop()
            self.above = None
        if tag in CLOSES:
            kinds, walls = CLOSES[tag]
            for kind in kinds.split():
                self._close(kind, walls.split())
        names = _NAME.findall(" ".join(values.get(k, "") for k in ("class", "id", "role", "aria-label")).lower()) if values else ()
        self.open.append((tag, tuple(names)))
        self.above = None

    def end(self, tag: str) -> None:
        if tag in SILENT:
            return
        if tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag in INLINE:
            return
        if self.text:
            self.flush()
        if self.open and self.open[-1][0] == tag:
            self.open.pop()
            self.above = None
        else:
            self._close(tag, ())

    def _close(self, tag: str, walls) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                self.above = None
                return
            if self.open[i][0] in walls or (tag == "p" and self.open[i][0] != "p"):
                return

    def data(self, text: str) -> None:
        if "&" in text:
            text = unescape(text)
        self.text.append(text)
        if self.in_link:
            self.linked += len(text)


def read_page(html: str | None) -> Page:
    """Blocks in page order, outgoing links and the title; broken markup is read as far as it goes."""
    reader = _Reader()
    reader.read(html or "")
    return reader.page
