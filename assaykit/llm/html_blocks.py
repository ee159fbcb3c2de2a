"""Leaf blocks of a web page: what stands between the borders of block elements, with what surrounds it."""

from __future__ import annotations

import html
import re
from collections import Counter
from typing import NamedTuple

# Fixed values of HTML: elements that break lines, hold no markup, are not shown, have no end tag, or limit what a start tag closes.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html label legend li main menu nav noscript object ol optgroup option p pre
section select summary svg table tbody td template tfoot th thead tr ul""".split())
RAW = frozenset("iframe noembed noframes script style textarea title xmp".split())
UNSEEN = frozenset("head noscript object svg template".split())
#: A start tag closes elements of these names that stand open in the same list, table or cell.
ENDED_BY = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("tr",),
    "tbody": ("tbody", "thead", "tfoot"), "thead": ("tbody", "thead", "tfoot"), "tfoot": ("tbody", "thead", "tfoot")}
LISTS = frozenset("dl ol select ul".split())
CELLS = frozenset("caption td th".split())
HARD = CELLS | {"button", "object", "svg", "table", "template"}
ROWS = CELLS | {"table", "tbody", "tfoot", "thead", "tr"}
IN_TEXT = frozenset("button label noscript object optgroup option select svg template".split())
#: End tags that never reach beyond the list that they stand in.
LOCAL = frozenset("dd dt li option p".split())

# Words of class, id and role that say what an element is for (in the singular).
WORDS = tuple("""ad advert advertisement alert article banner blog body breadcrumb caption comment consent content cookie copyright
dialog discussion disqus entry footer form header hidden login main masthead menu modal nav navbar navigation newsletter notice page
pager pagination popup post promo promoted recommended related reply respond response review search share sharing sidebar signup social
sponsor sponsored story subscribe tag text toolbar widget""".split())
#: Surroundings of a block, each a bit: elements, then words.
TAGS = tuple("article aside blockquote button details dialog dl fieldset figure footer form header li main menu nav ol section select table ul".split())
BITS = {f"<{t}>": 1 << i for i, t in enumerate(TAGS)} | {w: 1 << len(TAGS) + i for i, w in enumerate(WORDS)}
HINTS = tuple(BITS)

TOKEN = re.compile(r"""<(?:
    !--(?:-?>|.*?(?:--!?>|\Z))
  | [!?][^>]*+(?:>|\Z)
  | /(?![a-zA-Z])[^>]*+(?:>|\Z)
  | (?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>=]++|=\s*+"[^"]*+(?:"|\Z)|=\s*+'[^']*+(?:'|\Z)|=)*+)(?:>|\Z)
)""", re.S | re.X)
ATTRIBUTE = re.compile(r"""([^\s=/"'<>]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Attributes remembered in a process; beyond that the memory is emptied.
KEPT = 50_000
_KNOWN: dict[str, int] = {}


class Block(NamedTuple):
    text: str
    tag: str
    around: int  # bits of HINTS
    linked: int  # characters within links


def hints(attributes: str) -> int:
    """Bits of the words in class, id and role, and of hidden elements."""
    known = _KNOWN.get(attributes)
    if known is not None:
        return known
    bits = 0
    for name, *values in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), values[0] or values[1] or values[2]
        if name in ("class", "id", "role"):
            for word in PARTS.findall(value):
                word = word.lower()
                bits |= BITS.get(word) or BITS.get(word.removesuffix("s"), 0)
        elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or \
                name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            bits |= BITS["hidden"]
    if len(_KNOWN) >= KEPT:
        _KNOWN.clear()
    if len(attributes) < 500:
        _KNOWN[attributes] = bits
    return bits


class Page:
    """Reads a page once, in time proportional to its length.

    Inline elements do not part blocks. ``br`` is white space. A start tag closes what HTML lets it close (a paragraph, an item, a
    cell); an end tag closes everything opened since its start tag, but does not reach out of a cell; one without start tag is
    ignored. ``near`` counts what is open since the last list, table or cell began, ``frame`` since the last table or cell.
    """

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.stack: list[tuple[str, int, Counter, Counter, bool]] = []  # an element and what held before it
        self.around, self.near, self.frame, self.hard = 0, Counter(), Counter(), []
        self.in_link, self.unseen, self.pieces, self.linked = False, 0, [], 0
        at = 0
        while m := TOKEN.search(source, at):
            self.text(source[at:m.start()])
            at = m.end()
            if m["name"]:
                name = m["name"].lower()
                if m["end"]:
                    self.end(name)
                    continue
                self.start(name, m["rest"])
                if name in RAW:
                    close = CLOSING[name].search(source, at)
                    at = close.start() if close else len(source)
        self.text(source[at:])
        self.border()

    def text(self, piece: str) -> None:
        if piece and not self.unseen:
            piece = html.unescape(piece) if "&" in piece else piece
            self.linked += len(piece) if self.in_link else 0
            self.pieces.append(piece)

    def border(self) -> None:
        if self.pieces:
            text = " ".join("".join(self.pieces).split())
            if text:
                self.blocks.append(Block(text, self.stack[-1][0] if self.stack else "body", self.around, self.linked))
            self.pieces, self.linked = [], 0

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text(" ")
        elif name == "a":
            self.in_link = True
        elif name in BLOCKS:
            self.border()
            if name in ROWS - {"table"} and self.hard and self.hard[-1] in CELLS:
                self.close(self.hard[-1])
            if self.near["p"] and name not in IN_TEXT:
                self.close("p")
            for other in ENDED_BY.get(name, ()):
                if self.near[other]:
                    self.close(other)
            if name != "hr":
                self.push(name, attributes)

    def push(self, name: str, attributes: str) -> None:
        self.stack.append((name, self.around, self.near, self.frame, self.in_link))
        self.near[name] += 1
        if self.frame is not self.near:
            self.frame[name] += 1
        if name in HARD:
            self.near = self.frame = Counter()
            self.hard.append(name)
        elif name in LISTS:
            self.near = Counter()
        self.around |= BITS.get(f"<{name}>", 0)
        if attributes and name not in ("html", "body"):
            self.around |= hints(attributes)
        self.unseen += name in UNSEEN

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = False
        elif name in BLOCKS:
            self.border()
            if name in ROWS and self.hard and self.hard[-1] in CELLS - {name}:
                self.close(self.hard[-1])
            open_here = self.near if name in LOCAL else self.frame
            if open_here[name] or self.hard and self.hard[-1] == name:
                self.close(name)

    def close(self, name: str) -> None:
        """Close the last element of that name and all within it."""
        while self.stack:
            tag, self.around, self.near, self.frame, self.in_link = self.stack.pop()
            self.near[tag] -= 1
            if self.frame is not self.near:
                self.frame[tag] -= 1
            if tag in HARD:
                self.hard.pop()
            self.unseen -= tag in UNSEEN
            if tag == name:
                return


CLOSING = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
