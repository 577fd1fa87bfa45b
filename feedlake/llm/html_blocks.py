"""A page as the sequence of its text blocks, each with the elements it lies in."""

from __future__ import annotations

import re
import zlib
from html import unescape

# Element names of HTML with their roles.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big canvas cite code data del dfn em font i img ins kbd label mark nobr noscript object q rp rt ruby s samp small span strike strong sub sup time tt u var wbr"
    " math mfrac mi mn mo mover mpadded mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder munderover semantics".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
UNREAD = frozenset("button iframe script select style svg template textarea".split())
RAW = frozenset(("script", "style"))
# an element of this name ends open ones of these names
ENDS = {
    "p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",),
    **{t: ("p",) for t in "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split()},
}
# ... but not across these
LIMITS = frozenset("article aside body div dl footer form header main nav ol section table ul".split())

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.DOTALL,
)
_NAMES = re.compile(r"""(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))|\b(hidden)\b""", re.IGNORECASE)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_END = {name: re.compile(rf"</{name}\b", re.IGNORECASE) for name in RAW}

PATH_BINS = 256


def bin_of(token: str) -> int:
    return zlib.crc32(token.encode()) % PATH_BINS


class Block:
    """A text without markup: its white space is single blanks, its references are decoded.

    ``path`` has a bit for each bin of the elements it lies in, ``linked`` counts the characters inside links.
    """

    __slots__ = ("text", "path", "linked")

    def __init__(self, text: str, path: int, linked: int):
        self.text, self.path, self.linked = text, path, linked


def _own_bits(name: str, attributes: str) -> int:
    tokens = [name]
    if attributes:
        for m in _NAMES.finditer(attributes):
            value = m[5] or m[2] or m[3] or m[4] or ""
            tokens += ["." + w.lower() for w in _WORD.findall(value)]
    bits = 0
    for t in tokens:
        bits |= 1 << bin_of(t)
    return bits


def blocks(html: str | None) -> list[Block]:
    """The text blocks of a page in its order.

    Blocks end where an element begins or ends that is neither inline nor unread. Badly nested and cut-off pages are read as far as they go; elements
    in ``UNREAD``, comments and markup have no text.
    """
    if not html:
        return []
    out: list[Block] = []
    # open elements: name, bins of the path down to it, whether its text is read, whether it is a link; of one size, however deep
    stack: list[tuple[str, int, bool, bool]] = [("", 0, True, False)]
    pieces: list[str] = []
    where, linked = stack[0], 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                out.append(Block(text, where[1], linked))
            pieces, linked = [], 0

    def read(text: str) -> None:
        nonlocal where, linked
        if text and stack[-1][2]:
            if not pieces:
                if text.isspace():
                    return
                where = stack[-1]
            decoded = unescape(text) if "&" in text else text
            pieces.append(decoded)
            if stack[-1][3]:
                linked += len(decoded)

    at, size = 0, len(html)
    while at < size:
        m = _TOKEN.search(html, at)
        if not m:
            read(html[at:])
            break
        if m.start() > at:
            read(html[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        closing = m[1] or m[4]
        if name == "br":
            read(" ") if not pieces else pieces.append(" ")
            continue
        if name not in INLINE and name not in UNREAD:
            flush()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
                if name in INLINE and stack[k][0] in LIMITS:
                    break
            continue
        if name == "body":
            stack = [s for s in stack if s[0] != "head"]
        for k in range(len(stack) - 1, 0, -1):
            if stack[k][0] in ENDS.get(name, ()):
                del stack[k:]
                break
            if stack[k][0] in LIMITS and name not in ("tr", "td", "th") or stack[k][0] == "table":
                break
        attributes = m[3] or m[6] or ""
        if name in VOID or attributes.endswith("/"):
            continue
        if name in RAW:
            end = _END[name].search(html, at)
            at = end.start() if end else size
            continue
        above = stack[-1]
        stack.append((name, above[1] | _own_bits(name, attributes), above[2] and name not in UNREAD, above[3] or name == "a"))
    flush()
    return out
