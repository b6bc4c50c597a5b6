"""Leaf blocks of HTML pages: visible text in page order with the path of open elements."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass
from zlib import crc32

#: Fixed values of HTML: elements by the role they have here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW_TEXT = frozenset("script style title textarea iframe noembed noframes xmp".split())
HIDDEN = frozenset("noscript template svg object select button datalist audio video canvas annotation annotation-xml".split())
BLOCK = frozenset((
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html label legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul").split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "label", "legend", "body", "html", "head"}
#: A start tag ends an open element of its own kind, as far as one of the listed parents.
ENDS_SAME = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
}
KEEPS_P = frozenset("td th table button article section div main aside li blockquote".split())

_TOKEN = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)|[^<]++|<""",
    re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
#: A slash that ends an unquoted value belongs to the value.
_SELF_CLOSED = re.compile(r"""(?:^|[\s"'])/\s*$""")
_NAME_PART = re.compile(r"[a-z]+")

PATH_SLOTS = 2048


@dataclass(slots=True)
class Leaf:
    text: str
    path: tuple[int, ...]
    link_chars: int


def slot(token: str) -> int:
    return crc32(token.encode()) % PATH_SLOTS


_slots: dict[str, int] = {}


def _known_slot(token: str) -> int:
    found = _slots.get(token)
    if found is None:
        if len(_slots) > 50_000:
            _slots.clear()
        found = _slots[token] = slot(token)
    return found


def _own_tokens(tag: str, attributes: str) -> tuple[int, ...]:
    out = [_known_slot("tag " + tag)]
    if attributes:
        for kind, *values in _ATTRIBUTE.findall(attributes):
            out.extend(_known_slot("name " + part) for part in _NAME_PART.findall("".join(values).lower()))
    return tuple(out)


def leaves(page: str | None) -> list[Leaf]:
    """Leaf blocks of a page in order; empty blocks and hidden elements give none.

    Character references are decoded, white space inside a block becomes one space and outer
    white space goes. Unclosed and misnested elements end where HTML says they do, or at the
    end of the page. Raw text (scripts, styles and their like) runs to its own end tag, whatever
    its start tag ends in; other hidden elements also end with an element around them. Formulas
    are text.
    """
    if not page:
        return []
    out: list[Leaf] = []
    stack: list[tuple[str, tuple[int, ...], bool, bool]] = [("", (), False, False)]
    buffer: list[str] = []
    start_path: tuple[int, ...] = ()
    link_chars = 0

    def flush():
        nonlocal link_chars
        if buffer:
            text = "".join(buffer)
            text = " ".join((html.unescape(text) if "&" in text else text).split())
            if text:
                out.append(Leaf(text, start_path, min(link_chars, len(text))))
            buffer.clear()
        link_chars = 0

    def close(tags, scope):
        for k in range(len(stack) - 1, 0, -1):
            name = stack[k][0]
            if name in tags:
                del stack[k:]
                return
            if name in scope:
                return

    at, n, match = 0, len(page), _TOKEN.match
    while at < n:
        token = match(page, at)
        at = token.end()
        tag = token[2] or token[5]
        if not tag:
            text = token[0]
            if text[:2] in ("<!", "<?") or stack[-1][3]:
                continue
            if not buffer:
                if text.isspace():
                    continue
                start_path = stack[-1][1]
            buffer.append(text)
            if stack[-1][2]:
                link_chars += len(text)
            continue
        tag = tag.lower()
        closing, attributes = token[1] or token[4], token[3] or token[6] or ""
        if tag in BLOCK:
            flush()
        elif tag == "br":
            if buffer:
                buffer.append(" ")
            continue
        if closing:
            if any(frame[0] == tag for frame in stack):
                while stack.pop()[0] != tag:
                    pass
            continue
        if tag in RAW_TEXT:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P:
            close(("p",), KEEPS_P)
        if tag in ENDS_SAME:
            close(*ENDS_SAME[tag])
        if tag not in BLOCK and attributes.endswith("/") and _SELF_CLOSED.search(attributes):
            continue
        parent = stack[-1]
        stack.append((tag, parent[1] + _own_tokens(tag, attributes) if tag in BLOCK else parent[1], parent[2] or tag == "a", parent[3] or tag in HIDDEN))
    flush()
    return out
