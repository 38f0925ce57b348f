"""Text lines of a page, with the place in the markup where each stands."""

from __future__ import annotations

import html as entities
import re
from functools import lru_cache
from typing import NamedTuple

# Tags that do not end a line.
INLINE = frozenset("a abbr b cite code em i mark small span strong sub sup time u".split())
# Tags without content.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
# What an opening tag closes when it stands right inside.
CLOSES = {"li": {"li", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "tr": {"tr", "td", "th", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "option": {"option"}}
BLOCKS = frozenset("p div ul ol table h1 h2 h3 h4 h5 h6 blockquote section article aside nav main footer header form figure dl pre".split())

MARK = re.compile(
    r"<!--.*?(?:-->|\Z)|<!doctype[^>]*(?:>|\Z)|<(?P<raw>script|style)\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9]*)(?P<rest>(?:\s+[^>]*|/)?)(?:>|\Z)|<[?!][^>]*>",
    re.S | re.I,
)
NAMED = re.compile(r"""\b(?:id|class)\s*=\s*["']?([^"'>]+)""", re.I)
DIGITS = re.compile("[0-9]+")


class Line(NamedTuple):
    text: str
    path: tuple[str, ...]  # open elements, outermost first, as tag or tag.class
    linked: float  # share of the characters inside links
    ids: tuple[int, ...]  # number of each open element


@lru_cache(1 << 14)
def named(tag: str, attributes: str) -> str:
    """The tag with its id or class, the first of them."""
    name = NAMED.search(attributes)
    return f"{tag}.{name[1]}" if name else tag


def text_lines(page: str | None) -> list[Line]:
    """Lines of a page in document order; null and empty pages have none.

    A page that breaks off inside a comment, script, style or tag loses that piece only.
    """
    out: list[Line] = []
    if not page:
        return out
    stack: list[tuple[str, str, int]] = []
    parts: list[str] = []
    pos = inside = serial = 0
    linked = 0

    def flush() -> None:
        nonlocal linked
        raw = "".join(parts)
        text = " ".join((entities.unescape(raw) if "&" in raw else raw).split())
        if text:
            out.append(Line(text, tuple([x[1] for x in stack]), min(1.0, linked / max(1, len(raw.strip()))) if linked else 0.0, tuple([x[2] for x in stack])))
        parts.clear()
        linked = 0

    for m in MARK.finditer(page):
        at = m.start()
        if at > pos:
            piece = page[pos:at]
            parts.append(piece)
            if inside:
                linked += len(piece)
        pos = m.end()
        raw, end, tag, rest = m.groups()
        if tag is None:
            if raw:
                flush()
            continue
        tag = tag.lower()
        if tag in INLINE:
            if tag == "a":
                inside = 0 if end else 1
            continue
        if parts:
            flush()
        if end:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
        elif tag not in VOID:
            shut = CLOSES.get(tag) or ({"p"} if tag in BLOCKS else ())
            while stack and stack[-1][0] in shut:
                stack.pop()
            serial += 1
            stack.append((tag, named(tag, rest) if rest else tag, serial))
    if pos < len(page):
        parts.append(page[pos:])
        if inside:
            linked += len(page) - pos
    flush()
    return out


def line_key(text: str) -> str:
    """A line in lower case, each run of the digits 0-9 as 0."""
    return DIGITS.sub("0", text.lower())


@lru_cache(1 << 14)
def same_url(url: str) -> str:
    """Equal for addresses of one document; the same rule as functions.urls.canonical."""
    u = re.sub(r"(?s)[#?].*$", "", url)
    m = re.match(r"(?s)([A-Za-z][A-Za-z0-9+.\-]*)://([^/]*)(.*)$", u)
    if not m:
        return u
    scheme, host = m[1].lower(), m[2].lower()
    default = {"http": ":80", "https": ":443"}.get(scheme)
    if default and host.endswith(default):
        host = host[: -len(default)]
    return f"{scheme}://{host}{m[3] or '/'}"


@lru_cache(1 << 14)
def host(url: str) -> str | None:
    """Host of an address in lower case, without user and port; null where there is none."""
    m = re.match(r"(?s)[A-Za-z][A-Za-z0-9+.\-]*://([^/]*)", same_url(url))
    return re.sub(r":\d*$", "", re.sub(r"^.*@", "", m[1])) or None if m else None
