"""Visible text of captured pages as blocks, in one pass over the tags."""

from __future__ import annotations

import html as _html
import re

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>|<(script|style|noscript|template|svg|iframe|textarea|select|head)\b[^>]*>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][a-zA-Z0-9]*)[^>]*>|([^<]+)|<",
    re.S | re.I,
)
# Tags that end a block; tags that hold blocks; tags that tell what they hold.
BREAKS = frozenset("p div ul ol dl table tr td th article section aside nav header footer main h1 h2 h3 h4 h5 h6 br hr blockquote pre body form figure dt dd".split())
HOLDERS = frozenset("div td th ul ol article section aside nav header footer main body form table".split())
FURNITURE_TAGS = frozenset(("nav", "aside", "footer"))
MAIN_TAGS = frozenset(("article", "main"))
_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)


class Block:
    """A stretch of visible text: its share of link text, the innermost holder's number, and what its ancestors tell."""

    __slots__ = ("text", "links", "holder", "tag", "told")

    def __init__(self, text: str, links: int, holder: int, tag: str, told: int):
        self.text, self.links, self.holder, self.tag, self.told = text, links, holder, tag, told


def title(html: str) -> str:
    m = _TITLE.search(html)
    return _html.unescape(m.group(1)).strip() if m else ""


def blocks(html: str) -> list[Block]:
    """Blocks in document order. told: 1 inside nav, aside or footer, 2 inside article or main, else 0."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = [("body", 0, 0)]
    holders, text, links, in_link, tag = 0, [], 0, 0, ""

    def flush() -> None:
        nonlocal text, links
        t = "".join(text)
        if "&" in t:
            t = _html.unescape(t)
        if t.strip():
            out.append(Block(t, links, stack[-1][1], tag, stack[-1][2]))
        text, links = [], 0

    # a list of all tokens takes less time, but many times the room of a page
    for _, close, name, t in _TOKEN.findall(html) if len(html) < 1 << 20 else (m.groups("") for m in _TOKEN.finditer(html)):
        if t:
            text.append(t)
            if in_link:
                links += len(t)
            continue
        if not name:
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if close else 1
            continue
        if name in BREAKS:
            if text:
                flush()
            if not close:
                tag = name
            if name in HOLDERS:
                if close:
                    for i in range(len(stack) - 1, 0, -1):
                        if stack[i][0] == name:
                            del stack[i:]
                            break
                    tag = ""
                else:
                    holders += 1
                    told = 1 if name in FURNITURE_TAGS else 2 if name in MAIN_TAGS else stack[-1][2]
                    stack.append((name, holders, told))
            elif close:
                tag = ""
        elif name == "li":
            text.append(" ")
    if text:
        flush()
    return out
