"""Leaf blocks of a page: runs of text between block-level tags, with their ancestors."""

from __future__ import annotations

import html
import re
from typing import NamedTuple

BLOCK_TAGS = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav noscript ol optgroup option p "
    "pre search section summary table tbody td tfoot th thead tr ul caption head select button label textarea".split()
)
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
RAW_TAGS = frozenset("script style title template svg math iframe object noframes canvas audio video".split())
#: Those of them that hold the rest of the page if they are not closed; of others only the tag is left out.
UNREADABLE = frozenset("script style title iframe noframes".split())
#: Elements that a begin tag of the same set ends, up to the nearest of the bounds.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "body": ({"head"}, set()),
}
_P_BOUNDS = frozenset("button table td th caption object".split())
_TAG = re.compile(
    r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<rest2>[^>]*+)>",
    re.S,
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
_MARK = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


class Block(NamedTuple):
    text: str
    #: Ancestors from the outside: (tag, marks of its class, id and role).
    path: tuple[tuple[str, tuple[str, ...]], ...]
    #: Characters inside links.
    linked: int


def marks(rest: str) -> tuple[str, ...]:
    """Words of the class, id and role of a tag."""
    if "=" not in rest:
        return ()
    found = []
    for name, a, b, c in _ATTRIBUTE.findall(rest):
        if name.lower() in ("class", "id", "role"):
            found += _MARK.findall(_CAMEL.sub(r"\1 \2", html.unescape(a or b or c)).lower())
    return tuple(dict.fromkeys(found))


def clean(raw: str) -> str:
    return " ".join(html.unescape(raw).split())


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, those without text left out."""
    stack: list[tuple[str, tuple[str, ...]]] = []
    out: list[Block] = []
    parts: list[str] = []
    linked = links = at = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = clean("".join(parts))
            if text:
                out.append(Block(text, tuple(x for x in stack if x[0] in BLOCK_TAGS or x[1]), min(linked, len(text))))
            parts.clear()
        linked = 0

    def text_to(end: int) -> None:
        nonlocal linked
        if end > at:
            parts.append(page[at:end])
            if links:
                linked += end - at

    def pop_to(k: int) -> None:
        nonlocal links
        links -= sum(x[0] == "a" for x in stack[k:])
        del stack[k:]

    def close(tags, bounds) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in tags:
                pop_to(k)
                return
            if stack[k][0] in bounds:
                return

    while m := _TAG.search(page, at):
        text_to(m.start())
        at = m.end()
        name = m["name"] or m["name2"]
        if not name:
            continue
        name, ends, rest = name.lower(), bool(m["end"] or m["end2"]), m["rest"] or m["rest2"] or ""
        if name == "br":
            parts.append(" ")
            continue
        block = name in BLOCK_TAGS
        if block:
            flush()
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
                if not block and stack[k][0] in BLOCK_TAGS and name != "a":
                    break  # an inline end tag closes nothing outside its block
            continue
        if name in RAW_TAGS:
            if not rest.endswith("/"):
                stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
                at = stop.end() if stop else len(page) if name in UNREADABLE else at
            continue
        if block:
            if name in _CLOSES:
                close(*_CLOSES[name])
            if name not in ("option", "optgroup", "label", "button", "select", "textarea"):
                close({"p"}, _P_BOUNDS)
        if name in VOID_TAGS:
            continue
        if name == "a":
            close({"a"}, BLOCK_TAGS)
            links += 1
        stack.append((name, marks(rest)))
    text_to(len(page))
    flush()
    return out
