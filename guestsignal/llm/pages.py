"""From HTML to leaf blocks: text between block tags, with its ancestors."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_NAMED = re.compile(r"""(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
#: Elements without text of their own for a reader.
SILENT = frozenset("script style noscript template head title svg iframe object select datalist".split())
#: Of these, the ones in which no tag counts until their own end tag.
RAW = frozenset("script style title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button caption center dd details dialog dir div dl dt "
    "fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main "
    "menu nav ol optgroup option p pre section summary table tbody td textarea tfoot th thead tr "
    "ul".split()
)
#: An element that is open ends when one of these starts.
_ENDS = {
    "p": frozenset(BLOCK - {"button", "body", "html"}), "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]), "dd": frozenset(["dt", "dd"]),
    "td": frozenset(["td", "th", "tr"]), "th": frozenset(["td", "th", "tr"]), "tr": frozenset(["tr"]),
    "option": frozenset(["option", "optgroup"]),
}


#: What can stand in a head; text and any other start tag end an open one.
_IN_HEAD = frozenset("base basefont bgsound head link meta noframes noscript script style template title".split())


@dataclass
class Block:
    text: str
    #: (tag, words of class, id and role) from the outermost element on
    path: tuple[tuple[str, tuple[str, ...]], ...]
    #: characters inside links
    linked: int


def names_of(attributes: str) -> tuple[str, ...]:
    found = " ".join(value.strip("\"'") for value in _NAMED.findall(attributes))
    return tuple(re.findall(r"[a-z]+", found.lower()))


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order; texts have their character references decoded and
    runs of white space as one space. Damaged markup is taken as far as it goes."""
    out: list[Block] = []
    stack: list[tuple[str, tuple[str, ...]]] = []
    parts: list[str] = []
    linked = silent = 0
    in_link = False
    at, size = 0, len(page)

    def flush() -> None:
        nonlocal parts, linked
        if parts:
            text = _SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
            if text:
                out.append(Block(text, tuple(stack), linked))
        parts, linked = [], 0

    def end_head() -> None:
        nonlocal silent
        while stack and stack[-1][0] == "head":
            stack.pop()
            silent -= 1

    while at < size:
        begin = page.find("<", at)
        match = None
        while begin >= 0 and (match := _TAG.match(page, begin)) is None:
            begin = page.find("<", begin + 1)
        text = page[at : begin if match else size]
        if silent and text.strip(" \t\n\f\r"):
            end_head()
        if text and not silent:
            parts.append(text)
            if in_link:
                linked += len(text)
        if not match:
            break
        at = match.end()
        tag = (match[2] or match[5] or "").lower()
        if not tag:
            continue
        if match[1] or match[4]:
            if tag == "a":
                in_link = False
            if tag in BLOCK:
                flush()
            if any(name == tag for name, _ in stack):
                while stack:
                    gone = stack.pop()[0]
                    silent -= gone in SILENT
                    if gone == tag:
                        break
            continue
        in_head = bool(stack) and stack[-1][0] == "head"
        if in_head and tag not in _IN_HEAD:
            end_head()
        if tag == "br":
            parts.append(" ")
        if tag == "a":
            in_link = True
        if tag in BLOCK:
            flush()
            while stack and tag in _ENDS.get(stack[-1][0], ()):
                stack.pop()
        attributes = match[3] if match[2] else match[6]
        if tag in VOID or (attributes or "").endswith("/"):
            continue
        if tag in RAW or tag == "noframes" and in_head:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            at = end.start() if end else size
            closing = page.find(">", at)
            at = size if closing < 0 else closing + 1
            continue
        if tag in SILENT:
            flush()
            silent += 1
            stack.append((tag, ()))
        elif tag in BLOCK:
            stack.append((tag, names_of(attributes)))
    flush()
    return out
