"""Leaf blocks of an HTML page with the features of each: the tags and names above it, and the shape of its text.

A small tolerant reader: one pattern finds tags and comments, a stack holds what is open. It follows what browsers do with
unclosed paragraphs, items and cells, void elements, raw text, broken comments and cut-off tags; only a quote that never closes ends at the next >,
so that no text is lost to it. A block is the text
between two block-level tags or line breaks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

_TAG = re.compile(
    r"""<!--(?:-?>|.*?(?:--!?>|\Z)) | <(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attributes>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)(?:>|\Z)
     | <(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)[^>]*+(?:>|\Z) | <[!?/][^>]*+(?:>|\Z)""",
    re.S | re.X,
)
_NAMED = re.compile(r"""(?:^|[\s"'/])(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")

# Element names of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body br button caption center col colgroup dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li listing main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
SECTION = frozenset("article aside dialog footer form header main nav section noscript".split())
_LISTS, _TABLE = frozenset(["ul", "ol", "menu", "dir"]), frozenset(["table"])
#: What a start tag closes, and within what.
_CLOSES = {
    "li": (frozenset(["li"]), _LISTS), "dd": (frozenset(["dd", "dt"]), frozenset(["dl"])), "dt": (frozenset(["dd", "dt"]), frozenset(["dl"])), "option": (frozenset(["option"]), frozenset(["select"])), "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "td": (frozenset(["td", "th"]), _TABLE), "th": (frozenset(["td", "th"]), _TABLE), "tr": (frozenset(["tr"]), _TABLE), **{t: (frozenset(["thead", "tbody", "tfoot", "caption"]), _TABLE) for t in ("thead", "tbody", "tfoot")},
}
_KEEPS_P = frozenset(["br", "button", "option", "optgroup", "select", "caption", "col", "colgroup", "tbody", "td", "tfoot", "th", "thead", "tr", "legend"])


def names(attributes: str) -> list[str]:
    """The words of class, id and role."""
    found = (w.lower() for _, value in _NAMED.findall(attributes) for w in _WORD.findall(value))
    return list(dict.fromkeys(w for w in found if len(w) > 1))


def _shape(text: str, linked: int) -> list[str]:
    n = len(text)
    share = linked / n
    return [
        f"chars:{min(11, n.bit_length())}", f"links:{0 if not linked else 1 if share < 0.3 else 2 if share < 0.8 else 3}",
        f"stop:{text[-1] in '.!?…:;'}", f"commas:{min(3, text.count(','))}", f"mark:{'©' in text or 'opyright' in text}", f"bar:{'|' in text or '»' in text or '·' in text}",
    ]


def blocks(html: str | None, known: dict[str, object] | None = None) -> Iterator[tuple[str, list[str]]]:
    """(text, features) of each leaf block that has text, in page order. With ``known``, only features among its keys are given.

    Only known names of open elements are remembered, so deep pages cost no more for each block than the model's names.
    """
    html = html or ""
    low = None
    above: dict[str, int] = {}  # features of open elements, and how many have each
    stack: list[tuple[str, list[str]]] = []
    opened: dict[str, int] = {}
    sections: list[str] = []
    parents = [""]
    text: list[str] = []
    state: tuple | None = None
    linked = 0

    def enter(tag: str, attributes: str) -> None:
        own = [f"in:{tag}", *(f"name:{w}" for w in names(attributes))] if "=" in attributes else [f"in:{tag}"]
        own = [f for f in own if known is None or f in known]
        stack.append((tag, own))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in SECTION:
            sections.append(tag)
        if tag in BLOCK:
            parents.append(tag)
        for f in own:
            above[f] = above.get(f, 0) + 1

    def leave(at: int) -> None:
        tag, own = stack.pop(at)
        opened[tag] -= 1
        if tag in SECTION:
            sections.pop()
        if tag in BLOCK:
            parents.pop()
        for f in own:
            above[f] -= 1
            if not above[f]:
                del above[f]

    def close(tags: frozenset[str], within: frozenset[str]) -> None:
        """Leave the last open one of ``tags`` and all in it, unless ``within`` starts anew inside it."""
        if not any(opened.get(t) for t in tags):
            return
        for at in range(len(stack) - 1, -1, -1):
            if stack[at][0] in tags:
                while len(stack) > at:
                    leave(-1)
                return
            if stack[at][0] in within:
                return

    def flush() -> Iterator[tuple[str, list[str]]]:
        nonlocal linked, state
        if text:
            whole = " ".join("".join(text).split())
            if whole:
                features = [*state, *_shape(whole, min(linked, len(whole)))]
                yield whole, features if known is None else [f for f in features if f in known]
            text.clear()
        linked, state = 0, None

    def read(part: str) -> None:
        nonlocal linked, state
        part = unescape(part)
        if not part.isspace():
            if state is None:
                path = list(dict.fromkeys(sections[-3:]))
                state = (*above, f"parent:{parents[-1]}", f"sections:{'>'.join(path)}", "always")
            if opened.get("a"):
                linked += len(part.strip())
        text.append(part)

    at = 0
    for m in iter(lambda: _TAG.search(html, at), None):
        if m.start() > at:
            read(html[at : m.start()])
        at = m.end()
        tag = (m["name"] or m["name2"] or "").lower()
        if not tag:
            continue
        if m["end"] or m["end2"]:
            if tag in BLOCK:
                yield from flush()
            if opened.get(tag):
                i = next(i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == tag)
                if tag in BLOCK or tag in SECTION:
                    while len(stack) > i:
                        leave(-1)
                else:
                    leave(i)
            continue
        if tag in RAW:
            low = html.lower() if low is None else low
            if len(low) != len(html):  # a letter whose small form is longer
                low = re.sub("[A-Z]", lambda c: c[0].lower(), html)
            end = low.find(f"</{tag}", at)
            at = len(html) if end < 0 else end
            continue
        if tag in BLOCK:
            yield from flush()
            if tag not in _KEEPS_P and opened.get("p"):
                close(frozenset(["p"]), frozenset(["button", "td", "th", "caption", "table"]))
            if tag in _CLOSES:
                close(*_CLOSES[tag])
        if tag not in VOID:
            enter(tag, m["attributes"] or "")
    if at < len(html):
        read(html[at:])
    yield from flush()
