"""Elements nested in others of their kind, rewritten so that patterns can convert them.

Tags of a kind are paired by a stack; only pairs lying in a closed pair of the kind
are touched, so that a page with elements left open stays as it is.
"""

from __future__ import annotations

import re

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)[^>]*>")
KINDS = {"b": "strong", "strong": "strong", "i": "em", "em": "em", "table": "table", "ol": "list", "ul": "list"}
START = re.compile(r"""(?i)\sstart\s*=\s*["']?(-?\d{1,9})""")
CELLS = {"table", "thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup", "col"}
#: Around the number of an ordered item; private characters of a page are written as references before.
NUMBER_OPEN, NUMBER_CLOSE = "\ue00f", "\ue010"


class Pair:
    """An element of a kind, from its opening tag to its closing one, and the one of its kind that it lies in."""

    def __init__(self, name: str, opening: re.Match):
        self.name, self.opening, self.closing, self.outer = name, opening, None, None


def pairs(tags: list[re.Match]) -> list[Pair]:
    """Closed elements of all kinds, in order of their opening tags."""
    open_: dict[str, list[Pair]] = {}
    found: list[Pair] = []
    for tag in tags:
        name = tag[2].lower()
        kind = KINDS.get(name)
        if kind is None:
            continue
        stack = open_.setdefault(kind, [])
        if not tag[1]:
            stack.append(Pair(name, tag))
            found.append(stack[-1])
            continue
        places = [place for place, one in enumerate(stack) if one.name == name]
        if places:
            stack[places[-1]].closing = tag
            del stack[places[-1] :]
    found = [one for one in found if one.closing]
    for kind in set(KINDS.values()):
        within: list[Pair] = []
        for one in found:
            if KINDS[one.name] == kind:
                while within and within[-1].closing.start() < one.opening.start():
                    within.pop()
                one.outer = within[-1] if within else None
                within.append(one)
    return found


def unnested(html: str) -> str:
    """The page with nested emphasis and nested tables left as their text, and nested ordered lists numbered.

    Ordered lists that lie in lists, or hold some, become unordered ones whose items
    begin with their number between private characters.
    """
    tags = list(TAG.finditer(html))
    closed = pairs(tags)
    inner = [one for one in closed if one.outer]
    if not inner:
        return html
    edits: dict[int, tuple[int, str]] = {}

    def put(tag: re.Match, text: str) -> None:
        edits[tag.start()] = (tag.end(), text)

    for one in inner:
        if KINDS[one.name] in ("strong", "em"):
            put(one.opening, "")
            put(one.closing, "")
    tables = [one for one in inner if one.name == "table"]
    for tag in tags:
        if tag[2].lower() in CELLS and any(t.opening.start() <= tag.start() <= t.closing.start() for t in tables):
            put(tag, " ")
    for tag, text in _numbered([one for one in closed if KINDS[one.name] == "list"], tags):
        put(tag, text)
    out, at = [], 0
    for start in sorted(edits):
        out += [html[at:start], edits[start][1]]
        at = edits[start][0]
    return "".join([*out, html[at:]])


def _numbered(lists: list[Pair], tags: list[re.Match]) -> list[tuple[re.Match, str]]:
    """New tags for ordered lists among nested ones."""

    def top(one: Pair) -> Pair:
        while one.outer:
            one = one.outer
        return one

    nested = {id(top(one)) for one in lists if one.outer}
    ordered = [one for one in lists if id(top(one)) in nested]
    if not any(one.name == "ol" for one in ordered):
        return []
    new: list[tuple[re.Match, str]] = []
    number: dict[int, int] = {}
    starts = {one.opening.start(): one for one in ordered}
    ends = {one.closing.start(): one for one in ordered}
    open_: list[Pair] = []
    for tag in tags:
        if tag.start() in starts:
            one = starts[tag.start()]
            open_.append(one)
            if one.name == "ol":
                first = START.search(tag[0])
                number[id(one)] = int(first[1]) if first else 1
                new.append((tag, "<ul>"))
        elif tag.start() in ends:
            one = ends[tag.start()]
            del open_[open_.index(one) :]
            if one.name == "ol":
                new.append((tag, "</ul>"))
        elif tag[2].lower() == "li" and not tag[1] and open_ and open_[-1].name == "ol":
            here = id(open_[-1])
            new.append((tag, f"<li>{NUMBER_OPEN}{number[here]}{NUMBER_CLOSE}"))
            number[here] += 1
    return new
