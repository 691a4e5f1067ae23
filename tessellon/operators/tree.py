"""A syntax tree without a grammar for each language.

Brackets nest; statements end at their marks (a semicolon, a closed block, or a line's end where the
language ends them so); names with arguments are calls, chains of names are members, and a statement
with an assignment holds its two sides. That is as much structure as templates need: which parts of a
file are statements, how deep each is, and where it stands. Strings are leaves, comments are left out. Text
that does not nest still gives a tree: a bracket without its partner closes nothing.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from tessellon.languages import Language

OPEN, CLOSE = {"(": "arguments", "[": "index", "{": "block"}, {")": "arguments", "]": "index", "}": "block"}
_JOINS, _SETS = (".", "->", "?.", "::"), ("=", ":=", "+=", "-=", "*=", "/=", "??=")
#: A block that these follow is not the end of its statement.
_GOES_ON = re.compile(r"\s*(?:else|catch|finally|while|[;,).\[(])")
_CONTINUES = re.compile(r"(?:[-+*/%&|^=<,.?({\[\\]|&&|\|\||\b(?:and|or|not|in|return))\s*$")


@dataclass
class Node:
    kind: str
    start: int
    end: int
    children: list[Node] = field(default_factory=list)

    def depth(self) -> int:
        """Steps to the deepest leaf."""
        most, open_ = 0, [(self, 0)]
        while open_:
            node, d = open_.pop()
            most = max(most, d)
            open_ += [(c, d + 1) for c in node.children]
        return most

    def walk(self):
        """This node and all under it, from left to right."""
        open_ = [self]
        while open_:
            node = open_.pop()
            yield node
            open_ += reversed(node.children)


@lru_cache(32)
def _tokens(language: Language) -> re.Pattern:
    some = lambda patterns: "|".join(f"(?:{p})" for p in patterns) or r"(?!)"
    return re.compile(rf"(?P<string>{some(language.strings)})|(?P<comment>{some(language.comments)})|(?P<name>{language.ident})|(?P<line>\n)|(?P<mark>->|\?\.|::|:=|[-+*/]=|\?\?=|[=!<>]=|=>|[^\s\w])|(?P<other>\w+)", re.S)


def parse(text: str, language: Language) -> Node:
    root = Node("file", 0, len(text))
    stack: list[tuple[Node, list[Node]]] = [(root, [])]  # an open node, and the items of its statement

    def finish(end_line: bool = False) -> None:
        node, items = stack[-1]
        if items and node.kind in ("file", "block"):
            if end_line and _CONTINUES.search(text, max(items[0].start, items[-1].start - 8), items[-1].end):
                return
            node.children.append(Node("statement", items[0].start, items[-1].end, _folded(items, text)))
            items.clear()

    for m in _tokens(language).finditer(text):
        kind, (start, end) = m.lastgroup, m.span()
        if kind == "comment":
            continue
        if kind == "line":
            if not language.type_first:
                finish(end_line=True)
        elif kind == "mark" and m[0] in OPEN:
            stack.append((Node(OPEN[m[0]], start, end), []))
        elif kind == "mark" and m[0] in CLOSE:
            if len(stack) == 1 or stack[-1][0].kind != CLOSE[m[0]]:
                continue
            finish()
            node, items = stack.pop()
            node.end = end
            if items:
                node.children = _folded(items, text)
            stack[-1][1].append(node)
            if node.kind == "block" and language.type_first and not _GOES_ON.match(text, end):
                finish()
        elif kind == "mark" and m[0] == ";":
            if stack[-1][1]:
                stack[-1][1].append(Node("end", start, end))
            finish()
        else:
            stack[-1][1].append(Node({"name": "identifier", "string": "string"}.get(kind, "token"), start, end))
    while len(stack) > 1:  # brackets that nothing closes
        finish()
        node, items = stack.pop()
        node.end = len(text)
        node.children = node.children or _folded(items, text)
        stack[-1][1].append(node)
    finish()
    return root


def _folded(items: list[Node], text: str) -> list[Node]:
    """Items with calls, members and assignments as nodes of their own."""
    out: list[Node] = []
    i = 0
    while i < len(items):
        node, j = items[i], i + 1
        if node.kind == "identifier":
            while j < len(items):
                nxt = items[j]
                if nxt.kind in ("arguments", "index") and nxt.start - node.end <= 1:
                    node, j = Node("call", node.start, nxt.end, [node, nxt]), j + 1
                elif text[nxt.start : nxt.end] in _JOINS and j + 1 < len(items) and items[j + 1].kind == "identifier":
                    node, j = Node("member", node.start, items[j + 1].end, [node, items[j + 1]]), j + 2
                else:
                    break
        out.append(node)
        i = j
    at = next((k for k, n in enumerate(out) if n.kind == "token" and text[n.start : n.end] in _SETS), None)
    if at:
        stop = len(out) - (out[-1].kind == "end")
        if at + 1 < stop:
            return [Node("assignment", out[0].start, out[stop - 1].end, [*out[:at], *out[at + 1 : stop]]), *out[stop:]]
    return out
