"""The restricted selectors: compounds of a fixed order, matched step by step from a start node."""

from __future__ import annotations

import re
from dataclasses import dataclass

from sylvan.css.match import SPLIT
from sylvan.css.parser import SelectorError
from sylvan.markup.dom import Node

_WORD = r"[A-Za-z0-9-]+"
_COMBINATOR = re.compile(r"\s*([>+~])\s*")
_HEAD = re.compile(rf"({_WORD})?(?:#({_WORD}))?((?:\.{_WORD})*)")
_ATTR = re.compile(rf"\[({_WORD})(?:\s*([~|^$*]?=)\s*(?:\"([^\"]+)\"|'([^']+)'|(?![\"'])([^\]]+)))?\](?!\])")
_BAD_VALUE = re.compile(rf"\[{_WORD}\s*[~|^$*]?=\s*(?:\"(?:[^\"]*$|\")|'(?:[^']*$|'))")


@dataclass(frozen=True)
class Mini:
    combinator: str = " "
    tag: str | None = None
    id: str | None = None
    classes: tuple = ()
    attrs: tuple = ()  # (name, operator or None, value)


def compound(text: str, at: int = 0) -> tuple[Mini | None, int]:
    """A compound at a place and where it ends; None if there is none."""
    start, combinator = at, " "
    if m := _COMBINATOR.match(text, at):
        combinator, at = m[1], m.end()
    m = _HEAD.match(text, at)
    at, attrs = m.end(), []
    while a := _ATTR.match(text, at):
        attrs.append((a[1], a[2], next((v for v in (a[3], a[4], a[5]) if v is not None), "")))
        at = a.end()
    if not attrs and _BAD_VALUE.match(text, at):
        raise SelectorError(f"an attribute value isn't closed at {at} of {text!r}")
    if at == start:
        return None, at
    return Mini(combinator, m[1], m[2], tuple(filter(None, m[3].split("."))), tuple(attrs)), at


def parse_one(text: str) -> Mini:
    own, _ = compound(text)
    if own is None:
        raise SelectorError(f"no selector in {text!r}")
    return own


def parse_path(text: str) -> list[Mini]:
    """The compounds of a path; what follows them unparsed is ignored."""
    out, at = [], 0
    while True:
        at += len(text[at:]) - len(text[at:].lstrip(" \t\r\n"))
        own, end = compound(text, at)
        if own is None or end == at:
            return out
        out.append(own)
        at = end


def value_matches(op: str | None, value: str, want: str) -> bool:
    if op is None:
        return True
    if not value:
        return False
    if op == "=":
        return value == want
    if op == "~=":
        return want in SPLIT.split(value)
    if op == "|=":
        return value == want or value.startswith(want + "-")
    return value.startswith(want) if op == "^=" else value.endswith(want) if op == "$=" else want in value


def matches(node: Node, s: Mini) -> bool:
    if node.kind != "element" or s.tag is not None and node.tag != s.tag or s.id is not None and node.attr("id") != s.id:
        return False
    own = SPLIT.split(node.attr("class") or "")
    return all(c in own for c in s.classes) and all(any(a[2] == k and value_matches(op, a[3], v) for a in node.attrs) for k, op, v in s.attrs)


def below(node: Node, test, last: bool) -> list[Node]:
    """Matching elements below the node, not entering those that match before the last step."""
    found, stack = [], list(reversed(node.elements()))
    while stack:
        x = stack.pop()
        hit = test(x)
        if hit:
            found.append(x)
        if last or not hit:
            stack += reversed(x.elements())
    return found


def following(node: Node) -> list[Node]:
    if node.parent is None:
        return []
    own = node.parent.children
    at = next(i for i, c in enumerate(own) if c is node)
    return [c for c in own[at + 1 :] if c.kind == "element"]


def find_descendants(node: Node, text: str) -> list[Node]:
    """The path's matches, with repeats where several steps lead to one node."""
    found, path = [node], parse_path(text)
    for i, s in enumerate(path):
        nodes = []
        for x in found:
            if s.combinator == " ":
                nodes += below(x, lambda n, s=s: matches(n, s), i == len(path) - 1)
            elif s.combinator == ">":
                nodes += [c for c in x.elements() if matches(c, s)]
            else:
                after = following(x)
                nodes += [c for c in (after[:1] if s.combinator == "+" else after) if matches(c, s)]
        found = nodes
    return found


def find(node: Node, names: list[str]) -> list[Node]:
    """Elements by a path of names."""
    found = [node]
    for i, name in enumerate(names):
        found = [y for x in found for y in below(x, lambda n, name=name: n.tag == name, i == len(names) - 1)]
    return found
