"""Matching selectors on one tree.

A selector is evaluated over all elements at once, compound by compound from the left: each step marks
the elements that what is marked so far reaches through the combinator, in one pass over the tree. Work
goes by elements and compounds, whatever the depth of the tree and the number of siblings.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable
from functools import cached_property, lru_cache

from sylvan.css.parser import Attr, Complex, Compound, Pseudo, parse
from sylvan.markup.dom import HTML, Node
from sylvan.markup.textfmt import TRIM

#: Fixed by the HTML standard: attributes whose values compare without regard to case in selectors.
CASELESS = set(
    "accept accept-charset align alink axis bgcolor charset checked clear codetype color compact declare defer dir direction disabled enctype face "
    "frame hreflang http-equiv lang language link media method multiple nohref noresize noshade nowrap readonly rel rev rules scope scrolling "
    "selected shape target text type valign valuetype vlink".split()
)
SPLIT = re.compile(r"[ \t\n\r\f]+")


def op_matches(op: str, value: str, want: str) -> bool:
    if op == "=":
        return value == want
    if op == "|=":
        return value == want or value.startswith(want + "-")
    if not want:
        return False
    if op == "~=":
        return want in SPLIT.split(value)
    return value.startswith(want) if op == "^=" else value.endswith(want) if op == "$=" else want in value


def lower(text: str) -> str:
    """ASCII letters in lower case."""
    return text.lower() if text.isascii() else "".join(c.lower() if c.isascii() else c for c in text)


@lru_cache(1 << 14)
def words(value: str) -> frozenset[str]:
    return frozenset(SPLIT.split(value))


def attr_matches(node: Node, test: Attr) -> bool:
    for a in node.attrs:
        if a[2].lower() != test.name if node.ns == HTML else a[2] != test.name:
            continue
        if a[0] not in (None, "") and not test.any_ns:
            continue
        if test.op is None:
            return True
        value, want = a[3], test.value
        if test.ignore_case or node.ns == HTML and test.name in CASELESS:
            value, want = lower(value), lower(want)
        if op_matches(test.op, value, want):
            return True
    return False


def nth(place: int, a: int, b: int) -> bool:
    return place == b if a == 0 else (place - b) % a == 0 and (place - b) // a >= 0


def is_blank(text: str) -> bool:
    return not text.strip(TRIM)


class Tree:
    """The elements of a tree, and its root, in document order, with the places of what is around each."""

    def __init__(self, root: Node):
        self.nodes: list[Node] = []
        self.up: list[int] = []  # parents
        self.prev: list[int] = []  # element siblings before
        self.at: dict[int, int] = {}
        self.fixed: dict[int, tuple] = {}  # compounds and pseudo-classes, and what of them no value has a say in
        stack = [(root, -1, None)]
        while stack:
            node, parent, before = stack.pop()
            i = len(self.nodes)
            self.at[id(node)] = i
            self.nodes.append(node)
            self.up.append(parent)
            self.prev.append(-1 if before is None else self.at[id(before)])
            before = None
            own = []
            for c in node.children:
                if c.kind == "element":
                    own.append((c, i, before))
                    before = c
            stack += reversed(own)

    @cached_property
    def last(self) -> list[int]:
        """The last place below each."""
        out = list(range(len(self.nodes)))
        for i in range(len(out) - 1, 0, -1):
            out[self.up[i]] = max(out[self.up[i]], out[i])
        return out

    @cached_property
    def places(self) -> list[tuple[int, int, int, int]]:
        """Place among element siblings, from the end, and among those of its name, from the end."""
        count: dict = {}
        first = []
        for n, up in zip(self.nodes, self.up, strict=True):
            of_kind = (up, n.ns, n.tag)
            count[up] = count.get(up, 0) + 1
            count[of_kind] = count.get(of_kind, 0) + 1
            first.append((count[up], count[of_kind]))
        return [(a, count[up] - a + 1, b, count[up, n.ns, n.tag] - b + 1) for (a, b), n, up in zip(first, self.nodes, self.up, strict=True)]

    @cached_property
    def texts(self) -> tuple[str, list[int], list[int], list[tuple[int, str]]]:
        """All text, where that of each element starts and ends, and (place of the element around it, text) of each piece."""
        start, end, pieces = [0] * len(self.nodes), [0] * len(self.nodes), []
        at, stack = 0, [(self.nodes[0], False)]
        while stack:
            node, leaving = stack.pop()
            if leaving:
                end[self.at[id(node)]] = at
            elif node.kind == "text":
                pieces.append((self.at[id(node.parent)] if node.parent is not None else 0, node.text))
                at += len(node.text)
            elif id(node) in self.at:
                start[self.at[id(node)]] = at
                stack.append((node, True))
                stack += [(c, False) for c in reversed(node.children)]
        return "".join(t for _, t in pieces), start, end, pieces

    def reached(self, marked: list[bool], combinator: str) -> list[bool]:
        """What has a marked element to its left, through a combinator."""
        if combinator == ">":
            return [u >= 0 and marked[u] for u in self.up]
        if combinator == "+":
            return [p >= 0 and marked[p] for p in self.prev]
        out: list[bool] = []
        for before in self.up if combinator == " " else self.prev:
            out.append(before >= 0 and (marked[before] or out[before]))
        return out

    def reaching(self, marked: list[bool], combinator: str) -> list[bool]:
        """What has a marked element to its right, through a combinator."""
        out = [False] * len(marked)
        far = combinator in (" ", "~")
        before = self.up if combinator in (" ", ">") else self.prev
        for i in range(len(marked) - 1, 0, -1):
            if before[i] >= 0 and (marked[i] or far and out[i]):
                out[before[i]] = True
        return out

    def forget(self) -> None:
        """To be called when values in the tree have changed."""
        self.__dict__.pop("texts", None)

    def compound(self, c: Compound, among: list[bool] | None = None) -> list[bool]:
        """What matches a compound, among what is marked."""
        if id(c) not in self.fixed:
            self.fixed[id(c)] = c, [i for i, n in enumerate(self.nodes) if named(n, c)]
        own = self.fixed[id(c)][1]
        out = [False] * len(self.nodes)
        plain = not (c.ids or c.classes or c.attrs)
        for i in own:
            if (among is None or among[i]) and (plain or values_match(self.nodes[i], c)):
                out[i] = True
        for p in c.pseudos:
            if id(p) not in self.fixed:
                self.fixed[id(p)] = p, self.pseudo(p, [True] * len(self.nodes)) if valueless_pseudo(p) else None
            hits = self.fixed[id(p)][1]
            if hits is None:
                hits = self.pseudo(p, out)
            out = [a and b for a, b in zip(out, hits, strict=True)]
        return out

    def complex(self, s: Complex, among: list[bool] | None = None) -> list[bool]:
        """What matches a selector; of one compound, among what is marked."""
        if len(s.compounds) == 1:
            return self.compound(s.compounds[0], among)
        marked = self.compound(s.compounds[0])
        for c, combinator in zip(s.compounds[1:], s.combinators[1:], strict=True):
            marked = self.compound(c, self.reached(marked, combinator))
        return marked

    def relative(self, s: Complex) -> list[bool]:
        """What has a relative selector's match to its right."""
        marked = self.compound(s.compounds[-1], [n.kind == "element" for n in self.nodes])
        for c, combinator in zip(reversed(s.compounds[:-1]), reversed(s.combinators[1:]), strict=True):
            marked = self.compound(c, [a and n.kind == "element" for a, n in zip(self.reaching(marked, combinator), self.nodes, strict=True)])
        return self.reaching(marked, s.combinators[0])

    def any(self, marks: list[list[bool]]) -> list[bool]:
        if len(marks) == 2:
            return [a or b for a, b in zip(*marks, strict=True)]
        return [any(m) for m in zip(*marks, strict=True)] if marks else [False] * len(self.nodes)

    def pseudo(self, p: Pseudo, among: list[bool]) -> list[bool]:
        name = p.name
        if name in ("root", "scope"):
            return [n.kind == "document" for n in self.nodes]
        if name in ("not", "is", "where"):
            marks = [self.complex(s, among) for s in p.selectors]
            own = marks[0] if len(marks) == 1 else self.any(marks)
            return [not x for x in own] if name == "not" else own
        if name == "has":
            return self.any([self.relative(s) for s in p.selectors])
        if name == "has-text":
            out = [False] * len(self.nodes)
            for i, text in self.texts[3]:
                out[i] = out[i] or p.text in text
            return [a or b for a, b in zip(out, self.reaching(out, " "), strict=True)]
        if name == "contains":
            text, start, end, _ = self.texts
            found, at = [], text.find(p.text)
            while at >= 0:
                found.append(at)
                at = text.find(p.text, at + 1)
            first = [bisect_left(found, a) for a in start]
            return [k < len(found) and found[k] + len(p.text) <= b for k, b in zip(first, end, strict=True)]
        if name.endswith("child") or name.endswith("of-type"):
            side = 2 if name.endswith("of-type") else 0
            test = (lambda x: nth(x[side + ("last" in name)], p.a, p.b)) if name.startswith("nth") else (lambda x: x[side] == 1) if name.startswith("first") else (lambda x: x[side + 1] == 1) if name.startswith("last") else (lambda x: x[side] == 1 == x[side + 1])
            return [a and n.kind == "element" and test(x) for a, n, x in zip(among, self.nodes, self.places, strict=True)]
        return [a and element_state(n, name) for a, n in zip(among, self.nodes, strict=True)]


def element_state(node: Node, name: str) -> bool:
    """Pseudo-classes that an element and its children decide."""
    if node.kind != "element":
        return False
    if name == "empty":
        return not any(c.kind == "element" or c.kind == "text" and not is_blank(c.text) for c in node.children)
    if name == "only-text":
        return len(node.children) == 1 and node.children[0].kind == "text" and not is_blank(node.children[0].text)
    if name in ("any-link", "link"):
        return node.tag in ("a", "area", "link") and node.attr("href") is not None
    return False


@lru_cache(1 << 10)
def tests(parsed: tuple) -> frozenset | None:
    """What selectors ask of attribute values: ("id", id), ("class", class) and Attr; None if texts have a say in what they match."""
    out: set = set()
    for c in (c for s in parsed for c in s.compounds):
        out |= {("id", i) for i in c.ids} | {("class", k) for k in c.classes} | {a for a in c.attrs if a.op is not None}
        for p in c.pseudos:
            own = None if p.name in ("contains", "has-text", "empty", "only-text") else tests(p.selectors) if p.selectors else frozenset()
            if own is None:
                return None
            out |= own
    return frozenset(out)


def valueless_pseudo(p: Pseudo) -> bool:
    """Whether no attribute value or text has a say in what it matches."""
    return p.name not in ("contains", "has-text", "empty", "only-text") and (not p.selectors or tests(p.selectors) == frozenset())


def about(test: tuple | Attr, node: Node, attr: list) -> Callable[[str], bool] | None:
    """What one of tests() says of the values of an attribute of a node; None if it doesn't ask for it."""
    ns, name = attr[0], attr[2]
    if isinstance(test, tuple):
        kind, want = test
        return None if name != kind else (lambda v: v == want) if kind == "id" else (lambda v: want in words(v))
    if (name.lower() if node.ns == HTML else name) != test.name:
        return None
    return lambda v: attr_matches(Node(0, "element", node.tag, node.ns, [[ns, attr[1], name, v]]), test)


def named(node: Node, c: Compound) -> bool:
    """A compound's name and namespace."""
    if c.tag is not None and (node.kind != "element" or node.tag != (c.tag.lower() if node.ns == HTML else c.tag)):
        return False
    return not (c.ns == "" and node.kind == "element")


def values_match(node: Node, c: Compound) -> bool:
    """A compound's ids, classes and attributes."""
    if c.ids and any(node.attr("id") != i for i in c.ids):
        return False
    if c.classes:
        own = words(node.attr("class") or "")
        for k in c.classes:
            if k not in own:
                return False
    return not c.attrs or all(attr_matches(node, a) for a in c.attrs)


def select(roots: list[Node], selector: str | tuple, trees: dict[int, Tree] | None = None) -> list[Node]:
    """Elements below the roots that match, root by root in document order, each once. trees: of trees that stay as they are, by their tops."""
    parsed = parse(selector) if isinstance(selector, str) else selector
    marks: dict[int, tuple[Tree, list[bool]]] = {}
    out = []
    for root in roots:
        top = root
        while top.parent is not None:
            top = top.parent
        if id(top) not in marks:
            tree = tree_under(top, trees)
            own = [tree.complex(s) for s in parsed]
            marks[id(top)] = tree, own[0] if len(own) == 1 else tree.any(own)
        tree, marked = marks[id(top)]
        at = tree.at.get(id(root))
        for i in range(at + 1, tree.last[at] + 1) if at is not None else ():
            if marked[i]:
                marked[i] = False
                out.append(tree.nodes[i])
    return out


def tree_under(top: Node, trees: dict[int, Tree] | None = None) -> Tree:
    if trees is None:
        return Tree(top)
    if id(top) not in trees:
        trees[id(top)] = Tree(top)
    return trees[id(top)]
