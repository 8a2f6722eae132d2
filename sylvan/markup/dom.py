"""Nodes of a parsed document."""

from __future__ import annotations

from collections.abc import Iterator

HTML, SVG, MATH = "html", "svg", "math"


class Node:
    """A node of any kind; attrs is a list of [namespace, prefix, name, value]."""

    __slots__ = ("id", "kind", "ns", "tag", "attrs", "text", "target", "public", "system", "parent", "children", "template", "math_ip")

    def __init__(self, id_: int, kind: str, tag: str | None = None, ns: str | None = None, attrs: list | None = None, text: str | None = None):
        self.id, self.kind, self.tag, self.ns, self.attrs, self.text = id_, kind, tag, ns, attrs or [], text
        self.target = self.public = self.system = self.parent = self.template = None
        self.children: list[Node] = []
        self.math_ip = False

    def attr(self, name: str) -> str | None:
        for a in self.attrs:
            if a[2] == name:
                return a[3]
        return None

    def append(self, child: Node) -> None:
        child.parent = self
        self.children.append(child)

    def insert(self, child: Node, before: Node) -> None:
        child.parent = self
        self.children.insert(self.children.index(before), child)

    def detach(self) -> None:
        if self.parent is not None:
            own = self.parent.children
            if own[-1] is self:
                own.pop()
            else:
                own.remove(self)
            self.parent = None

    def walk(self) -> Iterator[Node]:
        """This node and its descendants in document order."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(node.children))

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.kind == "element"]

    def string(self) -> str:
        return "".join(n.text for n in self.walk() if n.kind == "text")

    def __repr__(self) -> str:
        return f"<{self.kind} {self.tag or self.text!r}>"


class Document:
    """A root node, what was wrong with the source, and its quirks mode.

    form, kept, trees: of a tree that serves several pages (see forms), its form and what was found in it for all of them.
    """

    form = None
    kept: dict | None = None
    trees: dict | None = None

    def __init__(self, root: Node):
        self.root, self.errors, self.quirks, self.size = root, [], "no-quirks", root.id + 1

    def new(self, kind: str, **more) -> Node:
        node = Node(self.size, kind, **more)
        self.size += 1
        return node
