"""Structural edits of one document, for several nodes at once."""

from __future__ import annotations

from functools import lru_cache

from sylvan.css.match import SPLIT
from sylvan.markup.dom import Document, Node
from sylvan.markup.treebuilder import parse_fragment


def copied(doc: Document, node: Node) -> Node:
    """A copy of a subtree as nodes of doc, with new ids in document order, contents of templates first."""
    todo: list[tuple[Node, Node | None, bool]] = [(node, None, False)]
    top = None
    while todo:
        old, owner, content = todo.pop()
        new = doc.new(old.kind, tag=old.tag, ns=old.ns, attrs=[a[:] for a in old.attrs], text=old.text)
        new.target, new.public, new.system, new.math_ip = old.target, old.public, old.system, old.math_ip
        if owner is None:
            top = new
        elif content:
            owner.template = new
        else:
            owner.append(new)
        todo += [(c, new, False) for c in reversed(old.children)]
        if old.template is not None:
            todo.append((old.template, new, True))
    return top


@lru_cache(64)
def fragment_nodes(html: str) -> list[Node]:
    """The top nodes of a fragment, parsed once a worker; they are only ever copied."""
    return parse_fragment(html).root.children[0].children[:]


class Changes:
    """What is to stand before, instead of and after children, made in one pass over each parent's children."""

    def __init__(self):
        self.parents: dict[int, tuple[Node, dict[int, tuple[list[Node], list[Node]]]]] = {}

    def put(self, target: Node, before: list[Node] = (), after: list[Node] = (), keep: bool = True) -> None:
        if target.parent is not None:
            own = self.parents.setdefault(id(target.parent), (target.parent, {}))[1]
            own[id(target)] = ([*before, *([target] if keep else [])], list(after))

    def make(self) -> None:
        for parent, own in self.parents.values():
            old, parent.children = parent.children, []
            for c in old:
                if id(c) in own:
                    c.parent = None
                    for n in (n for part in own[id(c)] for n in part):
                        parent.append(n)
                else:
                    parent.children.append(c)


def detach_all(nodes: list[Node]) -> None:
    changes = Changes()
    for n in nodes:
        changes.put(n, keep=False)
    changes.make()


def put_before(target: Node, nodes: list[Node]) -> None:
    put_beside(target, nodes, True)


def put_after(target: Node, nodes: list[Node]) -> None:
    put_beside(target, nodes, False)


def put_beside(target: Node, nodes: list[Node], before: bool) -> None:
    if target.parent is not None:
        detach_all([n for n in nodes if n is not target])
        changes = Changes()
        changes.put(target, *((nodes, ()) if before else ((), nodes)))
        changes.make()


def put_first(target: Node, nodes: list[Node]) -> None:
    detach_all(nodes)
    rest, target.children = target.children, []
    for n in nodes:
        target.append(n)
    target.children += rest


def put_last(target: Node, nodes: list[Node]) -> None:
    detach_all(nodes)
    for n in nodes:
        target.append(n)


def empty(target: Node) -> None:
    for c in target.children:
        c.parent = None
    target.children = []


def put(targets: list[Node], verb: str, copies) -> None:
    """Copies, made anew for each target, put where the first word of the verb says."""
    changes, wrapped = Changes(), []
    for t in targets:
        own = copies()
        if verb == "set":
            empty(t)
            put_last(t, own)
        elif verb in ("append", "prepend"):
            (put_last if verb == "append" else put_first)(t, own)
        elif verb == "wrap":
            if own:
                changes.put(t, own[:1], keep=False)
                wrapped += [(own[0], t)] if t.parent is not None else []
        else:
            changes.put(t, *(((), own) if verb == "after" else (own, ())), keep=verb != "replace")
    changes.make()
    for outer, t in wrapped:
        outer.append(t)


def siblings_run(node: Node, before: bool) -> list[Node]:
    """The node with the siblings after it, or before it."""
    if node.parent is None:
        return [node]
    own = node.parent.children
    at = next(i for i, c in enumerate(own) if c is node)
    return own[: at + 1] if before else own[at:]


def within(node: Node, other: Node) -> bool:
    while node is not None:
        if node is other:
            return True
        node = node.parent
    return False


def edit(doc: Document, targets: list[Node], verb: str, *args) -> None:
    """Apply a verb to all targets in order.

    With HTML: set_html, append_html, prepend_html, before_html, after_html, replace_with_html, wrap_html,
    and replace_node_html, which leaves the targets where there is nothing to replace them with.
    With a list of nodes, which are taken from their place and copied to each target: append_selection,
    prepend_selection, before_selection, after_selection, replace_with_selection, wrap_selection (in the
    first of them). With a list of nodes that move to the first target, each with the siblings that follow
    it: append_run, before_run, after_run; prepend_run takes those before it instead; reparent_children
    moves what is in them. What would stand below itself doesn't move. Others: remove, remove_children, set_text(text), unwrap,
    strip_elements(*names), normalize, rename(name), set_attr(name, value), remove_attrs(*names),
    retain_attrs(*names), add_class(names), remove_class(names).
    """
    if verb.endswith("_html"):
        nodes = fragment_nodes(args[0])
        if nodes or not verb.endswith("_node_html"):
            put(targets, verb.split("_")[0], lambda: [copied(doc, n) for n in nodes])
    elif verb.endswith("_selection"):
        sources = args[0][:1] if verb == "wrap_selection" else args[0]
        held = {id(n) for s in args[0] for n in s.walk()}
        if not sources or any(id(t) in held for t in targets):
            return
        detach_all(args[0])
        put(targets, verb.split("_")[0], lambda: [copied(doc, s) for s in sources])
    elif verb.endswith("_run") or verb == "reparent_children":
        for s in args[0] if targets else []:
            run = s.children[:] if verb == "reparent_children" else siblings_run(s, verb == "prepend_run")
            if any(within(targets[0], n) for n in run):
                continue
            {"append_run": put_last, "reparent_children": put_last, "prepend_run": put_first, "before_run": put_before, "after_run": put_after}[verb](targets[0], run)
    elif verb == "remove":
        detach_all(targets)
    elif verb == "remove_children":
        for t in targets:
            empty(t)
    elif verb == "set_text":
        for t in targets:
            if t.kind == "text":
                t.text = args[0]
            elif t.kind == "element":
                empty(t)
                t.append(doc.new("text", text=args[0]))
    elif verb == "rename":
        for t in targets:
            if t.kind == "element":
                t.tag = args[0]
    elif verb == "unwrap":
        for t in targets:
            parent = t.parent
            if parent is not None and parent.kind == "element" and parent.parent is not None:
                at = next(i for i, c in enumerate(parent.children) if c is t)
                put_before(parent, parent.children[at:])
                parent.detach()
    elif verb == "strip_elements":
        for t in targets:
            for n in reversed(list(t.walk())):  # what is below a node is done before it
                old, n.children = n.children, []
                for c in old:
                    strip = c.kind == "element" and c.tag in args
                    for x in c.children if strip else [c]:
                        n.append(x)
                    if strip:
                        c.parent, c.children = None, []
    elif verb == "normalize":
        for t in targets:
            for n in list(t.walk()):
                kept: list[Node] = []
                for c in n.children:
                    if c.kind == "text" and kept and kept[-1].kind == "text":
                        kept[-1].text += c.text
                    elif c.kind != "text" or c.text:
                        kept.append(c)
                n.children = kept
    elif verb in ("set_attr", "remove_attrs", "retain_attrs", "add_class", "remove_class"):
        for t in targets:
            if t.kind == "element":
                attributes(t, verb, *args)
    else:
        raise ValueError(f"no such edit: {verb}")


def attributes(node: Node, verb: str, *args: str) -> None:
    """Attribute and class edits of one element."""
    if verb == "set_attr":
        old = next((a for a in node.attrs if a[2] == args[0]), None)
        if old is None:
            node.attrs.append([None, None, args[0], args[1]])
        else:
            old[3] = args[1]
    elif verb.endswith("_attrs"):
        node.attrs = [a for a in node.attrs if (a[2] in args) == (verb == "retain_attrs")]
    else:
        names, own = args[0].split(), [c for c in SPLIT.split(node.attr("class") or "") if c]
        if not names or verb == "remove_class" and node.attr("class") is None:
            return
        kept = own + [n for n in dict.fromkeys(names) if n not in own] if verb == "add_class" else [c for c in own if c not in names]
        attributes(node, "set_attr", "class", " ".join(kept))


def violations(doc: Document) -> list[str]:
    """What is wrong with the links between nodes: nothing, unless an edit went wrong."""
    out, seen = [], set()
    if doc.root.parent is not None:
        out.append("the root has a parent")
    for n in doc.root.walk():
        if id(n) in seen:
            out.append(f"{n} stands twice")
            break
        seen.add(id(n))
        out += [f"{c} names another parent than {n}" for c in n.children if c.parent is not n]
    return out
