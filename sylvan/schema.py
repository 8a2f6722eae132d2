"""Node tables: a row per node, with interval and sibling positions.

A node d lies below a node a of its document where a.pre < d.pre <= a.last. Template contents and other
nodes without a place in the tree have attached = false and are numbered after the tree.
"""

from __future__ import annotations

import pyarrow as pa

from sylvan.css.match import SPLIT, is_blank
from sylvan.markup.dom import HTML, Document, Node

ATTR = pa.struct([("ns", pa.string()), ("prefix", pa.string()), ("name", pa.string()), ("value", pa.string())])
FIELDS = [
    ("node_id", pa.int32(), "int"), ("parent_id", pa.int32(), "int"), ("pre", pa.int32(), "int"), ("last", pa.int32(), "int"), ("depth", pa.int32(), "int"),
    ("sib_idx", pa.int32(), "int"), ("elem_idx", pa.int32(), "int"), ("elem_ridx", pa.int32(), "int"), ("type_idx", pa.int32(), "int"), ("type_ridx", pa.int32(), "int"),
    ("n_child", pa.int32(), "int"), ("n_elem", pa.int32(), "int"), ("n_solid", pa.int32(), "int"),
    ("kind", pa.string(), "string"), ("ns", pa.string(), "string"), ("tag", pa.string(), "string"),
    ("attrs", pa.list_(ATTR), "array<struct<ns:string,prefix:string,name:string,value:string>>"), ("id_attr", pa.string(), "string"), ("classes", pa.list_(pa.string()), "array<string>"),
    ("text", pa.string(), "string"), ("pi_target", pa.string(), "string"), ("dt_public", pa.string(), "string"), ("dt_system", pa.string(), "string"),
    ("template_root", pa.int32(), "int"), ("mathml_ip", pa.bool_(), "boolean"), ("attached", pa.bool_(), "boolean"),
]
NAMES = [f[0] for f in FIELDS]


def ddl(id_type: str) -> str:
    return f"doc_id {id_type}, " + ", ".join(f"`{n}` {t}" for n, _, t in FIELDS)


def classes_of(node: Node) -> list[str]:
    return [c for c in SPLIT.split(node.attr("class") or "") if c]


def attrs_of(node: Node) -> list[dict] | None:
    return [dict(zip(("ns", "prefix", "name", "value"), a, strict=True)) for a in node.attrs] if node.kind == "element" else None


#: Columns of nodes in the tree that the node and its children decide.
OWN = {
    "parent_id": lambda n: n.parent.id if n.parent is not None else None, "n_child": lambda n: len(n.children), "n_elem": lambda n: len(n.elements()), "n_solid": lambda n: sum(c.kind == "text" and not is_blank(c.text) for c in n.children),
    "kind": lambda n: n.kind, "ns": lambda n: n.ns, "tag": lambda n: n.tag, "attrs": attrs_of, "id_attr": lambda n: n.attr("id") if n.kind == "element" else None,
    "classes": lambda n: classes_of(n) if n.kind == "element" else None, "text": lambda n: n.text, "attached": lambda n: True,
}


def rows_of(doc: Document, extra: list[Node] = ()) -> list[tuple]:
    """The rows of a document in the order of FIELDS; extra: further roots without a place."""
    out, pre = [], 0
    roots = [doc.root, *extra]
    for root in roots:
        depth, stack, last_of = {id(root): 0}, [(root, False)], {}
        order: list[tuple[Node, tuple]] = []
        place = {id(root): (None, 1, *([1] * 4 if root.kind == "element" else [None] * 4))}
        while stack:
            node, leaving = stack.pop()
            if leaving:
                last_of[id(node)] = pre
                continue
            pre += 1
            order.append((node, pre))
            stack.append((node, True))
            elements = [c for c in node.children if c.kind == "element"]
            totals: dict = {}
            for c in elements:
                totals[c.ns, c.tag] = totals.get((c.ns, c.tag), 0) + 1
            seen, at = {}, 0
            for i, c in enumerate(node.children):
                depth[id(c)] = depth[id(node)] + 1
                if c.kind == "element":
                    at += 1
                    key = (c.ns, c.tag)
                    seen[key] = seen.get(key, 0) + 1
                    place[id(c)] = (node.id, i + 1, at, len(elements) - at + 1, seen[key], totals[key] - seen[key] + 1)
                else:
                    place[id(c)] = (node.id, i + 1, None, None, None, None)
            stack += [(c, False) for c in reversed(node.children)]
            if node.template is not None:
                roots.append(node.template)
        for node, at in order:
            parent, *positions = place[id(node)]
            element = node.kind == "element"
            solid = sum(c.kind == "text" and not is_blank(c.text) for c in node.children)
            out.append(
                (
                    node.id, parent, at, last_of[id(node)], depth[id(node)], *positions, len(node.children), sum(c.kind == "element" for c in node.children), solid,
                    node.kind, node.ns, node.tag, [dict(zip(("ns", "prefix", "name", "value"), a, strict=True)) for a in node.attrs] if element else None,
                    node.attr("id") if element else None, classes_of(node) if element else None, node.text, node.target, node.public, node.system,
                    node.template.id if node.template is not None else None, node.math_ip if element else None, root is doc.root,
                )
            )
    return out


def batch_of(ids: list, rows: list[list[tuple]], id_type: pa.DataType) -> pa.RecordBatch:
    """An Arrow batch of the rows of several documents."""
    owner = [i for i, own in zip(ids, rows, strict=True) for _ in own]
    columns = list(zip(*(r for own in rows for r in own), strict=True)) or [()] * len(FIELDS)
    return pa.RecordBatch.from_arrays([pa.array(owner, id_type), *(pa.array(c, t) for c, (_, t, _) in zip(columns, FIELDS, strict=True))], names=["doc_id", *NAMES])


def tree_of(columns: dict[str, list]) -> tuple[Document, dict[int, Node], list[Node]]:
    """A document from its rows in the order of pre: the document, its nodes by id, and roots without a place."""
    nodes: dict[int, Node] = {}
    extra, size = [], 0
    root = None
    for i, id_ in enumerate(columns["node_id"]):
        attrs = [[a["ns"], a["prefix"], a["name"], a["value"]] for a in columns["attrs"][i] or ()]
        node = Node(id_, columns["kind"][i], columns["tag"][i], columns["ns"][i], attrs, columns["text"][i])
        node.target, node.public, node.system, node.math_ip = columns["pi_target"][i], columns["dt_public"][i], columns["dt_system"][i], bool(columns["mathml_ip"][i])
        nodes[id_], size = node, max(size, id_ + 1)
        parent = columns["parent_id"][i]
        if parent is not None:
            nodes[parent].append(node)
        elif columns["attached"][i]:
            root = node
        else:
            extra.append(node)
    templates = {t: nodes[columns["node_id"][i]] for i, t in enumerate(columns["template_root"]) if t is not None}
    for t, owner in templates.items():
        owner.template = nodes[t]
    doc = Document(root if root is not None else Node(0, "document"))
    doc.size = max(size, 1)
    return doc, nodes, [n for n in extra if n.id not in templates]


__all__ = ["ATTR", "FIELDS", "HTML", "NAMES", "batch_of", "ddl", "rows_of", "tree_of"]
