"""Writing nodes as HTML."""

from __future__ import annotations

from sylvan.markup.dom import HTML, Node

#: Fixed by the standard: elements without an end tag, and those whose text is written as it is.
VOID = set("area base basefont bgsound br col embed frame hr img input keygen link meta param source track wbr".split())
RAW = {"style", "script", "xmp", "iframe", "noembed", "noframes", "plaintext"}


def escape(text: str) -> str:
    return text.replace("&", "&amp;").replace("\xa0", "&nbsp;").replace("<", "&lt;").replace(">", "&gt;")


def start_tag(node: Node) -> str:
    names = (a[2] if a[0] in (None, "") or a[2] == "xmlns" else f"{a[1] or a[0]}:{a[2]}" for a in node.attrs)
    return f"<{node.tag}" + "".join(f' {n}="{escape(a[3]).replace(chr(34), "&quot;")}"' for n, a in zip(names, node.attrs, strict=True)) + ">"


def is_raw(text: Node) -> bool:
    """Whether a text is written as it is."""
    parent = text.parent
    return parent is not None and parent.tag in RAW and parent.kind == "element" and parent.ns == HTML


def to_html(node: Node, inner: bool = False) -> str:
    """The node and what is in it, or only the latter; a document's or fragment's root is never written itself."""
    out: list[str] = []
    inner = inner or node.kind in ("document", "fragment")
    stack: list[Node | str] = list(reversed(node.children)) if inner else [node]
    if inner and node.template is not None:
        stack += reversed(node.template.children)
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.kind == "text":
            out.append(x.text if is_raw(x) else escape(x.text))
        elif x.kind == "element":
            out.append(start_tag(x))
            if x.ns == HTML and x.tag in VOID:
                continue
            stack.append(f"</{x.tag}>")
            stack += reversed(x.children)
            if x.template is not None:
                stack += reversed(x.template.children)
        elif x.kind == "comment":
            out.append(f"<!--{x.text}-->")
        elif x.kind == "doctype":
            out.append(f"<!DOCTYPE {x.tag}>")
        elif x.kind == "pi":
            out.append(f"<?{x.target} {x.text}>")
        else:
            stack += reversed(x.children)
    return "".join(out)
