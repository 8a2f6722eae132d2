"""Plain text of nodes: normalised counts, and text laid out by the elements that it stands in."""

from __future__ import annotations

import re
from collections.abc import Iterator

from sylvan.markup.dom import Node

#: Unicode white space (Python's str.isspace also takes four control characters).
TRIM = "".join(chr(c) for c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))
SPACES = re.compile(f"[{TRIM}]+")
WORDS = re.compile(f"[^{TRIM}]+")

#: Fixed: what formatted text puts after an element; those with an empty line also begin on a line of their own.
AFTER = dict.fromkeys("article blockquote section div p pre h1 h2 h3 h4 h5 h6 ul ol dl table".split(), "\n\n") | dict.fromkeys("br hr li tr".split(), "\n") | {"td": " ", "th": " "}


class Tape:
    """Text that grows at its end and is trimmed at both ends, in time that goes by what is written."""

    LOOK = 16  # characters of the end that are at hand

    def __init__(self):
        self.parts: list[str] = []
        self.head = 0  # parts before it are trimmed away
        self.end = ""

    def __bool__(self) -> bool:
        return bool(self.end)

    def __str__(self) -> str:
        return "".join(self.parts[self.head :])

    def put(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.end = (self.end + text[-self.LOOK :])[-self.LOOK :]

    def flow(self, text: str, words: list[str] | None = None) -> None:
        """Words (of the text, unless given) with single spaces, and one at each end where the text has any."""
        words = WORDS.findall(text) if words is None else words
        if words:
            if text[0] in TRIM and self.end and self.end[-1] not in "\n ":
                self.put(" ")
            self.put(" ".join(words) + (" " if text[-1] in TRIM else ""))
        elif text and self.end and self.end[-1] not in TRIM:
            self.put(" ")

    def cut(self, characters: str = " ", both: bool = False) -> None:
        """Without these characters at the end, or at both ends."""
        while len(self.parts) > self.head and not (kept := self.parts[-1].rstrip(characters)):
            self.parts.pop()
        if len(self.parts) > self.head:
            self.parts[-1] = kept
        while both and self.head < len(self.parts) and not (kept := self.parts[self.head].lstrip(characters)):
            self.head += 1
        if both and self.head < len(self.parts):
            self.parts[self.head] = kept
        self.end, at = "", len(self.parts)
        while len(self.end) < self.LOOK and at > self.head:
            at -= 1
            self.end = self.parts[at][-self.LOOK :] + self.end
        self.end = self.end[-self.LOOK :]


def events(node: Node, whole: bool, verbatim: str) -> Iterator[tuple[str, Node]]:
    """open, close, text, and raw for elements of that name, in document order: of the node, or of what is in it."""
    stack: list[tuple[str, Node]] = [("open", node)] if whole else [("open", c) for c in reversed(node.children)]
    while stack:
        event, x = stack.pop()
        if x.kind == "text":
            yield "text", x
        elif x.kind == "element":
            yield event, x
            if event == "open":
                stack.append(("close", x))
                if x.tag == verbatim:
                    yield "raw", x
                else:
                    stack += [("open", c) for c in reversed(x.children)]


def char_count(node: Node) -> int:
    """Characters of the text, with each run of white space as one and none at the ends."""
    return len(SPACES.sub(" ", node.string()).strip(TRIM))


def formatted(node: Node, whole: bool = False) -> str:
    """Text with line breaks after paragraphs and rows; whole: the node itself too, and untrimmed."""
    tape = Tape()
    for event, x in events(node, whole, "pre"):
        after = AFTER.get(x.tag) if x.kind == "element" else None
        if event == "text":
            tape.flow(x.text)
        elif event == "raw":
            tape.put(x.string())
        elif not after or not tape or tape.end.endswith("\n\n"):
            continue
        elif event == "open":
            tape.put("\n" if after == "\n\n" else "")
        elif after == " ":
            tape.put("" if tape.end[-1] in "\n " else " ")
        else:
            tape.cut()
            tape.put(after)
    if not whole:
        tape.cut(TRIM)
    return str(tape)
