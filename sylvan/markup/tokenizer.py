"""The tokenizer of the WHATWG HTML standard, scanning with regular expressions."""

from __future__ import annotations

import re
from html.entities import html5

SPACE = "\t\n\f\r "
#: Fixed by the standard: what numeric references in this range stand for.
REMAPPED = dict(zip(range(0x80, 0xA0), b"".join(bytes([c]) for c in range(0x80, 0xA0)).decode("cp1252", "replace"), strict=True))

_REFERENCE = re.compile(r"&(?:#[xX]([0-9a-fA-F]+);?|#([0-9]+);?|([A-Za-z][A-Za-z0-9]*;?))")
_NAME = re.compile(r"[^\t\n\f />]*")
_GAP = re.compile(r"[\t\n\f /]*")
_ATTRIBUTE = re.compile(r"([^\t\n\f />][^\t\n\f />=]*)(?:[\t\n\f ]*=[\t\n\f ]*(?:\"([^\"]*)(\"?)|'([^']*)('?)|([^\t\n\f >\"'][^\t\n\f >]*)?))?")
#: Most tags: lower-case names, one space before each attribute, double quotes and no references.
_USUAL = re.compile(r"([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*=\"[^\"&\0]*\")*)>")
_PAIR = USUAL_PAIR = re.compile(r" ([a-z0-9-]+)=\"([^\"]*)\"")
#: Text without references and nulls, or such a tag.
USUAL = re.compile(r"([^<&\0]+)|<(/?)([a-z][a-z0-9]*)((?: [a-z][a-z0-9-]*=\"[^\"&\0]*\")*)>")
_COMMENT_END = re.compile(r"--!?>")
_SCRIPT = re.compile(r"<!--|-->|<(/?)script(?=[\t\n\f />])", re.IGNORECASE)
_DOCTYPE = re.compile(r"[\t\n\f ]*([^\t\n\f >]*)[\t\n\f ]*(?:(public|system)[\t\n\f ]*(?:\"([^\">]*)\"?|'([^'>]*)'?)?[\t\n\f ]*(?:\"([^\">]*)\"?|'([^'>]*)'?)?)?[^>]*", re.IGNORECASE)
#: A null, or a reference: its number sign, number, name and semicolon.
_CHECKED = re.compile(r"\0|&(?:(#)([xX][0-9a-fA-F]+|[0-9]+)?|([A-Za-z0-9]+))(;?)")
_LONGEST = max(map(len, html5))


def _number(value: int) -> str:
    if value in REMAPPED and REMAPPED[value] != "�":
        return REMAPPED[value]
    return "�" if value == 0 or value > 0x10FFFF or 0xD800 <= value <= 0xDFFF else chr(value)


def decode(text: str, attribute: bool = False) -> str:
    """Text with its character references replaced."""
    if "&" not in text:
        return text

    def replace(m: re.Match) -> str:
        if m[1] or m[2]:
            digits = m[1] or m[2]
            return _number(min(int(digits[-40:] if len(digits) > 40 else digits, 16 if m[1] else 10), 0x110000))
        name = m[3]
        for n in range(min(len(name), _LONGEST), 0, -1):
            if (found := html5.get(name[:n])) is None:
                continue
            if name[n - 1] != ";" and attribute:
                after = name[n : n + 1] or m.string[m.end() : m.end() + 1]
                if after == "=" or after.isascii() and after.isalnum():
                    return m[0]
            return found + name[n:]
        return m[0]

    return _REFERENCE.sub(replace, text)


class Tokenizer:
    """Tokens are tuples: (start, name, attributes, closed), (end, name), (text, data), (comment, data), (doctype, name, public, system, quirks), (eof,)."""

    def __init__(self, text: str):
        self.text = text.replace("\r\n", "\n").replace("\r", "\n")
        self.at = 0
        self.mode = "data"  # or rcdata, rawtext, script, plaintext
        self.last = ""
        self.errors: list[str] = []

    def next(self, foreign: bool) -> tuple:
        text, at, n = self.text, self.at, len(self.text)
        if at >= n:
            return ("eof",)
        if self.mode != "data":
            return self.raw()
        if text[at] != "<":
            end = text.find("<", at)
            end = n if end < 0 else end
            self.at = end
            data = text[at:end]
            if "&" in data or "\0" in data:
                self.report(data)
            return ("text", decode(data))
        follow = text[at + 1 : at + 2]
        if follow.isascii() and follow.isalpha():
            return self.tag(at + 1, False)
        if follow == "/":
            third = text[at + 2 : at + 3]
            if third.isascii() and third.isalpha():
                return self.tag(at + 2, True)
            if third == ">":
                self.error("missing end tag name", at + 3)
                return self.next(foreign)
            if third:
                return self.bogus(at + 2)
            self.error("end of file before tag name", n)
            return ("text", "</")
        if follow == "!":
            return self.markup(at + 2, foreign)
        if follow == "?":
            return self.bogus(at + 1)
        self.error("invalid first character of a tag name", at + 1)
        return ("text", "<")

    def error(self, what: str, at: int) -> None:
        self.errors.append(what)
        self.at = at

    def report(self, data: str, attribute: bool = False) -> None:
        """What is wrong with the character references and characters of a text."""
        for m in _CHECKED.finditer(data):
            if m[0] == "\0":
                self.errors.append("null character")
            elif m[1] is not None:
                self.errors += ["no digits in a character reference"] if not m[2] else ["no semicolon after a character reference"] if not m[4] else []
            elif m[4] and m[3] + ";" not in html5:
                self.errors.append("unknown character reference")
            elif not m[4] and any(m[3][:n] in html5 for n in range(len(m[3]), 1, -1)) and not (attribute and data[m.end() : m.end() + 1] == "="):
                self.errors.append("no semicolon after a character reference")

    def bogus(self, at: int) -> tuple:
        end = self.text.find(">", at)
        data = self.text[at : end if end >= 0 else None]
        self.error("incorrectly opened comment", end + 1 if end >= 0 else len(self.text))
        return ("comment", data.replace("\0", "�"))

    def markup(self, at: int, foreign: bool) -> tuple:
        text = self.text
        if text.startswith("--", at):
            return self.comment(at + 2)
        if text[at : at + 7].lower() == "doctype":
            return self.doctype(at + 7)
        if foreign and text.startswith("[CDATA[", at):
            end = text.find("]]>", at + 7)
            data = text[at + 7 : end if end >= 0 else None]
            self.at = end + 3 if end >= 0 else len(text)
            return ("text", data)
        return self.bogus(at)

    def comment(self, at: int) -> tuple:
        text = self.text
        for short in (">", "->"):
            if text.startswith(short, at):
                self.error("abrupt closing of empty comment", at + len(short))
                return ("comment", "")
        m = _COMMENT_END.search(text, at)
        if m:
            data, self.at = text[at : m.start()], m.end()
        else:
            data = text[at:]
            self.error("end of file in comment", len(text))
            for tail in ("--!", "--", "-"):
                if data.endswith(tail):
                    data = data[: -len(tail)]
                    break
        return ("comment", data.replace("\0", "�"))

    def doctype(self, at: int) -> tuple:
        m = _DOCTYPE.match(self.text, at)
        closed = self.text.startswith(">", m.end())
        self.at = m.end() + closed
        name = m[1].lower().replace("\0", "�") or None
        first = m[3] if m[3] is not None else m[4]
        second = m[5] if m[5] is not None else m[6]
        word = (m[2] or "").lower()
        public, system = (first, second) if word == "public" else (None, first)
        return ("doctype", name, public, system, not closed or name is None or bool(word) and first is None)

    def tag(self, at: int, end: bool) -> tuple:
        text, n = self.text, len(self.text)
        if m := _USUAL.match(text, at):
            pairs = _PAIR.findall(m[2]) if m[2] else []
            if len(pairs) < 2 or len({k for k, _ in pairs}) == len(pairs):
                self.at = m.end()
                if end:
                    return ("end", m[1])
                self.last = m[1]
                return ("start", m[1], pairs, False)
        m = _NAME.match(text, at)
        name = m[0].lower() if m[0].isascii() else "".join(c.lower() if c.isascii() else c for c in m[0])
        name = name.replace("\0", "�")
        at, attributes, seen = m.end(), [], set()
        while True:
            gap = _GAP.match(text, at)
            at = gap.end()
            if at >= n:
                self.error("end of file in tag", n)
                return ("eof",)
            if text[at] == ">":
                closed = at > 0 and text[at - 1] == "/" and gap.end() > gap.start()
                self.at = at + 1
                break
            m = _ATTRIBUTE.match(text, at)
            if m[3] == "" or m[5] == "":  # a quote that is never closed
                self.error("end of file in tag", n)
                return ("eof",)
            value = next((v for v in (m[2], m[4], m[6]) if v is not None), "")
            key = m[1] if m[1].islower() else "".join(c.lower() if c.isascii() else c for c in m[1])
            key, at = key.replace("\0", "�"), m.end()
            if "&" in value:
                self.report(value, True)
            if key in seen:
                self.errors.append("duplicate attribute")
            else:
                seen.add(key)
                attributes.append((key, decode(value, True).replace("\0", "�")))
        if end:
            return ("end", name)
        self.last = name
        return ("start", name, attributes, closed)

    def raw(self) -> tuple:
        text, at, n = self.text, self.at, len(self.text)
        if self.mode == "plaintext":
            self.at = n
            return ("text", text[at:].replace("\0", "�"))
        if self.mode == "script":
            end = self.script_end(at)
        else:
            m = re.compile(rf"</{re.escape(self.last)}(?=[\t\n\f />])", re.IGNORECASE).search(text, at)
            end = m.start() if m else n
        if end > at:
            self.at = end
            data = text[at:end]
            if self.mode == "rcdata":
                self.report(data)
            data = data.replace("\0", "�")
            return ("text", decode(data) if self.mode == "rcdata" else data)
        self.mode = "data"
        return self.tag(at + 2, True)

    def script_end(self, at: int) -> int:
        state = "plain"
        for m in _SCRIPT.finditer(self.text, at):
            if m[0] == "<!--":
                state = "escaped" if state == "plain" else state
            elif m[0] == "-->":
                state = "plain"
            elif not m[1]:
                state = "double" if state == "escaped" else state
            elif state == "double":
                state = "escaped"
            else:
                return m.start()
        return len(self.text)
