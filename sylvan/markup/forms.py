"""Pages alike but for their values: one tree, filled with the attribute values and texts of each in turn.

A page's form is its source without the attribute values in double quotes and without the texts that follow a tag
and begin with something other than white space. Where a form is parsed with marks in their stead and each mark
comes back once, as a whole value or text, any other values and texts lead to the same tree: none holds what could
end it (quotes, `<`, references, nulls, carriage returns), and the rules look at no more of them than that a text
isn't blank, but for elements of TELLING. Pages that aren't so are parsed each by itself.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Sequence
from functools import cached_property
from operator import itemgetter

from sylvan.css import match
from sylvan.markup.dom import HTML, Document, Node
from sylvan.markup.serialize import escape, is_raw, to_html
from sylvan.markup.treebuilder import FORMATTING, parse_document, parse_fragment

#: Elements whose attribute values the rules of parsing look at.
TELLING = FORMATTING | {"input"}
#: Bounds of what a worker keeps, and the pages after which forms that seldom come again are given up.
MOST, MOST_SEEN, LONGEST, TRIED = 4096, 1 << 16, 1 << 14, 1000
#: Nodes, cells and parts of keys that a worker keeps of what it found.
MOST_KEPT = 1 << 20
#: Of one form, things found after which it is given up to keep them if they serve fewer than two pages each.
MOST_ONCE = 256

_TEXT = re.compile(r">([^<\s][^<]*)")
_HOLE = "\1"
#: What stands for a value: no page has it.
_OWN = f"x{os.urandom(12).hex()}"
_MARK = re.compile(f"{_OWN}([at])([0-9]+)")
#: What isn't written as it is.
_SPECIAL = re.compile("[<>&\xa0\"]")


class Stage:
    """An edit of a document: what finds its targets and sources, and what changes them.

    tests: what it asks of values to find them (see match.tests); telling: it looks at the classes of its targets.
    """

    def __init__(self, find: Callable[[Document], tuple], change: Callable[[Document, list[Node], list[Node]], None], tests: frozenset | None = None, telling: bool = False):
        self.find, self.change, self.tests, self.telling = find, change, tests if not telling else None, telling

    def seen(self, doc: Document) -> tuple:
        """All that this edit goes by in a tree: the ids of its targets and sources, and the targets' classes where it looks at those."""
        targets, sources = self.find(doc)
        return tuple([n.id for n in targets]), tuple([n.id for n in sources]), tuple([n.attr("class") for n in targets]) if self.telling else ()


class Judge(dict):
    """What tests say of a value, as bits."""

    def __init__(self, tests: list[Callable[[str], bool]]):
        self.tests = tests

    def __missing__(self, value: str) -> int:
        if len(self) >= MOST_SEEN:
            self.clear()
        out = self[value] = sum(1 << i for i, test in enumerate(self.tests) if test(value))
        return out


def picked(places: Sequence[int]) -> Callable[[list], Sequence]:
    """What gives the values at these places."""
    if len(places) == 1:
        at = places[0]
        return lambda values: (values[at],)
    return itemgetter(*places) if places else lambda values: ()


class Kept:
    """What was found in a form, by what tests say of the values of a page; without tests it is found anew for each page."""

    def __init__(self, form: Form, tests: frozenset | None, owner: object):
        self.form, self.owner = form, owner  # owner: what has the id that this is kept by
        self.judges = form.judges(tests) if tests is not None else None
        self.found: dict[tuple, object] = {}
        self.tried = self.made = 0

    def get(self, make: Callable[[], object], size: Callable[[object], int] = len):
        form = self.form
        if self.judges is None:
            form.fill()
            return make()
        attrs = form.values[0]
        self.tried += 1
        if len(self.judges) == 1:
            judge, own = self.judges[0]
            key = tuple(map(judge.__getitem__, own(attrs)))
        else:
            key = tuple([judge[v] for judge, own in self.judges for v in own(attrs)])
        found = self.found.get(key)
        if found is None:
            form.fill()
            found = make()
            self.made += 1
            if self.made > MOST_ONCE and self.made * 2 > self.tried:
                self.judges, self.found = None, {}
                return found
            cost = len(key) + size(found) + 8
            if cost <= form.left[0]:
                form.left[0] -= cost
                self.found[key] = found
        return found


class Form:
    """The tree of a form, and where in it values go. after: the forms that edits make of it, by what they see.

    left: how much more may be kept, by all forms together.
    """

    def __init__(self, doc: Document, n_attrs: int, n_texts: int, once: bool, left: list[int]):
        self.doc, self.n_attrs, self.n_texts, self.left = doc, n_attrs, n_texts, left
        self.stale = False
        self.usable = self.find(once)
        self.after: dict[tuple, Form] = {}
        doc.kept, doc.trees, doc.form = {}, {}, self

    @classmethod
    def of(cls, key: str, make: Callable[[str], Document], left: list[int]) -> Form:
        n_attrs, n_texts = key.count('"'), key.count(_HOLE)
        quotes, holes = iter(range(n_attrs)), iter(range(n_texts))
        marked = re.sub(f'"|{_HOLE}', lambda m: f'"{_OWN}a{next(quotes)}"' if m[0] == '"' else f"{_OWN}t{next(holes)}", key)
        return cls(make(marked), n_attrs, n_texts, True, left)

    def find(self, once: bool) -> bool:
        """Whether each mark is a whole value or text (once, or at all), in which case attrs and texts say where."""
        self.attrs: list[tuple[list, int]] = []
        self.texts: list[tuple[Node, int]] = []
        for n in self.doc.root.walk():
            if n.template is not None:
                return False
            if n.text is not None and _OWN in n.text:
                m = _MARK.fullmatch(n.text)
                if m is None or m[1] != "t" or n.kind != "text":
                    return False
                self.texts.append((n, int(m[2])))
            for a in n.attrs:
                if _OWN in a[3]:
                    m = _MARK.fullmatch(a[3])
                    if m is None or m[1] != "a" or once and (n.ns != HTML or n.tag in TELLING):
                        return False
                    self.attrs.append((a, int(m[2])))
        return not once or sorted(k for _, k in self.attrs) == list(range(self.n_attrs)) and sorted(k for _, k in self.texts) == list(range(self.n_texts))

    @cached_property
    def recipe(self) -> list[tuple]:
        """The nodes in document order, as what a copy needs."""
        at, out = {}, []
        attr_of, text_of = {id(a): k for a, k in self.attrs}, {id(n): k for n, k in self.texts}
        for i, n in enumerate(self.doc.root.walk()):
            at[id(n)] = i
            out.append((n, at[id(n.parent)] if n.parent is not None else None, text_of.get(id(n)), [(a, attr_of.get(id(a))) for a in n.attrs]))
        return out

    def taking(self, attrs: list[str], texts: list[str]) -> Document:
        """The tree, for a page of these values; until the next ones. They stand in it after fill()."""
        self.values, self.stale = (attrs, texts), True
        return self.doc

    def fill(self) -> None:
        if self.stale:
            self.put(*self.values)
            self.stale = False

    def put(self, attrs: Sequence[str], texts: Sequence[str]) -> None:
        for a, k in self.attrs:
            a[3] = attrs[k]
        for n, k in self.texts:
            n.text = texts[k]
        for tree in self.doc.trees.values():
            tree.forget()

    def mark(self) -> None:
        """Marks for values, until they are filled in again."""
        self.put([f"{_OWN}a{k}" for k in range(self.n_attrs)], [f"{_OWN}t{k}" for k in range(self.n_texts)])
        self.stale = True

    def judges(self, tests: frozenset) -> list[tuple[Judge, Callable]]:
        """Judges of attribute values that the tests ask for, and what gives those."""
        at, by = {id(a): k for a, k in self.attrs}, {}
        for n in self.doc.root.walk():
            for a in n.attrs:
                if id(a) in at and any(match.about(t, n, a) for t in tests):
                    by.setdefault((n.ns, a[0], a[2]), (n, a, []))[2].append(at[id(a)])
        return [(Judge([f for t in tests if (f := match.about(t, n, a))]), picked(own)) for n, a, own in by.values()]

    def kept(self, owner: object, tests: frozenset | None) -> Kept:
        """What is kept under the id of owner. tests: what it goes by, the same at each call."""
        own = self.doc.kept.get(id(owner))
        if own is None:
            own = self.doc.kept[id(owner)] = Kept(self, tests, owner)
        return own

    def rows(self, columns: list[list], find: Callable[[Document], list[Node]], work: Callable[[list[Node], Document], list[tuple]], tests: frozenset | None) -> int:
        """Adds to the columns the rows that work makes of what find finds, and gives their number. work hands values on as they are."""
        kept = self.kept(work, tests)
        n, held, constants = kept.get(lambda: self.template(find, work), lambda t: t[0] * len(columns)) if kept.judges is not None else (1, None, [])
        if held is None:
            self.fill()
            own = work(find(self.doc), self.doc)
            for out, new in zip(columns, zip(*own, strict=True), strict=bool(own)):
                out += new
            return len(own)
        if not n:
            return 0
        values = [*self.values[0], *self.values[1], *constants]
        for out, (given, gets, joins) in zip(columns, held, strict=True):
            out += given if given is not None else gets(values) if gets is not None else ["".join([values[k] for k in own]) if own.__class__ is list else values[own] for own in joins]
        return n

    def template(self, find: Callable, work: Callable) -> tuple:
        """The number of rows and their columns: cells that are the same for each page, or the places of values; None if there are others."""
        found = find(self.doc)
        self.mark()
        own, first, constants, held = work(found, self.doc), self.n_attrs + self.n_texts, [], []
        self.fill()
        for cells in zip(*own, strict=True):
            if any(c.__class__ not in (int, bool, str, type(None)) for c in cells):
                return len(own), None, []
            if not any(c.__class__ is str and _OWN in c for c in cells):
                held.append((list(cells), None, None))
                continue
            places: list = []
            for c in cells:
                parts = _MARK.split(c) if c.__class__ is str else [c]
                at = []
                for i, part in enumerate(parts):
                    if i % 3 == 0 and (part or len(parts) == 1):
                        constants.append(part)
                        at.append(first + len(constants) - 1)
                    elif i % 3 == 2:
                        at.append(int(part) + (self.n_attrs if parts[i - 1] == "t" else 0))
                places.append(at if len(at) > 1 else at[0])
            whole = not any(p.__class__ is list for p in places)
            held.append((None, picked(places) if whole else None, None if whole else places))
        return len(own), held, constants

    def copy(self, attrs: list[str], texts: list[str]) -> Document:
        """A tree of its own with the values of a page."""
        made: list[Node] = []
        for n, up, text, own in self.recipe:
            new = Node(n.id, n.kind, n.tag, n.ns, [[a[0], a[1], a[2], a[3] if k is None else attrs[k]] for a, k in own] if own else None, n.text if text is None else texts[text])
            new.target, new.public, new.system, new.math_ip = n.target, n.public, n.system, n.math_ip
            if up is not None:
                new.parent = made[up]
                made[up].children.append(new)
            made.append(new)
        doc = Document(made[0])
        doc.errors, doc.quirks, doc.size = self.doc.errors[:], self.doc.quirks, self.doc.size
        return doc

    def edited(self, stage: Stage, seen: tuple) -> Form:
        """The form that an edit makes of this one where it sees that."""
        doc = self.copy([f"{_OWN}a{k}" for k in range(self.n_attrs)], [f"{_OWN}t{k}" for k in range(self.n_texts)])
        by_id = {n.id: n for n in doc.root.walk()}
        targets, sources = ([by_id[i] for i in own] for own in seen[:2])
        for n, value in zip(targets, seen[2], strict=False):
            for a in [a for a in n.attrs if a[2] == "class"][:1]:
                a[3] = value
        stage.change(doc, targets, sources)
        return Form(doc, self.n_attrs, self.n_texts, False, self.left)

    def html(self, node: Node, inner: bool) -> str:
        """As to_html, of the tree with its present values: what lies between those is written once."""
        kept = self.doc.kept
        if (id(node), inner) not in kept:
            kept[id(node), inner] = self.pieces(node, inner)
        (pieces, attr_at, text_at, raw_at), between, own = kept[id(node), inner]
        attrs, texts = self.values
        values = attrs + texts
        if not _SPECIAL.search("".join(values)):
            return between % own(values)
        out = pieces[:]
        for i, k in attr_at:
            out[i] = escape(attrs[k]).replace('"', "&quot;")
        for i, k in text_at:
            out[i] = escape(texts[k])
        for i, k in raw_at:
            out[i] = texts[k]
        return "".join(out)

    def pieces(self, node: Node, inner: bool) -> tuple:
        """What to_html gives, cut where values stand, and the places and numbers of attribute values, texts and texts written as they are.

        Then the same as a format, and what gives the values that go into it.
        """
        for i, (a, _) in enumerate(self.attrs):
            a[3] = f"{_OWN}a{i}"
        for i, (n, _) in enumerate(self.texts):
            n.text = f"{_OWN}t{i}"
        parts = _MARK.split(to_html(node, inner))
        self.stale = True
        pieces, attr_at, text_at, raw_at = [parts[0]], [], [], []
        for kind, i, rest in zip(parts[1::3], parts[2::3], parts[3::3], strict=True):
            held, k = (self.attrs if kind == "a" else self.texts)[int(i)]
            (attr_at if kind == "a" else raw_at if is_raw(held) else text_at).append((len(pieces), k))
            pieces += ["", rest]
        places = dict([*attr_at, *((i, k + self.n_attrs) for i, k in text_at + raw_at)])
        between = "".join("%s" if i in places else piece.replace("%", "%%") for i, piece in enumerate(pieces))
        own = picked([places[i] for i in sorted(places)])
        return (pieces, attr_at, text_at, raw_at), between, own


class Forms:
    """Parses pages and carries out a change on each, whose stages may be known.

    A document is good until the next is read. `spent` has those that were made for one page. lazy: a document's
    values are only in it after its form's fill().
    """

    def __init__(self, fragment: bool, change: Callable[[Document], None] | None = None, stages: Sequence[Stage] | None = None, lazy: bool = False):
        self.lazy, self.left = lazy, [MOST_KEPT]
        self.make = parse_fragment if fragment else parse_document
        self.change, self.stages = change, stages if change is not None else ()
        self.known: dict[str, Form] = {}
        self.seen: set[int] = set()
        self.tried = self.met = self.made = 0
        self.spent: list[Document] = []

    def read(self, html: str | None) -> Document:
        doc = self.formed(html) if html and self.met * 8 >= self.tried - TRIED else None
        if doc is None:
            doc = self.make(html)
        elif doc.kept is not None:
            if not self.lazy:
                doc.form.fill()
            return doc
        if self.change is not None:
            self.change(doc)
        self.spent.append(doc)
        return doc

    def formed(self, html: str) -> Document | None:
        """The page by its form, if there is one; a form is made when it comes a second time.

        Changed already where the tree serves other pages too.
        """
        self.tried += 1
        if len(html) > LONGEST or "&" in html or "\0" in html or "\r" in html:
            return None
        parts = html.split('"')
        rest = _TEXT.split('"'.join(parts[::2]))
        attrs, texts = parts[1::2], rest[1::2]
        key = f">{_HOLE}".join(rest[::2])
        form = self.known.get(key)
        if form is None:
            own = hash(key)
            if own not in self.seen or self.made >= MOST:
                if len(self.seen) < MOST_SEEN:
                    self.seen.add(own)
                return None
            self.made += 1
            form = self.known[key] = Form.of(key, self.make, self.left)
        if not form.usable or len(attrs) != form.n_attrs or len(texts) != form.n_texts:
            return None
        self.met += 1
        if self.stages is None:
            return form.copy(attrs, texts)
        last = form
        for stage in self.stages:
            doc = last.taking(attrs, texts)
            seen = last.kept(stage, stage.tests).get(lambda: stage.seen(doc), lambda seen: sum(map(len, seen)))  # noqa: B023
            after = last.after.get(seen)
            if after is None:
                if self.made >= MOST:
                    return form.copy(attrs, texts)
                self.made += 1
                after = last.after[seen] = last.edited(stage, seen)
            if not after.usable:
                return form.copy(attrs, texts)
            last = after
        return last.taking(attrs, texts)
