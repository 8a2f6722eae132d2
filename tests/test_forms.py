"""Pages alike but for their values share a tree, and are read as if each were parsed by itself."""

import random

import pytest

from sylvan.css.parser import parse
from sylvan.markup import forms
from sylvan.markup.serialize import to_html
from sylvan.markup.treebuilder import parse_document, parse_fragment
from sylvan.operators import frame
from sylvan.operators.frame import asked, carried_out, everything, follow, stage
from sylvan.schema import rows_of
from sylvan.sources.pages import written

TAGS = "div p ul li b i a table tr td template svg math annotation-xml title textarea script style select option input form pre html body head frameset colgroup button span h1 comment".split()
VALUES = ["x", "", "a b", "k", "R", "hidden", "text/html", "a>b", "a<b", "-->", "'", "=", " x ", "é\xa0", "a\nb", "<b>", "t0", "\1"]
TEXTS = ["x", "a b", " a", "\n", "\nx", "x\n", "a>b", "-->", 'say "x"', 'a"b', "\xa0", "﻿", "&amp;", "a&b", "\0", "x\r\ny", "]]>", "'", "\1", ""]


def shape(rng: random.Random) -> list:
    """A page with holes: (attribute) and (text) where values go."""
    out = ["<!doctype html>"] if rng.random() < 0.3 else []
    for _ in range(rng.randint(1, 9)):
        tag = rng.choice(TAGS)
        kind = rng.random()
        if tag == "comment":
            out += ["<!--", None, "-->"]
        elif kind < 0.6:
            out.append(f"<{tag}")
            for name in rng.sample(["class", "id", "type", "encoding", "href", "a'"], rng.choice([0, 0, 1, 2])):
                out += [f' {name}="', 0, '"'] if rng.random() < 0.9 else [f" {name}='", 0, "'"]
            out.append(">")
        else:
            out.append(f"</{tag}>")
        if rng.random() < 0.5:
            out.append(None)
    return out


def page(rng: random.Random, form: list) -> str:
    tame = rng.random() < 0.6
    return "".join(rng.choice(VALUES[:9] if tame else VALUES) if x == 0 else rng.choice(TEXTS[:2] if tame else TEXTS) if x is None else x for x in form)


def whole(doc) -> tuple:
    return [(r, n.parent.id if n.parent is not None else None) for r, n in zip(sorted(rows_of(doc), key=lambda r: r[0]), sorted(everything(doc), key=lambda n: n.id), strict=True)], doc.errors, doc.quirks, doc.size


@pytest.mark.parametrize("fragment", [False, True])
def test_pages_read_by_their_form_are_as_parsed(fragment):
    rng, make, met = random.Random(7), parse_fragment if fragment else parse_document, 0
    for _ in range(1500):
        reader, copies, form = forms.Forms(fragment), forms.Forms(fragment, lambda doc: None), shape(rng)
        for _ in range(6):
            html = page(rng, form)
            want = whole(make(html))
            assert whole(reader.read(html)) == want, html
            assert whole(copies.read(html)) == want, html
        met += reader.met
    assert met > 1500


SELECTORS = ["li.R", "li:nth-child(2n)", "[class]:not(.k)", "ul > :has(b)", "li:contains('a')", "li:empty, p:only-text", "*:is(.R, #k):where(:first-child)", "p ~ li[id*='a']", "li:not(:last-of-type)"]


def lists(rng: random.Random) -> str:
    items = "".join(f'<li class="{rng.choice(["R", "k", "R k", ""])}" id="{rng.choice("ka")}">{rng.choice(["a", "b c", "<b>a</b>"])}</li>' for _ in range(rng.randint(0, 3)))
    return f'<div id="{rng.random()}"><p class="{rng.choice("Rk")}">t</p><ul>{items}</ul></div>'


@pytest.mark.parametrize("selector", SELECTORS)
def test_selectors_see_the_values_of_each_page(selector):
    rng, reader, route = random.Random(3), forms.Forms(False), (("select", parse(selector)),)
    for _ in range(300):
        html = lists(rng)
        assert [n.id for n in follow(reader.read(html), route)] == [n.id for n in follow(parse_document(html), route)], html
    assert reader.met > 150


EDITS = [("ul", "wrap_html", ("<b>x</b>",)), ("li.R", "remove", ()), ("li", "set_attr", ("id", "new")), ("li", "set_text", ("x",)), ("li", "add_class", ("R new",)), ("li:first-child", "remove_class", ("R",)), ("body", "strip_elements", ("li", "b")), ("ul", "replace_with_html", ("",))]


@pytest.mark.parametrize("selector, verb, args", EDITS)
def test_edits_see_the_values_of_each_page(selector, verb, args):
    route = (("select", parse(selector)),)
    steps = ((route, verb, args, None), ((("select", parse("div")),), "normalize", (), None))
    end, shared = (("select", parse("li, b, [class=R]")),), 0
    rng, reader = random.Random(5), forms.Forms(False, lambda doc: carried_out(doc, steps), [stage(*step) for step in steps])
    for _ in range(200):
        html = lists(rng)
        want = parse_document(html)
        carried_out(want, steps)
        got = reader.read(html)
        assert to_html(got.root) == to_html(want.root) and got.size == want.size, html
        assert [n.id for n in follow(got, end)] == [n.id for n in follow(want, end)], html
        assert all(written(o, n, got) == to_html(m, o == "inner_html") for o in ("html", "inner_html") for n, m in zip(everything(got), everything(want), strict=True))
        shared += got.form is not None
    assert reader.met > 100 and shared > 50


@pytest.mark.parametrize("verb", ["prepend_selection", "before_selection", "append_run", "reparent_children"])
def test_moves_see_the_values_of_each_page(verb):
    steps = (((("select", parse("ul")),), verb, (), (("select", parse("li.R")),)),)
    rng, reader, shared = random.Random(9), forms.Forms(False, lambda doc: carried_out(doc, steps), [stage(*step) for step in steps]), 0
    for _ in range(200):
        html = lists(rng)
        want = parse_document(html)
        carried_out(want, steps)
        got = reader.read(html)
        assert whole(got) == whole(want), html
        shared += got.form is not None
    assert shared > 50


def members(found: list, _) -> list[tuple]:
    return [(i, n.id, n.attr("class"), n.string(), n.attr("id"), len(n.children), n.tag) for i, n in enumerate(found, 1)]


@pytest.mark.parametrize("selector", [*SELECTORS, "li[id]", "li.R, [id=a i]", "*", "li:is(.R, #k):not([class$='k'])", "b"])
def test_rows_hand_on_the_values_of_each_page(selector):
    route = (("select", parse(selector)), ("add", (("select", parse("p.k")),), True))
    rng, reader, given = random.Random(4), forms.Forms(False, lazy=True), 0
    for _ in range(400):
        html = lists(rng).replace("b c", rng.choice(["b c", "100 %s", "x > y", "\xa0"]))
        doc, columns = reader.read(html), [[] for _ in range(7)]
        if doc.form is not None:
            n = doc.form.rows(columns, lambda d: follow(d, route), members, asked(route))
            want = members(follow(parse_document(html), route), None)
            assert n == len(want) and list(zip(*columns, strict=True)) == want, html
            given += 1
    assert given > 150


def test_rows_of_other_cells_are_read_from_each_page():
    work, reader = (lambda found, _: [(len(n.string()), [n.attr("class")]) for n in found]), forms.Forms(False, lazy=True)
    for i in range(50):
        doc, columns = reader.read(f'<p class="c{i}">{"x" * i}y</p>'), [[], []]
        if i > 2:
            assert doc.form.rows(columns, lambda d: follow(d, (("select", parse("p")),)), work, frozenset()) == 1 and columns == [[i + 1], [[f"c{i}"]]]


def test_what_a_selector_leads_to_is_found_once_for_pages_of_which_it_asks_the_same(monkeypatch):
    """Each page's values were looked at by the selector anew, and its rows made anew."""
    calls, walk = [], frame.walked
    monkeypatch.setattr(frame, "walked", lambda doc, route: calls.append(route) or walk(doc, route))
    reader = forms.Forms(False)
    for selector in ("li.R", "li:not(.N)", "[id]", "li[id*='7'], li:is(.R, .A):first-child"):
        route = (("select", parse(selector)),)
        for i in range(500):
            html = f'<ul><li class="{"RNA"[i % 3]}" id="k{i}">{i}</li><li class="{"RNA"[i // 3 % 3]}" id="m{i}">{i}</li></ul>'
            assert [n.id for n in follow(reader.read(html), route)] == [n.id for n in walk(parse_document(html), route)]
    assert len(calls) < 60


def test_what_seldom_comes_again_is_not_kept():
    reader, route = forms.Forms(False), (("select", parse(", ".join(f".c{i}" for i in range(2000)))),)
    for i in range(2000):
        doc = reader.read(f'<p class="c{i}">x</p>')
        assert [n.tag for n in follow(doc, route)] == ["p"]
    assert doc.form.kept(route, asked(route)).judges is None and reader.left[0] > 0


def test_a_form_is_parsed_once(monkeypatch):
    """Each page was parsed by itself, which took more time than all else."""
    calls = []
    monkeypatch.setattr(forms, "parse_document", lambda html: calls.append(html) or parse_document(html))
    reader = forms.Forms(False)
    texts = [reader.read(f'<div id="o{i}"><ul><li class="c{i}">part {i}</li></ul></div>').root.string() for i in range(500)]
    assert texts == [f"part {i}" for i in range(500)] and len(calls) <= 2


def test_pages_of_no_common_form_are_left_alone():
    reader = forms.Forms(False)
    for i in range(3000):
        reader.read(f"<p a{i}>")
    assert reader.met == 0 and reader.tried <= forms.TRIED + 1 and not reader.known
