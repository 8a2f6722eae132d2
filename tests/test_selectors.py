import pytest

from sylvan.css import mini
from sylvan.css.match import select
from sylvan.css.parser import SelectorError, parse, to_css
from sylvan.markup.treebuilder import parse_document
from sylvan.operators.frame import Nodes
from sylvan.sources.pages import extract

PAGE = """<!DOCTYPE html><html lang=EN><head><title>t</title></head><body class="a b"><div id=x class="B  a"><p>one <b>two</b></p><p class=k data-v="1-2 x">
</p><ul><li>1<li class=k>2<li>3<li><a href=u>4</a></ul></div><div><p>five</p><!-- c --><span></span><input disabled type=TEXT></div>
<svg><linearGradient id=g /><a href=v>s</a></svg><template><p>hidden</p></template></body></html>"""
PAGES = [PAGE, "", "<p>x", "<ul><li><ul><li><b>deep</b></ul><li></ul>", "<div><div><p>a</p><div><p>b</p></div></div></div>", None]

SELECTORS = """* | p | DIV | #x | .a | .a.b | .A | [href] | [class~=a] | [data-v|="1"] | [lang=en] | [type=text] | [class="B  a"] | [data-v^="1-"] | [data-v$=x] | [data-v*="2 "]
[data-v*=""] | [data-v="1-2 X" i] | div p | div > p | p + p | p ~ ul | p ~ ul > li + li | body > * > :first-child | li:nth-child(2) | li:nth-child(odd) | li:nth-child(-n+2)
li:nth-child(2n + 1) | li:nth-last-child(n+3) | :nth-of-type(2) | :nth-last-of-type(1) | :only-child | :only-of-type | :first-of-type:last-of-type | :empty | :only-text | :any-link
:link | :root | :root > html | * > html | :scope > * | p:not(.k) | :not(div, p, li) | p:not(div > p) | :is(p, li).k | :where(ul) li | :is(div > p, ul > li):not(:last-child) | div:has(b)
div:has(> p.k) | p:has(+ ul) | p:has(~ ul a) | div:has(ul > li + li) | body:has(div div) | :has(:is(b, a)) | div:has(p, span) | li:has-text("2") | div:contains("one two") | p:contains("two")
p:has-text("one two") | p:hover | :checked, b | linearGradient | lineargradient | svg a | *|a | |a | p, p, b | .\\62 | #\\78 | div:not(:has(b)) | :is() | :is(::x, b) | li:NTH-CHILD(1)"""
ALL = [s.strip() for row in SELECTORS.split("\n") for s in row.split(" | ")]


@pytest.fixture(scope="module")
def tables(spark):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")
    nodes = Nodes.parse(pages)
    nodes.df = nodes.df.cache()
    return pages, nodes


def test_plans_agree_with_the_matcher(tables):
    """Every selector as a plan over the node table against the tree matcher."""
    _, nodes = tables
    trees = [parse_document(h) for h in PAGES]
    for selector in ALL:
        want = sorted((d, n.id) for d, tree in enumerate(trees) for n in select([tree.root], selector))
        got = sorted((r.doc_id, r.node_id) for r in nodes.plan().select(selector).select("doc_id", "node_id").collect())
        assert got == want, selector


@pytest.mark.parametrize(
    ("selector", "texts"),
    [
        ("div > p", ["one two", "\n", "five"]),
        ("li:nth-child(2n+1)", ["1", "3"]),
        ("li.k ~ li", ["3", "4"]),
        ("div:has(> span) p", ["five"]),
        (":root > html > head > title", ["t"]),
        ("p:has-text('one two')", []),
        ("p:contains('one two')", ["one two"]),
        ("[type=text]", [""]),
        ("p:empty", ["\n"]),
    ],
)
def test_known_answers(selector, texts):
    assert [n.string() for n in select([parse_document(PAGE).root], selector)] == texts


@pytest.mark.parametrize("bad", ["", " ", "> a", "a >", "a,,b", "a,", ":required", "a:lang(en)", "a::before", "[a", "[a=]", "p:contains(x)", ":has(:has(a))", "ns|a", "a b)", ":nth-child(2 of p)", "#1", ".", ":not(", ":unknown"])
def test_errors(bad):
    with pytest.raises(SelectorError):
        parse(bad)


def test_restricted_engine(tables):
    pages, nodes = tables
    for path in ["div p", "div > p.k", "li + li", "ul li ~ li", "body div p b", "div#x", "a[href]", "p[data-v|=1]", "p[data-v~='x']", "li:hover", "div ul li a[href=u]", "", "p[data-v*=2] + ul > li.k"]:
        want = sorted((d, n.id) for d, h in enumerate(PAGES) for n in mini.find_descendants(parse_document(h).root, path))
        if path:
            assert sorted((r.doc_id, r.node_id) for r in nodes.find_descendants(path).rows.collect()) == want, path
        assert sorted((r.doc_id, r.node_id) for r in extract(pages, path, [], engine="mini").collect()) == want, path
    for names in (["div", "p"], ["ul", "li", "b"], ["div", "div", "p"], ["body", "b"]):
        want = sorted((d, n.id) for d, h in enumerate(PAGES) for n in mini.find(parse_document(h).root, names))
        assert sorted((r.doc_id, r.node_id) for r in nodes.find(names).rows.collect()) == want, names


def test_restricted_grammar():
    assert mini.parse_one("> a.b.c[d = 'e']") == mini.Mini(">", "a", None, ("b", "c"), (("d", "=", "e"),))
    assert [s.tag for s in mini.parse_path("div  a:hover b")] == ["div", "a"]
    assert mini.parse_one("a[b=]").attrs == ()
    with pytest.raises(SelectorError):
        mini.parse_one("*")
    node = select([parse_document("<i k=''></i>").root], "i")[0]
    assert mini.matches(node, mini.parse_one("i[k]")) and not mini.matches(node, mini.parse_one("[k^=a]"))


def test_text_of_a_selector_parses_to_the_same():
    for selector in [*ALL, r"a\.b#\31 x", r'[a="q\"\\"]', "div:has(> a, + b c)", r"""a:contains('x"y')"""]:
        assert parse(to_css(parse(selector))) == parse(selector), selector
