import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sylvan.markup.serialize import to_html
from sylvan.markup.tokenizer import decode
from sylvan.markup.treebuilder import parse_document, parse_fragment


def body(html):
    return to_html(parse_fragment(html).root.children[0], True)


@pytest.mark.parametrize(
    ("html", "out"),
    [
        ("", ""),
        ("<b x=1", ""),
        ("<p><em>One!</p>, two!</em>", "<p><em>One!</em></p><em>, two!</em>"),
        ("<link rel=a&lt;b>", '<link rel="a&lt;b">'),
        ('<i a="1" A=2 b>x', '<i a="1" b="">x</i>'),
        ("<q t='say \"x\"'>", '<q t="say &quot;x&quot;"></q>'),
        ("a &lt;&gt;&amp; &ampx &notit; &#65;&#x42; &nosuch; \xa0", "a &lt;&gt;&amp; &amp;x ¬it; AB &amp;nosuch; &nbsp;"),
        ("<a href='?a=1&copy=2&amp'>", '<a href="?a=1&amp;copy=2&amp;"></a>'),
        ("<script>if (a < b && c) '</p>'</script>", "<script>if (a < b && c) '</p>'</script>"),
        ("<script><!-- <script>x</script> --></script>y", "<script><!-- <script>x</script> --></script>y"),
        ("<textarea>\n\n<b>&lt;</textarea>", "<textarea>\n&lt;b&gt;&lt;</textarea>"),
        ("<pre>\nx</pre><listing>\n\ny</listing>", "<pre>x</pre><listing>\ny</listing>"),
        ("x<!--a-->y<!-->z<!d>", "x<!--a-->y<!---->z<!--d-->"),
        ("<b>1<p>2</b>3</p>4", "<b>1</b><p><b>2</b>3</p>4"),
        ("<a>1<div>2<a>3", "<a>1</a><div><a>2</a><a>3</a></div>"),
        ("<b><b><b><b>x<p>y", "<b><b><b><b>x<p>y</p></b></b></b></b>"),
        ("<p><b><b><b><b>x</p>y", "<p><b><b><b><b>x</b></b></b></b></p><b><b><b>y</b></b></b>"),
        ("<ul><li>a<li>b<ul><li>c</ul>d</ul>", "<ul><li>a</li><li>b<ul><li>c</li></ul>d</li></ul>"),
        ("<dl><dt>a<dd>b<dt>c</dl>", "<dl><dt>a</dt><dd>b</dd><dt>c</dt></dl>"),
        ("</p>a</br>b</x>", "<p></p>a<br>b"),
        ("<h1>a<h2>b</h1>c", "<h1>a</h1><h2>b</h2>c"),
        ("<table>x<tr><td>a<td>b<tr><th>c</table>", "x<table><tbody><tr><td>a</td><td>b</td></tr><tr><th>c</th></tr></tbody></table>"),
        ("<table><caption>c<td>x", "<table><caption>c</caption><tbody><tr><td>x</td></tr></tbody></table>"),
        ("<table><col><tr><td><table><td>i</table>o</table>", "<table><colgroup><col></colgroup><tbody><tr><td><table><tbody><tr><td>i</td></tr></tbody></table>o</td></tr></tbody></table>"),
        ("<select><option>a<optgroup><option>b<div>c</select>d", "<select><option>a</option><optgroup><option>bc</option></optgroup></select>d"),
        ("<template><tr><td>x</template>y", "<template><tr><td>x</td></tr></template>y"),
        ("<svg viewbox=0 xlink:href=a><lineargradient/><p>x", '<svg viewBox="0" xlink:href="a"><linearGradient></linearGradient></svg><p>x</p>'),
        ("<svg><foreignobject><p>a</p></foreignobject><![CDATA[<b>]]></svg>", "<svg><foreignObject><p>a</p></foreignObject>&lt;b&gt;</svg>"),
        ("<math><annotation-xml encoding=text/html><p>a</p></annotation-xml><mi>x", '<math><annotation-xml encoding="text/html"><p>a</p></annotation-xml><mi>x</mi></math>'),
        ("<button>a<button>b", "<button>a</button><button>b</button>"),
        ("<form>a<form>b</form>c", "<form>ab</form>c"),
        ("<ruby>a<rt>b<rp>c</ruby>", "<ruby>a<rt>b</rt><rp>c</rp></ruby>"),
        ("<nobr>a<nobr>b", "<nobr>a</nobr><nobr>b</nobr>"),
        ("a\0b<i\0>", "ab<i�></i�>"),
        ("<plaintext><b>", "<plaintext><b></plaintext>"),
    ],
)
def test_fragments(html, out):
    assert body(html) == out


@pytest.mark.parametrize(
    ("html", "out", "quirks"),
    [
        ("", "<html><head></head><body></body></html>", "quirks"),
        ("<!doctype HTML><title>a</title>\n<p>b", "<!DOCTYPE html><html><head><title>a</title>\n</head><body><p>b</p></body></html>", "no-quirks"),
        (" <html a=1> <body b=2>x<html a=3 c=4><body b=5 d=6>", '<html a="1" c="4"><head></head><body b="2" d="6">x</body></html>', "quirks"),
        ("<head></head> <body>x</body></html> y<!--z-->", "<html><head></head> <body>x y<!--z--></body></html>", "quirks"),
        ("<frameset><frame></frameset>", "<html><head></head><frameset><frame></frameset></html>", "quirks"),
        ('<!DOCTYPE html PUBLIC "-//W3C//DTD XHTML 1.0 Transitional//EN" "x"><p>', "<!DOCTYPE html><html><head></head><body><p></p></body></html>", "limited-quirks"),
        ("<noscript><p>x</noscript>", "<html><head><noscript></noscript></head><body><p>x</p></body></html>", "quirks"),
        ("<p>a<table><td>b", "<html><head></head><body><p>a<table><tbody><tr><td>b</td></tr></tbody></table></p></body></html>", "quirks"),
    ],
)
def test_documents(html, out, quirks):
    doc = parse_document(html)
    assert (to_html(doc.root), doc.quirks) == (out, quirks)


def test_ids_and_roots():
    doc = parse_fragment("<b>x")
    top = doc.root.children[0]
    assert (doc.root.kind, doc.root.id, top.tag, top.id, top.children[0].id) == ("fragment", 0, "html", 2, 3)
    assert parse_document(None).root.kind == "document"
    template = parse_document("<template>x").root.children[0].children[0].children[0]
    assert template.template.id == template.id + 1 and template.children == []


def test_references():
    assert decode("&#128;&#0;&#xD800;&#x110000;&amp;amp;&") == "€���&amp;&"
    assert decode("&amp=&ampa&amp", True) == "&amp=&ampa&"


TAGS = st.sampled_from("p b i a div ul li table tr td h1 br span select option svg math template pre script title".split())
SOUP = st.lists(st.one_of(TAGS.map("<{}>".format), TAGS.map("</{}>".format), st.sampled_from(["x", " ", "\n", "&amp;", "<", "&lt;b", "<!--c-->", '<a href="?x&y">'])), max_size=25).map("".join)


@settings(max_examples=300, deadline=None)
@given(SOUP)
def test_trees_are_sound(html):
    doc = parse_document(html)
    seen = set()
    for n in doc.root.walk():
        assert id(n) not in seen
        seen.add(id(n))
        assert all(c.parent is n for c in n.children)
    out = to_html(doc.root)
    assert isinstance(out, str) and out.startswith("<")


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text_parses(html):
    assert to_html(parse_document(html).root)


def test_deep_nesting():
    html = "<div>" * 20000 + "x"
    assert to_html(parse_document(html).root).count("</div>") == 20000


def test_usual_tokens_are_read_as_by_the_rules(monkeypatch):
    """Runs of plain blocks, list items and text need no dispatch, and give the same trees, ids and errors."""
    import random

    from sylvan.markup.treebuilder import Builder

    def trees(pages):
        out = []
        for page in pages:
            for fragment in (False, True):
                doc = Builder(page, fragment).run()
                out.append(([(n.id, n.kind, n.tag, n.ns, n.attrs, n.text, n.parent and n.parent.id) for n in doc.root.walk()], doc.errors, doc.quirks, doc.size))
        return out

    pick = random.Random(5)
    opens = ["<div>", '<ul class="a b" id="k">', "<li>", '<li a="1" a="2">', "<p>", "<b>", "<h1>", "<table>", "<td>", "<template>", "<svg>", "<pre>", "<a href=x>", "<LI>", "<dd>", "<button>"]
    rest = ["</div>", "</ul>", "</li>", "</p>", "</b>", "</h1>", "</table>", "</template>", "</svg>", '</div a="b">', "x", " ", "\n", "a&amp;b", "&lt", "\0", "<", "<!--c-->", "</body>"]
    pages = ["".join(pick.choice(pick.choice([opens, rest])) for _ in range(20)) for _ in range(1500)]
    order = '<div class="order"><ul>' + '<li class="item">part 1</li>' * 20 + "</ul></div>"
    calls, dispatch = [], Builder.dispatch
    monkeypatch.setattr(Builder, "dispatch", lambda self, token: (calls.append(token), dispatch(self, token))[1])
    fast = trees([*pages, order])
    calls.clear()
    trees([order])
    assert len(calls) <= 6
    monkeypatch.setattr(Builder, "usual", lambda self: None)
    assert trees([*pages, order]) == fast
