"""Queries over small pages that exercise one rule each; their twins are the expected rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.operators.frame import Nodes, matcher
from sylvan.queries import ORACLES, QUERIES, long, query
from sylvan.session import ship
from sylvan.sources.pages import documents, extract, render, rewrite


def quoted(value) -> str:
    return "CAST(NULL AS VARCHAR)" if value is None else "'" + value.replace("'", "''") + "'"


def cases(name: str, rows: Sequence[tuple[str, str | None]], run: Callable[[DataFrame], DataFrame]) -> None:
    """A query over pages (doc_id, html) whose result is doc_id and value as given for each page."""
    twin = "SELECT * FROM (VALUES " + ", ".join(f"({i}, {quoted(v)})" for i, (_, v) in enumerate(rows)) + ") v(doc_id, value)"

    @query(name, twin.replace("(VALUES (0,", "(VALUES (0::BIGINT,"))
    def ask(spark: SparkSession, sf_dir: str) -> DataFrame:
        pages = ship(spark).createDataFrame([(i, html) for i, (html, _) in enumerate(rows)], "page_id long, html string")
        return run(pages).select("doc_id", "value")


def table(pages: DataFrame) -> Nodes:
    return Nodes.parse(pages)


def body(nodes: Nodes) -> DataFrame:
    return nodes.body().inner_html()


# -- Markdown and text, rule by rule --

MARKDOWN = {
    "blocks": [("<h1>One</h1> <h3><span>IV</span> Two</h3><hr>", "# One\n\n### IV Two\n\n---"), ("a<div>b<p>c</p></div>d", "a\n\nb\n\nc\n\nd"), ("<section>x</section><article>y</article>", "x\n\ny")],
    "emphasis": [("<p>so <em>very</em>  <strong><i>odd</i></strong></p>", "so *very* ***odd***"), ("<b>x</b><i>y</i>", "**x***y*")],
    "escapes": [("<p>a*b_c #1 (x) [y] {z} + - . ! | \" < ></p>", 'a\\*b\\_c \\#1 \\(x\\) \\[y\\] \\{z\\} \\+ - \\. \\! \\| \\" \\< \\>'), ("<p>a\\*b</p>", "a\\*b")],
    "spaces": [("<p>  a \n b<b> c</b>d </p>", "a b** c**d"), ("<p>a</p>  <p>b</p>", "a\n\nb")],
    "breaks": [("<p>a<br>b</p>", "a  \nb")],
    "lists": [("<ul><li>a</li><li><b>b</b></li></ul>", "- a\n- **b**"), ("<ol><li>a</li><li>b</li></ol>", "1. a\n1. b"), ("<ul><li>a<ul><li>b</li></ul></li></ul>", "- a\n\n    - b"), ("<ol><li><p>a</p><p>b</p></li></ol>", "1. a\n\n   b")],
    "links": [("<p>see <a href='u' title='t'>it <b>now</b></a></p>", 'see [it now](u "t")'), ("<p>x <a href=u></a>y</p>", "x y"), ("<a>in <i>it</i></a>", "in *it*")],
    "images": [("<p>i <img src=s alt=a title=t><img alt=b></p>", 'i ![a](s "t")')],
    "code_blocks": [("<pre>a\n  b</pre>", "```\na\n  b\n```"), ("<div data-language='c++ x'><pre>a</pre></div>", "```c++\na\n```"), ("<pre><code class='k language-rs'>a</code></pre>", "```rs\na\n```")],
    "code": [("<p>and <code>c`d*</code></p>", "and `c\\`d*`"), ("<code>one\n two</code>", "```\none\n two\n```")],
    "quotes": [("<blockquote><p>a<br>b</p></blockquote><p>c</p>", "> a  \n> b\n\nc"), ("<blockquote></blockquote>", "")],
    "tables": [("<table><tr><th>A</th></tr><tr><td>1</td><td>2</td></tr></table>", "| A |   |\n| - | - |\n| 1 | 2 |"), ("<table><tr><th>h</th></tr></table>", "h")],
    "trims": [("<ul><li></li><li>a</li></ul>", "-\n- a"), ("<p> <a></a> x</p>", "x")],
}
for rule, rows in MARKDOWN.items():
    cases(f"markdown_{rule}", rows, lambda pages: render(pages, "markdown"))
cases("markdown_skip", [("<p>q</p><style>p</style><ul><li>a</li></ul><p>b</p>", "q\n\np\n\nb"), ("<ul>x</ul>", "")], lambda pages: table(pages).body().fold("markdown", skip=["ul"]))
cases("markdown_whole", [("<h2>a</h2>", "\n\n## a\n\n")], lambda pages: table(pages).body().fold("markdown", whole=True))
FORMATTED = [("<div>a<p>b  c</p>d</div>", "a\nb c\n\nd"), ("x<br>y<hr>z", "x\ny\nz"), ("<table><tr><th>a</th><td>b</td></tr><tr><td>c</td></tr></table>", "a b\nc"), ("<pre>a\n   b</pre>", "a\n   b"), ("<b>a</b> <i> b</i>", "a b")]
cases("formatted_rules", FORMATTED, lambda pages: render(pages, "formatted_text"))
cases("formatted_selection", [("<p>a</p>", "a\n\n")], lambda pages: table(pages).select("p").fold("formatted_text_whole"))
cases("char_count_rules", [("<p> a  b<b>\n</b> c</p> ", "5"), ("", "0")], lambda pages: table(pages).body().char_count().withColumn("value", F.col("value").cast("string")))

# -- parsing --

PARSED = [
    ("", "<html><head></head><body></body></html>"), ("<p>a<p>b", "<html><head></head><body><p>a</p><p>b</p></body></html>"), ("<b>a<i>b</b>c</i>", "<html><head></head><body><b>a<i>b</i></b><i>c</i></body></html>"),
    ("<table>x<tr><td>y</table>", "<html><head></head><body>x<table><tbody><tr><td>y</td></tr></tbody></table></body></html>"), ("a&lt;b&amp;c&nbsp;d", "<html><head></head><body>a&lt;b&amp;c&nbsp;d</body></html>"),
    ("<svg viewbox=1><foreignobject><p>x</svg>", '<html><head></head><body><svg viewBox="1"><foreignObject><p>x</p></foreignObject></svg></body></html>'), ("<body a=1><body a=2 b=3>", '<html><head></head><body a="1" b="3"></body></html>'),
    ("<template><td>x</td></template>", "<html><head><template><td>x</td></template></head><body></body></html>"), ("<noscript><p>x</p></noscript>", "<html><head><noscript></noscript></head><body><p>x</p></body></html>"),
]
cases("parse_rules", PARSED, lambda pages: render(pages, "html"))
cases("parse_fragment_rules", [("", "<html></html>"), ("<td>x", "<html>x</html>"), ("<!doctype html><p>x", "<html><p>x</p></html>"), ("a<li>b", "<html>a<li>b</li></html>")], lambda pages: render(pages, "html", fragment=True))
cases(
    "parse_error_messages",
    [
        ("<!doctype html><p>a</p>", ""), ("<p>a</p>", "missing doctype"), ("<!doctype html><p a=1 a=2>", "duplicate attribute"), ("<!doctype html>&foo; &#; &amp", "unknown character reference; no digits in a character reference; no semicolon after a character reference"),
        ("<!doctype html><p title='&nope;'>x", "unknown character reference"), ("<!doctype html><!-->x", "abrupt closing of empty comment"), ("<!doctype html></>", "missing end tag name"), ("<!doctype html>a<1", "invalid first character of a tag name"), ("<!doctype html>x</p>y\0", "unexpected end tag; null character"),
    ],
    lambda pages: documents(pages).select("doc_id", F.array_join("errors", "; ").alias("value")),
)

# -- selectors --

LIST = "<div id=a class='x y'><p>one</p>two<p class=k lang=en-GB><b>three</b></p></div><ul><li>1</li><li>2</li><li>3</li></ul>"
SELECTED = {
    "DIV > P": "one,three", "p.K": "", '[lang|="en"]': "three", "p[LANG]": "three", ':is(p, li):has(b)': "three", ":root > html": "onetwothree123", "div:scope": "", "li:nth-child(odd)": "1,3", 'p:contains("thr")': "three",
    "*|b": "three", "li:hover": "", "p:not(:empty):only-text": "one", 'p:has-text("one")': "one", "li:nth-child( 2n + 1 )": "1,3", "li:where(:last-of-type)": "3",
}


def all_selected(pages: DataFrame) -> DataFrame:
    nodes, out = table(pages), None
    for i, selector in enumerate(SELECTED):
        text = nodes.select(selector).text().groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("sel_ord", "value"))).alias("v"))
        own = pages.filter(F.col("page_id") == i).select(F.col("page_id").alias("doc_id")).join(text, "doc_id", "left")
        out = own if out is None else out.unionByName(own)
    return out.select("doc_id", F.coalesce(F.array_join(F.transform("v", lambda v: v["value"]), ","), F.lit("")).alias("value"))


cases("selector_rules", [(LIST, text) for text in SELECTED.values()], all_selected)


def invalid(pages: DataFrame) -> DataFrame:
    nodes = table(pages)
    return nodes.root().length().select("doc_id", F.lit(",".join(str(nodes.try_select(s) is None) for s in ("p", "p::", "p >", ":nth-child(x)", "a:unknown", "[a", "p::before"))).alias("value"))


cases("selector_errors", [(LIST, "False,True,True,True,True,True,True")], invalid)


# -- fragments, new nodes, getters, edits: page, expected; run on the node table --

VERBS = {
    "fragment_of_cell": ("<table><tr><td>x</td></tr></table>", "<html><td>x</td></html>", lambda n: n.select("td").to_fragment().render("html")),
    "fragment_of_row": ("<table><tr><td>x</td></tr></table>", "<html><tr><td>x</td></tr></html>", lambda n: n.select("tr").to_fragment().render("html")),
    "fragment_of_option": ("<select><option>o", "<html><option>o</option></html>", lambda n: n.select("option").to_fragment().render("html")),
    "fragment_of_html": ("<p>x", "<html><head></head><body><p>x</p></body></html>", lambda n: n.select("html").to_fragment().render("html")),
    "html_of_nothing": ("<p>x", "", lambda n: n.select("b").html()),
    "try_html_of_nothing": ("<p>x", None, lambda n: n.select("b").try_html()),
    "inner_html_of_nothing": ("<p>x", "", lambda n: n.select("b").inner_html()),
    "new_element": (LIST, "<li>1</li><li>2</li><li>3</li><hr>", lambda n: (lambda m: m[0].edit(m[0].select("ul"), "append_selection", source=m[1]).select("ul").inner_html())(n.create("element", tag="hr"))),
    "new_text": ("<p>x</p>", "<p>xa&lt;b</p>", lambda n: (lambda m: body(m[0].edit(m[0].select("p"), "append_selection", source=m[1])))(n.create("text", text="a<b"))),
    "new_tree": ("", "<p></p>", lambda n: Nodes.new(n.df.select("doc_id").distinct(), "element", "p").render("html")),
    "new_fragment": ("", "", lambda n: Nodes.new(n.df.select("doc_id").distinct(), "fragment").render("html")),
    "clone_keeps": ("<p>x</p>", "<p>x</p>", lambda n: (n.select("p").edit("remove"), body(n))[1]),
    "child_by_path": (LIST, "one", lambda n: n.child_path(["html", "body", "div", "p"]).text()),
    "child_by_predicate": (LIST, "three", lambda n: n.select("div").child("element", F.array_contains("classes", "k")).text()),
    "first_child": (LIST, "one", lambda n: n.select("div").child("first").text()),
    "last_child": (LIST, "three", lambda n: n.select("div").child("last").text()),
    "children_reversed": (LIST, "3,2,1", lambda n: joined(n.select("ul").children(reverse=True).text())),
    "children_of_any_kind": (LIST, "one,two,three", lambda n: joined(n.select("div").children("all").text())),
    "next_of_text": (LIST, "three", lambda n: n.select("div").children("all").get(1).next_sibling().text()),
    "head_and_body": ("<title>t</title><p>x", "t", lambda n: n.head().text()),
    "get_by_id": (LIST, "one", lambda n: n.get(n.select("p").first().rows).text()),
    "id_getter": (LIST, "a", lambda n: n.select("div").id_attr()),
    "class_getter": (LIST, "x y", lambda n: n.select("div").class_attr()),
    "has_attr": (LIST, "true", lambda n: n.select("div").has_attr("id").withColumn("value", F.col("value").cast("string"))),
    "mini_is": (LIST, "true", lambda n: n.select("p").mini_is("p.k[lang^=en]").withColumn("value", F.col("value").cast("string"))),
    "mini_filter": (LIST, "three", lambda n: n.select("p").mini_filter(".k").text()),
    "node_is": (LIST, "false,true", lambda n: joined(n.select("p").node_is("div p:has(b)").withColumn("value", F.col("value").cast("string")))),
    "node_is_invalid": (LIST, "false,false", lambda n: joined(n.select("p").node_is("p::").withColumn("value", F.col("value").cast("string")))),
    "precompiled": (LIST, "2,3", lambda n: joined(n.select(matcher("li + li")).text())),
    "reparent_children": ("<div></div><ul><li>1</li></ul>", "<div><li>1</li></div><ul></ul>", lambda n: body(n.edit(n.select("div"), "reparent_children", source=n.select("ul")))),
    "append_run": ("<div></div><ul><li>1</li><li>2</li><li>3</li></ul>", "<div><li>2</li><li>3</li></div><ul><li>1</li></ul>", lambda n: body(n.edit(n.select("div"), "append_run", source=n.select("li").get(1)))),
    "prepend_run": ("<div>x</div><ul><li>1</li><li>2</li></ul>", "<div><li>1</li><li>2</li>x</div><ul></ul>", lambda n: body(n.edit(n.select("div"), "prepend_run", source=n.select("li").get(1)))),
    "before_run": ("<div></div><ul><li>1</li><li>2</li></ul>", "<li>2</li><div></div><ul><li>1</li></ul>", lambda n: body(n.edit(n.select("div"), "before_run", source=n.select("li").get(1)))),
    "after_run": ("<div></div><ul><li>1</li><li>2</li></ul>", "<div></div><li>2</li><ul><li>1</li></ul>", lambda n: body(n.edit(n.select("div"), "after_run", source=n.select("li").get(1)))),
    "replace_with_selection": ("<p>a</p><b>x</b>", "<b>x</b>", lambda n: body(n.edit(n.select("p"), "replace_with_selection", source=n.select("b")))),
    "replace_with_nothing_node": ("<p>a</p>", "<p>a</p>", lambda n: body(n.edit(n.select("p"), "replace_node_html", ""))),
    "set_nothing_node": ("<p>a</p>", "<p></p>", lambda n: body(n.edit(n.select("p"), "set_html", ""))),
    "below_itself": ("<div><b>x</b></div>", "<div><b>x</b></div>", lambda n: body(n.edit(n.select("b"), "append_selection", source=n.select("div")))),
    "copy_of_template": ("<p></p><template><i>t</i></template>", "<p><template><i>t</i></template></p>", lambda n: body(n.edit(n.select("p"), "append_selection", source=n.select("template")))),
    "merge": ("<p>a</p>", "<p>a</p><p>a</p>", lambda n: body(n.merge(n))),
    "chained_edits": ("<p>a</p>", '<p class="k">a<i>1</i><b>2</b></p>', lambda n: body((lambda a: (lambda b: b.edit(b.select("p"), "append_html", "<b>2</b>"))(a.edit(a.select("p"), "append_html", "<i>1</i>")))(n.add_class(n.select("p"), "k")))),
}


def joined(rows: DataFrame) -> DataFrame:
    values = F.array_sort(F.collect_list(F.struct("sel_ord", "value")))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(values, lambda v: v["value"]), ",").alias("value"))


for name, (page, expected, verb) in VERBS.items():
    cases(f"node_{name}" if not name.startswith("node_") else name, [(page, expected)], lambda pages, verb=verb: verb(table(pages)))

cases("rewrite_steps", [("<ul><li>x</li></ul>", '<html><head></head><body><ul><li class="k">n</li></ul></body></html>')], lambda pages: rewrite(pages, [("li", "remove"), ("ul", "append_html", "<li>n</li>"), ("li:only-child", "add_class", "k")]))
cases("extract_path", [(LIST, "1"), ("<ul><li>z</li></ul>", "z")], lambda pages: extract(pages, "body ul li", ["text"], engine="path", single=True).withColumn("value", F.col("text")))


DAMAGE = {"no such parent": ("parent_id", 900), "outside its parent": ("last", 900), "depth": ("depth", 900), "position": ("sib_idx", 900)}


@query("validate_damaged", "SELECT * FROM (VALUES " + ", ".join(f"({i}::BIGINT, {quoted(p)}, 1::BIGINT)" for i, p in enumerate(DAMAGE)) + ") v(doc_id, problem, n)")
def validate_damaged(spark, sf_dir):
    """A page for each way that a table can be wrong, with one wrong row."""
    nodes = Nodes.parse(ship(spark).createDataFrame([(i, "<p>x</p>") for i in range(len(DAMAGE))], "page_id long, html string"))
    rows = nodes.df
    for i, (column, value) in enumerate(DAMAGE.values()):
        rows = rows.withColumn(column, F.when((F.col("doc_id") == i) & (F.col("kind") == "text"), value).otherwise(F.col(column)))
    return Nodes(rows, partitioned=True).validate().groupBy("doc_id", "problem").agg(long(F.count("*")).alias("n"))


__all__ = ["ORACLES", "QUERIES"]
