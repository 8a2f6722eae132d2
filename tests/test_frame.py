import pytest

from sylvan.css.match import select
from sylvan.css.parser import SelectorError
from sylvan.markup.edit import edit, violations
from sylvan.markup.serialize import to_html
from sylvan.markup.treebuilder import parse_document
from sylvan.operators.frame import Nodes, checked, matcher, matches
from sylvan.sources.pages import documents, extract, parse, read_files, render, rewrite

HTML = '<div id="a" class="x y"><p>one</p>two<p class="k"><b>three</b></p></div><ul><li>1</li><li>2</li><li>3</li></ul><template><i>t</i></template>'
PAGES = [HTML, "<p>only</p>", ""]


@pytest.fixture(scope="module")
def nodes(spark):
    own = Nodes.parse(spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string"))
    own.df = own.df.cache()
    return own


def values(df, *names):
    return sorted(tuple(r[n] for n in ("doc_id", *names)) for r in df.collect())


def tags(own):
    return values(own.nodes("tag"), "sel_ord", "tag")


def test_traversal(nodes):
    p = nodes.select("p")
    assert tags(p.parent()) == [(0, 1, "div"), (1, 1, "body")]
    assert tags(nodes.select("li:first-child").next_sibling()) == [(0, 1, "li")]
    assert tags(nodes.select("ul").prev_sibling()) == [(0, 1, "div")]
    assert tags(nodes.select("b").ancestors()) == [(0, 1, "p"), (0, 2, "div"), (0, 3, "body"), (0, 4, "html")]
    assert tags(nodes.select("b").ancestors(2)) == [(0, 1, "p"), (0, 2, "div")]
    assert tags(nodes.select("b").ancestors(0, kinds="all")) == [(0, 1, "p"), (0, 2, "div"), (0, 3, "body"), (0, 4, "html"), (0, 5, None)]
    assert tags(nodes.select("div").children("all")) == [(0, 1, "p"), (0, 2, None), (0, 3, "p")]
    assert tags(nodes.select("div, p").children()) == [(0, 1, "p"), (0, 2, "p"), (0, 3, "b")]
    assert values(nodes.select("div").descendants().rows.groupBy("doc_id").count(), "count") == [(0, 6)]
    assert tags(nodes.select("li").siblings("last")) == [(0, 1, "li")]
    assert tags(nodes.select("p").siblings("next")) == [(0, 1, None)]
    assert tags(nodes.body().children()) == [(0, 1, "div"), (0, 2, "ul"), (0, 3, "template"), (1, 1, "p")]
    assert tags(nodes.head()) == [(0, 1, "head"), (1, 1, "head"), (2, 1, "head")]
    assert tags(nodes.html_root()) == [(i, 1, "html") for i in range(3)]
    assert nodes.root().rows.count() == 3


def test_sets_and_quirks(nodes):
    p, li = nodes.select("p"), nodes.select("li")
    assert values(p.length(), "value") == [(0, 2), (1, 1), (2, 0)]
    assert values(p.is_(".k"), "value") == [(0, True), (1, False), (2, False)]
    assert values(p.is_("(bad"), "value") == [(0, False), (1, False), (2, False)]
    assert values(p.filter_selection(nodes.select(".k")).rows, "sel_ord") == [(0, 1), (1, 1)]  # page 1 has no .k: unchanged
    assert tags(p.add("li")) == [(0, 1, "p"), (0, 2, "p"), (0, 3, "li"), (0, 4, "li"), (0, 5, "li"), (1, 1, "p")]
    assert tags(nodes.select("b").add("p")) == [(0, 1, "b"), (0, 2, "p"), (0, 3, "p")]
    assert tags(nodes.select("nothing").add_selection(li)) == [(0, 1, "li"), (0, 2, "li"), (0, 3, "li")]
    assert values(p.is_selection(li), "value") == [(0, False), (1, False), (2, False)]
    assert nodes.try_select("a:::b") is None and p.try_filter("[") is None
    with pytest.raises(SelectorError):
        nodes.select("> p")
    with pytest.raises(SelectorError):
        matches("p:has(b)")
    assert nodes.df.filter("attached").filter(matches("p.k, b")).count() == 2


def test_nested_select_order(spark):
    own = Nodes.parse(spark.createDataFrame([(1, "<div class=a><p>1<div class=b><p>2</div></div><div class=c><p>3</div>")], "page_id long, html string"))
    outer = own.select(".c").add(".b").add(".a")
    found = outer.select("body p").text()
    assert values(found, "sel_ord", "value") == [(1, 1, "3"), (1, 2, "2"), (1, 3, "1")]


def test_getters(nodes):
    assert values(nodes.select("p").attr("class", "none"), "value") == [(0, "none"), (1, "none")]
    assert values(nodes.select("div").has_attr("id"), "value") == [(0, True)]
    assert values(nodes.select("div").has_class("y"), "value") == [(0, True)]
    assert values(nodes.select("div").text(), "value") == [(0, "onetwothree")]
    assert values(nodes.select("div").immediate_text(), "value") == [(0, "two")]
    assert values(nodes.select("div, b").text_joined(), "value") == [(0, "onetwothreethree")]
    assert values(nodes.select("ul").inner_html(), "value") == [(0, "<li>1</li><li>2</li><li>3</li>"), (1, ""), (2, "")]
    assert values(nodes.select("b").try_html(), "value") == [(0, "<b>three</b>"), (1, None), (2, None)]
    assert values(nodes.select("p").last().class_attr(), "value") == [(0, "k"), (1, None)] and values(nodes.select("p").id_attr(), "value") == [(0, None), (1, None)]
    assert values(nodes.select("template").html(), "value") == [(0, "<template><i>t</i></template>"), (1, ""), (2, "")]
    assert values(nodes.render("markdown"), "value") == [(0, "one\n\ntwo\n\n**three**\n\n- 1\n- 2\n- 3"), (1, "only"), (2, "")]
    assert values(nodes.select("ul").to_fragment().render("html"), "value") == [(0, "<html><ul><li>1</li><li>2</li><li>3</li></ul></html>")]


def test_column_edits_agree_with_a_new_parse(nodes):
    div = nodes.select("div")
    steps = [
        (nodes.set_attr(div, "title", "t"), '<div id="a" class="x y" title="t">'),
        (nodes.set_attr(div, "class", "z"), '<div id="a" class="z">'),
        (nodes.remove_attrs(div, ["id"]), '<div class="x y">'),
        (nodes.retain_attrs(div, ["id"]), '<div id="a">'),
        (nodes.add_class(div, " z  x"), '<div id="a" class="x y z">'),
        (nodes.remove_class(div, "x y"), '<div id="a" class="">'),
        (nodes.rename(div, "main"), '<main id="a" class="x y">'),
    ]
    columns = [c for c in nodes.df.columns if c not in ("node_id", "parent_id", "template_root")]
    for new, start in steps:
        html = new.render("html")
        assert start in {r.doc_id: r.value for r in html.collect()}[0]
        again = parse(html.withColumnRenamed("doc_id", "page_id").withColumnRenamed("value", "html"))
        key = lambda df: sorted(map(str, df.select(*columns).collect()))
        assert key(new.df) == key(again)


EDITS = [
    ("append_html", ("<i>n</i>z",)), ("prepend_html", ("<i>n</i>z",)), ("before_html", ("<i>n</i>z",)), ("after_html", ("<i>n</i>z",)), ("replace_with_html", ("<i>n</i>z",)),
    ("replace_with_html", ("",)), ("set_html", ("<i>n</i>",)), ("set_html", ("",)), ("wrap_html", ("<section></section>",)), ("set_text", ("a<b",)), ("remove", ()), ("remove_children", ()),
    ("unwrap", ()), ("strip_elements", ("b", "p")), ("normalize", ()), ("rename", ("q",)),
]


@pytest.mark.parametrize("selector", ["p", "li:nth-child(2)", "div"])
def test_structural_edits_agree_with_one_tree(nodes, selector):
    for verb, args in EDITS:
        new = nodes.edit(nodes.select(selector), verb, *args)
        got = {r.doc_id: r.value for r in new.render("html").collect()}
        for i, html in enumerate(PAGES):
            doc = parse_document(html)
            edit(doc, select([doc.root], selector), verb, *args)
            assert violations(doc) == []
            assert got[i] == to_html(doc.root), (verb, args)
        assert new.validate().count() == 0
        assert {r.problems for r in checked(new).collect()} == {0}


def test_selection_edits(nodes):
    body = lambda own: {r.doc_id: r.value for r in own.body().inner_html().collect()}[0]
    li, ul = nodes.select("li"), nodes.select("ul")
    assert "<ul></ul><template>" in body(li.edit("remove"))
    assert '<p class="k"><b>three</b></p><li>1</li><li>2</li><li>3</li></div><ul></ul>' in body(nodes.select("div").edit("append_selection", source=li))
    assert body(nodes.select("p").edit("replace_with_selection", source=li)).count("<li>2</li>") == 2
    assert body(ul.edit("append_selection", source=nodes.select("nothing"))) == HTML
    assert body(nodes.select("b").edit("append_selection", source=nodes.select("div"))) == HTML  # can't stand below itself
    assert [r.doc_id for r in nodes.impossible(nodes.select("b"), nodes.select("div")).collect()] == [0]
    assert nodes.impossible(nodes.select("li"), nodes.select("div")).count() == 0


def test_documents_and_sources(spark, tmp_path):
    (tmp_path / "a.html").write_text("<!doctype html><p>x</p>")
    found = extract(read_files(spark, f"file://{tmp_path}"), "p", ["text", "html", "char_count"], ["class"], id_col="doc_id")
    assert [(r.sel_ord, r.tag, r.text, r.html, r.char_count, r.attr_class) for r in found.collect()] == [(1, "p", "x", "<p>x</p>", 1, None)]
    pages = spark.createDataFrame([(1, "<!doctype html>"), (2, "</p>"), (None, None)], "page_id long, html string")
    assert {r.doc_id: r.quirks_mode for r in documents(pages).collect()} == {1: "no-quirks", 2: "quirks", None: "quirks"}
    assert render(pages.limit(0), "html").count() == 0
    ids = {(r.node_id, r.kind, r.tag, r.attached) for r in parse(pages.filter("page_id = 2"), fragment=True).collect()}
    assert ids >= {(0, "fragment", None, True), (1, "element", "body", False), (2, "element", "html", True)}


def test_one_shuffle_only(nodes):
    """A table that is partitioned by document isn't shuffled again by joins or windows."""
    nodes.df.count()  # the partitioning of a cached table is known once it is there
    nodes.df.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = nodes.select("div > p + p, li:has(+ li)").rows._jdf.queryExecution().executedPlan().toString()
    finally:
        nodes.df.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plan.replace("InMemoryTableScan", "").split("InMemoryRelation")[0]


def test_fused_edits_agree_with_the_table(spark, nodes):
    pages = spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string")
    value = lambda df: sorted((r.doc_id, r.value) for r in df.collect())
    div = nodes.select("div")
    for verb, args, new in [
        ("set_attr", ("class", "z"), nodes.set_attr(div, "class", "z")), ("remove_attrs", ("id", "class"), nodes.remove_attrs(div, ["id", "class"])), ("retain_attrs", ("id",), nodes.retain_attrs(div, ["id"])),
        ("add_class", ("n x",), nodes.add_class(div, "n x")), ("remove_class", ("x",), nodes.remove_class(div, "x")), ("rename", ("main",), nodes.rename(div, "main")), ("append_html", ("<i>1</i>",), nodes.edit(div, "append_html", "<i>1</i>")),
    ]:
        assert value(rewrite(pages, [("div", verb, *args)])) == value(new.render("html")), verb
    two = rewrite(pages, [("li", "remove"), ("ul", "append_html", "<li>n</li>"), ("li:only-child", "add_class", "k")])
    assert '<ul><li class="k">n</li></ul>' in value(two)[0][1]


def test_children_runs_and_merge(spark, nodes):
    div, li = nodes.select("div"), nodes.select("li")
    assert values(div.child("first").text(), "value") == [(0, "one")]
    assert values(div.child("last").text(), "value") == [(0, "three")]
    assert values(nodes.select("p.k").child("element").nodes("tag"), "tag") == [(0, "b")]
    assert tags(div.child("element", matches(".k"))) == [(0, 1, "p")]
    assert nodes.get(spark.createDataFrame([(0, 0), (0, 999)], "doc_id long, node_id int")).rows.count() == 1
    body = lambda own: {r.doc_id: r.value for r in own.body().inner_html().collect()}[0]
    second = nodes.select("li:nth-child(2)")
    assert "<ul><li>1</li></ul>" in body(div.edit("append_run", source=second)) and "</p><li>2</li><li>3</li></div>" in body(div.edit("append_run", source=second))
    assert '<div id="a" class="x y"><li>1</li><li>2</li><p>one' in body(div.edit("prepend_run", source=second))
    assert body(div.edit("before_run", source=second)).startswith("<li>2</li><li>3</li><div")
    assert "</div><li>2</li><li>3</li><ul>" in body(div.edit("after_run", source=second))
    assert "<ul></ul>" in body(div.edit("reparent_children", source=nodes.select("ul")))
    assert body(nodes.select("p").first().edit("before_selection", source=li.first())).startswith('<div id="a" class="x y"><li>1</li><p>one')
    assert "</p><li>1</li>" in body(nodes.select("p").first().edit("after_selection", source=li.first()))
    assert '<ul><li>1</li><li>2</li><li>3</li><p class="k"><b>three</b></p></ul>' in body(nodes.select("p.k").edit("wrap_selection", source=nodes.select("ul")))
    two = Nodes.parse(spark.createDataFrame([(0, "<p>more</p>")], "page_id long, html string"))
    assert body(nodes.merge(two)) == HTML + "<p>more</p>"


def test_chains_are_one_pass(nodes):
    """Five edits in a row, structural ones and others, are one pass over the documents, as by the fused form."""
    own = nodes
    for k in range(5):
        own = own.select("p").edit("append_html", f"<i>{k}</i>") if k % 2 else own.add_class(own.select("div > p").first(), f"k{k}")
    plan = own.df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.split("InMemoryRelation")[0].count("MapInArrow") == 1 and plan.count("\n") < 40
    assert '<p class="k0 k2 k4">one<i>1</i><i>3</i></p>' in {r.doc_id: r.value for r in own.render("html").collect()}[0]
    one = nodes.select("p").edit("append_html", "<u></u>")
    two = one.edit(one.select("u").next_sibling(), "remove")  # no route leads there: the table's plan is cut
    assert two.df._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") >= 1


def test_fragments_keep_rows(spark):
    """A subtree is copied as it is, though HTML of it alone would be read otherwise."""
    page = "<table><tr><td>x<template><b>t</b></template></td></tr></table><select><option>o</select>"
    own = Nodes.parse(spark.createDataFrame([(1, page), (2, "<p>")], "page_id long, html string"))
    for name, html in (("td", "<td>x<template><b>t</b></template></td>"), ("tr", "<tr><td>x<template><b>t</b></template></td></tr>"), ("option", "<option>o</option>")):
        new = own.select(name).to_fragment()
        assert values(new.render("html"), "value") == [(1, f"<html>{html}</html>")]
        assert {(r.node_id, r.kind, r.tag) for r in new.df.filter("node_id < 4").collect()} == {(0, "fragment", None), (1, "element", "body"), (2, "element", "html"), (3, "element", name)}
        assert checked(new).filter("problems > 0").count() == new.validate().count() == 0
    whole = own.select("html").to_fragment()
    assert values(whole.render("html"), "value") == values(own.render("html"), "value")


def test_new_nodes_and_trees(spark, nodes):
    ids = spark.createDataFrame([(5,), (6,)], "id long")
    for kind in ("document", "fragment"):
        tree = Nodes.new(ids, kind)
        assert [(r.node_id, r.kind, r.n_child) for r in tree.df.collect()] == [(0, kind, 0)] * 2
        assert values(tree.render("html"), "value") == [(5, ""), (6, "")]
    assert values(Nodes.new(ids, "element", "p").render("html"), "value") == [(5, "<p></p>"), (6, "<p></p>")]
    own, made = nodes.create("element", tag="hr")
    assert {r.attached for r in made.nodes("attached").collect()} == {False} and own.df.count() == nodes.df.count() + 3
    put = own.edit(own.select("p"), "after_selection", source=made)
    assert '<p>one</p><hr>two<p class="k"><b>three</b></p><hr></div>' in {r.doc_id: r.value for r in put.render("html").collect()}[0]
    own, made = nodes.create("text", text="a<b")
    assert values(made.text(), "value") == [(0, ""), (1, ""), (2, "")] and values(made.nodes("text"), "text") == [(0, "a<b"), (1, "a<b"), (2, "a<b")]


def test_more_verbs(nodes):
    assert tags(nodes.child_path(["html", "body", "div", "p"])) == [(0, 1, "p")]
    assert tags(nodes.select("div").mini_filter("div.x[id]")) == [(0, 1, "div")]
    assert values(nodes.select("p").mini_is("p.k"), "value") == [(0, True), (1, False), (2, False)]
    assert values(nodes.select("p").node_is("div p:has(b)"), "sel_ord", "value") == [(0, 1, False), (0, 2, True), (1, 1, False)]
    assert values(nodes.select("p").node_is("p:::"), "value") == [(0, False), (0, False), (1, False)]
    assert values(nodes.root().node_is(":root"), "value") == [(0, False), (1, False), (2, False)]
    assert tags(nodes.select("ul").children(reverse=True)) == [(0, 1, "li"), (0, 2, "li"), (0, 3, "li")]
    assert values(nodes.select("ul").children(reverse=True).text(), "sel_ord", "value") == [(0, 1, "3"), (0, 2, "2"), (0, 3, "1")]
    once = matcher("li + li")
    assert tags(nodes.select(once)) == tags(nodes.select("ul").select(once)) == [(0, 1, "li"), (0, 2, "li")]
    md = {r.doc_id: r.value for r in nodes.body().fold("markdown", skip=["ul"]).collect()}
    assert md[0] == "one\n\ntwo\n\n**three**"
    assert nodes.try_select("p::") is None


def test_deep_and_wide_pages(spark):
    pages = spark.createDataFrame([(1, "<blockquote>" * 1500 + "x"), (2, "<ul>" + "<li>y" * 20_000), (3, "<template>" * 1500)], "page_id long, html string")
    assert {r.doc_id for r in render(pages, "markdown").collect()} == {1, 2, 3}
    assert extract(pages, "li + li").count() == 19_999
    done = rewrite(pages, [("li", "before_html", "<b></b>"), ("head", "append_html", "<i></i>")])
    assert {r.doc_id: r.value.count("<b></b>") for r in done.collect()}[2] == 20_000
    own = Nodes.parse(pages)
    assert own.select("li ~ li").length().filter("doc_id = 2").first().value == 19_999
    assert own.select("blockquote blockquote").length().filter("doc_id = 1").first().value == 1_499
    assert own.select("li").first().next_sibling().rows.count() == 1
