"""What is read from parsed pages in one pass agrees with plans over the node table, and is one pass."""

import pytest

from sylvan.operators.frame import Nodes, checked

HTML = '<title>t</title><base href=b><div id="a" class="x y"><p>one</p>two<p class="k"><b>three</b></p></div><ul><li>1</li><li class=k>2</li><li>3</li></ul><template><i>t</i></template>'
PAGES = [HTML, "<p>only</p>", "", "<!doctype html><!--c--><svg><a xlink:href=z>s</a></svg><ul><li>1<li>2<!--d--></ul>&amp", None]

READS = {
    "add_class": lambda n: n.add_class(n.select("div"), " new x").select_single("div.new").nodes("tag", "attrs"),
    "set_attr": lambda n: n.set_attr(n.select("p"), "id", "q").select("#q").attr("id"),
    "rename": lambda n: n.rename(n.select("li.k"), "dd").select("li:nth-of-type(2)").text(),
    "add": lambda n: n.select("b, p.k").add("p, li").nodes("tag"),
    "add_none": lambda n: n.select("b").add("ul").nodes("tag"),
    "add_selection": lambda n: n.select("b").add_selection(n.select("li")).text(),
    "filter": lambda n: n.select("p, li").filter(".k, li:first-child, body > :has(b)").each_attr("class"),
    "filter_root": lambda n: n.root().filter(":root").nodes("kind"),
    "filter_selection": lambda n: n.select("li").filter_selection(n.select(".k")).text(),
    "ancestors": lambda n: n.select("b, li").ancestors().nodes("tag"),
    "ancestors_k": lambda n: n.select("b, li").ancestors(2).nodes("tag"),
    "ancestors_all": lambda n: n.select("b").ancestors(kinds="all").nodes("kind"),
    "children": lambda n: n.select("ul, div").children().nodes(),
    "descendants": lambda n: n.select("div, ul, p").descendants().nodes("kind", "text", "pre"),
    "parent": lambda n: n.select("li, b").parent().nodes("n_child", "n_elem", "n_solid", "parent_id", "id_attr", "classes", "ns"),
    "siblings": lambda n: n.select("li, p").next_sibling().prev_sibling().nodes("tag"),
    "find": lambda n: n.find(["body", "p"]).text("n_child"),
    "find_descendants": lambda n: n.find_descendants("ul > li ~ li").nodes("tag"),
    "head": lambda n: n.head().children().nodes("tag"),
    "html_root": lambda n: n.html_root().nodes("tag", "depth"),
    "base_uri": lambda n: n.base_uri(),
    "length": lambda n: n.select("li").length(),
    "exists": lambda n: n.select("li").get(1).exists(),
    "is": lambda n: n.select("li").is_(".k"),
    "is_invalid": lambda n: n.select("li").is_("::"),
    "is_selection": lambda n: n.select("li").is_selection(n.select(".k")),
    "attr_or": lambda n: n.select("li, p").last().attr("class", "none"),
    "has_attr": lambda n: n.select("svg a").has_attr("href"),
    "has_class": lambda n: n.select("li").has_class("k"),
    "text_joined": lambda n: n.select("div, b").text_joined(),
    "immediate_text": lambda n: n.select("div, li").immediate_text(),
    "char_count": lambda n: n.body().char_count(),
    "fold": lambda n: n.select("ul").fold("markdown"),
    "html": lambda n: n.select("b").html(),
    "try_html": lambda n: n.select("b").try_inner_html(),
    "render": lambda n: n.render("html"),
    "edits": lambda n: (lambda m: m.select("ul").edit("append_html", "<li>n</li>").body().inner_html())(n.select("li.k").edit("remove")),
    "edit_filtered": lambda n: n.select("li").filter(".k").edit("wrap_html", "<b></b>").body().inner_html(),
    "prepend": lambda n: n.select("ul").edit("prepend_selection", source=n.select("p")).body().inner_html(),
    "edited_twice_by_siblings": lambda n: (lambda m: m.select("li").next_sibling().edit("remove").body().inner_html())(n.select("p").edit("append_html", "<i>1</i>")),
    "checked": lambda n: checked(n.select("li").edit("wrap_html", "<b></b>")),
    "sizes": lambda n: n.sizes(),
}


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(list(enumerate(PAGES)), "page_id long, html string").repartition(2).cache()


@pytest.fixture(scope="module")
def table(pages):
    own = Nodes.parse(pages)
    own.df = own.df.cache()
    return own


def rows(df, names):
    return sorted((str(tuple(r[n] for n in names)) for r in df.collect()))


@pytest.mark.parametrize("name", READS)
def test_one_pass_agrees_with_the_table(pages, table, name):
    one, two = READS[name](Nodes.parse(pages)), READS[name](table)
    assert dict(one.dtypes) == dict(two.dtypes)
    assert rows(one, two.columns) == rows(two, two.columns)


@pytest.mark.parametrize("name", [n for n in READS if n not in ("is_invalid", "edited_twice_by_siblings")])
def test_one_parse_no_shuffle_no_join(pages, name):
    """Plans over the table parsed the pages once for each of their parts and joined those, by broadcasts where sizes looked small."""
    plan = READS[name](Nodes.parse(pages))._jdf.queryExecution().executedPlan().toString().split("InMemoryTableScan")[0]
    assert plan.count("MapInArrow") == 1 and "Exchange" not in plan and "Join" not in plan and "Window" not in plan


def test_fragments_are_read_in_one_pass(pages):
    own = Nodes.parse(pages, fragment=True)
    assert {r.value for r in own.select("p.k").html().collect()} == {'<p class="k"><b>three</b></p>', ""}
    assert {r.doc_id: r.value for r in own.sizes().collect()}[2] == 2


def test_trees_taken_apart_leave_no_garbage():
    """Trees that have been read go at once, without a search for cycles."""
    import gc
    import weakref

    from sylvan.markup.dom import Document
    from sylvan.markup.treebuilder import parse_document
    from sylvan.sources.pages import take_apart

    gc.disable()
    try:
        docs = [parse_document(page) for page in PAGES]
        gone = [weakref.ref(d) for d in docs]
        tops = [d.root for d in docs]
        take_apart(docs)
        assert docs == [] and all(r() is None for r in gone) and all(t.children == [] for t in tops)
        assert isinstance(parse_document(""), Document)
    finally:
        gc.enable()
