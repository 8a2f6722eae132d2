"""One query per operator over the driver's tables, and the same results as DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.operators.frame import Nodes, Selection, attr_value, checked
from sylvan.session import ship, shuffle_partitions
from sylvan.sources.pages import documents, extract, render

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if oracle is not None:
            ORACLES[name] = oracle
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# -- inputs: the pages table, and pages written from orders and their lines --


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages, dealt to all cores where the files make too few partitions for that."""
    rows = read(spark, sf_dir, "pages")
    n = shuffle_partitions(spark)
    return rows.repartition(n) if rows.rdd.getNumPartitions() < min(n, spark.sparkContext.defaultParallelism) else rows


def orders_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each order: a div with its status, id and priority, and a list of its lines.

    Lines and orders are dealt by order once, as short columns; their pages are made where they meet. The numbers
    of partitions are given, since there are few bytes and much parsing.
    """
    n = shuffle_partitions(spark)
    line = read(spark, sf_dir, "lineitem").repartition(n, "l_orderkey")
    item = F.concat(
        F.lit('<li class="item '), "l_returnflag", F.lit(" "), "l_linestatus", F.lit('" data-qty="'), F.col("l_quantity").cast("long").cast("string"),
        F.lit('" data-part="'), F.col("l_partkey").cast("string"), F.lit('">part '), F.col("l_partkey").cast("string"), F.lit("</li>"),
    )
    items = line.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", item.alias("li")))).alias("x"))
    items = items.select(F.col("l_orderkey").alias("o_orderkey"), F.array_join(F.col("x.li"), "").alias("items"))
    rows = read(spark, sf_dir, "orders").repartition(n, "o_orderkey").join(items.hint("merge"), "o_orderkey", "left")
    html = F.concat(
        F.lit('<div class="order '), "o_orderstatus", F.lit('" id="o'), F.col("o_orderkey").cast("string"), F.lit('" data-prio="'), "o_orderpriority",
        F.lit('"><ul>'), F.coalesce("items", F.lit("")), F.lit("</ul></div>"),
    )
    return rows.select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


def page_nodes(spark: SparkSession, sf_dir: str) -> Nodes:
    return Nodes.parse(pages(spark, sf_dir))


def order_nodes(spark: SparkSession, sf_dir: str) -> Nodes:
    return Nodes.parse(orders_html(spark, sf_dir))


ITEMS = """
it AS (
  SELECT l_orderkey AS k, l_returnflag AS f, l_linestatus AS s, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS q, CAST(l_partkey AS VARCHAR) AS p,
    row_number() OVER w AS i, count(*) OVER (PARTITION BY l_orderkey) AS n, lag(l_returnflag) OVER w AS before, lead(l_returnflag) OVER w AS after,
    coalesce(bool_or(l_returnflag = 'R') OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS r_before
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)
)"""

PAGES = r"""
p AS (SELECT page_id, url, html, regexp_replace(regexp_replace(html, '<script>.*?</script>', '', 'gs'), '<style>.*?</style>', '', 'gs') AS h FROM pages),
links AS (
  SELECT page_id, generate_subscripts(hs, 1) AS i, len(hs) AS n, unnest(hs) AS href, unnest(ts) AS t
  FROM (SELECT page_id, regexp_extract_all(h, '<li><a href="([^"]*)">([^<]*)</a>', 1) AS hs, regexp_extract_all(h, '<li><a href="([^"]*)">([^<]*)</a>', 2) AS ts FROM p)
),
paras AS (
  SELECT page_id, generate_subscripts(ps, 1) AS i, unnest(ps) AS raw FROM (SELECT page_id, string_split(regexp_extract(h, '<article>(.*)</article>', 1, 's'), '<p>')[2:] AS ps FROM p)
)"""


def decoded(x: str) -> str:
    """Text without the tags b, br and p, and with the references that the pages hold."""
    plain = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    for name, char in (("copy", "©"), ("middot", "·"), ("quot", '"')):
        plain = f"replace({plain}, '&{name};', '{char}')"
    plain = f"replace({plain}, '&amp;', '&')"
    return f"regexp_replace({plain}, '&amp$', '&')"


def long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def parts(own: Selection) -> DataFrame:
    """doc_id, sel_ord, part of selected items."""
    return own.each_attr("data-part").select("doc_id", long("sel_ord").alias("sel_ord"), F.col("value").alias("part"))


# -- selectors over items: name, selector, the same as a condition in SQL --

ITEM_SELECTORS = {
    "class": ("li.R", "f = 'R'"),
    "two_classes": ("li.R.F", "f = 'R' AND s = 'F'"),
    "attr_exists": ("[data-part]", "true"),
    "attr_equals": ('li[data-qty="5"]', "q = '5'"),
    "attr_prefix": ('li[data-part^="1"]', "p LIKE '1%'"),
    "attr_suffix": ("li[data-part$='7']", "p LIKE '%7'"),
    "attr_substring": ("li[data-part*='12']", "p LIKE '%12%'"),
    "attr_includes": ("li[class~=O]", "s = 'O'"),
    "attr_ignore_case": ("li[class='ITEM r f' i]", "f = 'R' AND s = 'F'"),
    "attr_empty_value": ("li[data-part^='']", "false"),
    "child": ("div > ul > li", "true"),
    "descendant": ("div.O li.N", "f = 'N' AND k IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O')"),
    "id": ("#o7 li", "k = 7"),
    "universal": ("ul > *", "true"),
    "li_nth": ("li:nth-child(2n+1)", "i % 2 = 1"),
    "li_nth_negative": ("li:nth-child(-n+2)", "i <= 2"),
    "li_nth_last": ("li:nth-last-child(2)", "i = n - 1"),
    "li_nth_even_odd": ("li:nth-child(even):nth-last-child(odd)", "i % 2 = 0 AND (n - i + 1) % 2 = 1"),
    "first_child": ("li:first-child", "i = 1"),
    "last_child": ("li:last-child", "i = n"),
    "only_child": ("li:only-child", "n = 1"),
    "of_type": ("li:nth-of-type(3n)", "i % 3 = 0"),
    "nth_last_of_type": ("li:nth-last-of-type(3)", "i = n - 2"),
    "first_last_of_type": ("li:first-of-type, li:last-of-type", "i = 1 OR i = n"),
    "only_of_type": ("li:only-of-type", "n = 1"),
    "li_adjacent": ("li.R + li.A", "f = 'A' AND before = 'R'"),
    "li_sibling": ("li.R ~ li.N", "f = 'N' AND r_before"),
    "not": ("li:not(.N)", "f <> 'N'"),
    "not_complex": ("li:not(.R + li)", "before IS DISTINCT FROM 'R'"),
    "is_where": ("li:is(.R, .A):where(.F)", "f IN ('R', 'A') AND s = 'F'"),
    "list": ('li.R, li[data-qty="1"]', "f = 'R' OR q = '1'"),
    "has_adjacent": ("li:has(+ li.R)", "after = 'R'"),
    "contains": ("li:contains('part 12')", "'part ' || p LIKE '%part 12%'"),
    "has_text": ("li:has-text('t 3')", "'part ' || p LIKE '%t 3%'"),
    "only_text": ("li:only-text", "true"),
    "never_match": ("li:hover, li:checked, li:visited", "false"),
    "any_namespace": ("*|li.R", "f = 'R'"),
    "root_child": (":root > html li.A", "f = 'A'"),
    "bare_root": ("li:root", "false"),
}


def _item_query(selector: str) -> Query:
    return lambda spark, sf_dir: parts(order_nodes(spark, sf_dir).select(selector))


for _name, (_selector, _where) in ITEM_SELECTORS.items():
    query(f"sel_{_name}", f"WITH {ITEMS} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY i) AS sel_ord, p AS part FROM it WHERE {_where}")(_item_query(_selector))


@query("sel_has", "SELECT o_orderkey AS doc_id FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def sel_has(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("div.order:has(li.R)").rows.select("doc_id")


@query("sel_not_has", "SELECT o_orderkey AS doc_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
def sel_not_has(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("div.order:not(:has(li.R))").rows.select("doc_id")


@query("sel_has_nested", f"WITH {ITEMS} SELECT DISTINCT k AS doc_id FROM it WHERE f = 'A' AND before = 'R'")
def sel_has_nested(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("div:has(> ul > .R + .A)").rows.select("doc_id")


@query("sel_empty", "SELECT o_orderkey AS doc_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def sel_empty(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("ul:empty").rows.select("doc_id")


@query("sel_attr_dash", "SELECT o_orderkey AS doc_id, o_orderpriority AS prio FROM orders WHERE o_orderpriority LIKE '1-%'")
def sel_attr_dash(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("div[data-prio|='1']").attr("data-prio").withColumnRenamed("value", "prio")


# -- pages --


@query("nav_links", f"WITH {PAGES} SELECT page_id AS doc_id, i AS sel_ord, href, {decoded('t')} AS text FROM links")
def nav_links(spark, sf_dir):
    found = extract(pages(spark, sf_dir), "nav > ul > li > a[href]", ["text"], ["href"])
    return found.select("doc_id", long("sel_ord").alias("sel_ord"), F.col("attr_href").alias("href"), "text")


@query("nav_links_plan", f"WITH {PAGES} SELECT page_id AS doc_id, i AS sel_ord, href, {decoded('t')} AS text FROM links")
def nav_links_plan(spark, sf_dir):
    nodes = page_nodes(spark, sf_dir)
    found = nodes.select("nav > ul > li > a[href]")
    href = found.nodes("attrs").select("doc_id", "node_id", attr_value("href").alias("href"))
    return found.text().join(href, ["doc_id", "node_id"]).select("doc_id", long("sel_ord").alias("sel_ord"), "href", F.col("value").alias("text"))


@query("titles", rf"WITH {PAGES} SELECT page_id AS doc_id, {decoded(r'''regexp_extract(h, '<title>([^<]*)', 1)''')} AS title FROM p")
def titles(spark, sf_dir):
    return extract(pages(spark, sf_dir), "title", ["text"], single=True).select("doc_id", F.col("text").alias("title"))


@query("para_count", f"WITH {PAGES} SELECT page_id AS doc_id, count(*) AS n FROM paras GROUP BY page_id")
def para_count(spark, sf_dir):
    return page_nodes(spark, sf_dir).select("article > p").rows.groupBy("doc_id").agg(F.count("*").alias("n"))


@query("para_text", f"WITH {PAGES} SELECT page_id AS doc_id, i AS sel_ord, {decoded('raw')} AS text FROM paras")
def para_text(spark, sf_dir):
    return page_nodes(spark, sf_dir).select("article > p").text().select("doc_id", long("sel_ord").alias("sel_ord"), F.col("value").alias("text"))


@query(
    "b_reconstruct",
    f"""WITH {PAGES}, b AS (SELECT page_id, i, CAST(contains(raw, '<b>') AS BIGINT) AS own, sum(CAST(contains(raw, '<b>') AS BIGINT)) OVER (PARTITION BY page_id ORDER BY i) AS upto FROM paras)
    SELECT page_id AS doc_id, i AS sel_ord, CAST(least(upto - own, 3) + own AS BIGINT) AS n_b FROM b""",
)
def b_reconstruct(spark, sf_dir):
    nodes = page_nodes(spark, sf_dir)
    paras = nodes.select("article > p")
    b = nodes.select("article > p b").nodes("pre").select("doc_id", F.col("pre").alias("b_pre"))
    own = paras.nodes("pre", "last")
    n = own.join(b.withColumnRenamed("doc_id", "b_doc"), (F.col("doc_id") == F.col("b_doc")) & (F.col("pre") < F.col("b_pre")) & (F.col("b_pre") <= F.col("last")), "left")
    return n.groupBy("doc_id", long("sel_ord").alias("sel_ord")).agg(F.count("b_pre").alias("n_b"))


@query("footer_b", f"WITH {PAGES} SELECT page_id AS doc_id, CAST(least(sum(CAST(contains(raw, '<b>') AS BIGINT)), 3) AS BIGINT) AS n_b FROM paras GROUP BY page_id HAVING n_b > 0")
def footer_b(spark, sf_dir):
    return page_nodes(spark, sf_dir).select("footer b").rows.groupBy("doc_id").agg(F.count("*").alias("n_b"))


@query("comments", f"WITH {PAGES} SELECT page_id AS doc_id, regexp_extract(h, '<!--(.*?)-->', 1, 's') AS text FROM p")
def comments(spark, sf_dir):
    return page_nodes(spark, sf_dir).df.filter("kind = 'comment' and attached").select("doc_id", "text")


@query("lang_filter", "SELECT page_id AS doc_id, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang FROM pages WHERE contains(html, '<html lang=\"fr\"')")
def lang_filter(spark, sf_dir):
    return page_nodes(spark, sf_dir).select("html[lang=fr]").attr("lang").withColumnRenamed("value", "lang")


@query("any_link", f"WITH {PAGES} SELECT page_id AS doc_id, i AS sel_ord, href FROM links")
def any_link(spark, sf_dir):
    return page_nodes(spark, sf_dir).select(":any-link").each_attr("href").select("doc_id", long("sel_ord").alias("sel_ord"), F.col("value").alias("href"))


@query("ad_class", f"WITH {PAGES} SELECT page_id AS doc_id, {decoded(chr(10).join(['regexp_extract(h, ', chr(39) + '<div class=' + chr(34) + 'ad' + chr(34) + '>([^<]*)' + chr(39) + ', 1)']))} AS text FROM p")
def ad_class(spark, sf_dir):
    return page_nodes(spark, sf_dir).select(".ad").text().select("doc_id", F.col("value").alias("text"))


@query("script_text", "SELECT page_id AS doc_id, regexp_extract(html, '<script>(.*?)</script>', 1, 's') AS text FROM pages")
def script_text(spark, sf_dir):
    return extract(pages(spark, sf_dir), "script", ["text"]).select("doc_id", "text")


@query("page_kinds", "SELECT page_id AS doc_id, 'document' AS kind, 'no-quirks' AS quirks_mode FROM pages")
def page_kinds(spark, sf_dir):
    return documents(pages(spark, sf_dir)).select("doc_id", "kind", "quirks_mode")


@query("empty_documents", "SELECT page_id AS doc_id, '<html><head></head><body></body></html>' AS html FROM pages")
def empty_documents(spark, sf_dir):
    return render(pages(spark, sf_dir).select("page_id", F.lit("").alias("html")), "html").withColumnRenamed("value", "html")


@query("parse_errors", f"WITH {PAGES} SELECT page_id AS doc_id, 'no semicolon after a character reference' AS error FROM p WHERE regexp_matches(regexp_extract(h, '<title>(.*)</title>', 1), '&amp$') UNION ALL SELECT page_id, 'no semicolon after a character reference' FROM p WHERE regexp_matches(regexp_extract(h, '<h1>(.*)</h1>', 1), '&amp$')")
def parse_errors(spark, sf_dir):
    return documents(pages(spark, sf_dir)).select("doc_id", F.explode("errors").alias("error"))


# -- selections: traversal and set algebra over orders --


@query("select_single", f"WITH {ITEMS} SELECT k AS doc_id, p AS part FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS o FROM it WHERE f = 'R') WHERE o = 1")
def select_single(spark, sf_dir):
    return parts(order_nodes(spark, sf_dir).select_single("li.R")).select("doc_id", "part")


@query("select_last", f"WITH {ITEMS} SELECT k AS doc_id, p AS part FROM it WHERE i = n")
def select_last(spark, sf_dir):
    return parts(order_nodes(spark, sf_dir).select("li").last()).select("doc_id", "part")


@query("select_get", f"WITH {ITEMS} SELECT k AS doc_id, p AS part FROM it WHERE i = 3")
def select_get(spark, sf_dir):
    return parts(order_nodes(spark, sf_dir).select("li").get(2)).select("doc_id", "part")


@query("nested_select", f"WITH {ITEMS} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY i) AS sel_ord, p AS part FROM it WHERE f = 'R'")
def nested_select(spark, sf_dir):
    return parts(order_nodes(spark, sf_dir).select("ul").select("div .R"))


@query("length", "SELECT o_orderkey AS doc_id, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def length(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("li").length().withColumnRenamed("value", "n")


@query("exists", "SELECT o_orderkey AS doc_id, o_orderkey IN (SELECT l_orderkey FROM lineitem) AS found FROM orders")
def exists(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("li").exists().withColumnRenamed("value", "found")


@query("parent", "SELECT DISTINCT l_orderkey AS doc_id, 'ul' AS tag FROM lineitem")
def parent(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("li").parent().nodes("tag").select("doc_id", "tag")


@query("children", f"WITH {ITEMS} SELECT k AS doc_id, i AS sel_ord, p AS part FROM it")
def children(spark, sf_dir):
    return parts(order_nodes(spark, sf_dir).select("ul").children())


@query("ancestors", "SELECT DISTINCT l_orderkey AS doc_id, a.sel_ord, a.tag FROM lineitem, (VALUES (1::BIGINT, 'ul'), (2, 'div'), (3, 'body'), (4, 'html')) a(sel_ord, tag)")
def ancestors(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("li:first-child").ancestors().nodes("tag").select("doc_id", long("sel_ord").alias("sel_ord"), "tag")


@query("ancestors_k", "SELECT DISTINCT l_orderkey AS doc_id, a.sel_ord, a.tag FROM lineitem, (VALUES (1::BIGINT, 'ul'), (2, 'div')) a(sel_ord, tag)")
def ancestors_k(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("li").ancestors(2).nodes("tag").select("doc_id", long("sel_ord").alias("sel_ord"), "tag")


@query("next_sibling", f"WITH {ITEMS} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY i) AS sel_ord, p AS part FROM it WHERE before = 'R'")
def next_sibling(spark, sf_dir):
    return parts(order_nodes(spark, sf_dir).select("li.R").next_sibling())


@query("prev_sibling", f"WITH {ITEMS} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY i) AS sel_ord, p AS part FROM it WHERE after = 'R'")
def prev_sibling(spark, sf_dir):
    return parts(order_nodes(spark, sf_dir).select("li.R").prev_sibling())


@query("last_sibling", f"WITH {ITEMS} SELECT k AS doc_id, p AS part FROM it WHERE i = n AND n > 1")
def last_sibling(spark, sf_dir):
    return parts(order_nodes(spark, sf_dir).select("li").siblings("last")).select("doc_id", "part")


@query("descendants", "SELECT o_orderkey AS doc_id, 2 * count(l_orderkey) + 1 AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def descendants(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("div").descendants().length().withColumnRenamed("value", "n")


@query("filter", f"WITH {ITEMS} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY i) AS sel_ord, p AS part FROM it WHERE f = 'R' AND i % 2 = 0")
def filter_(spark, sf_dir):
    return parts(order_nodes(spark, sf_dir).select("li:nth-child(2n)").filter(".R"))


@query(
    "filter_selection",
    f"WITH {ITEMS} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY i) AS sel_ord, p AS part FROM it WHERE i % 2 = 0 AND (f = 'R' OR k NOT IN (SELECT k FROM it WHERE f = 'R'))",
)
def filter_selection(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return parts(nodes.select("li:nth-child(2n)").filter_selection(nodes.select(".R")))


@query(
    "add_union",
    f"WITH {ITEMS}, o AS (SELECT * FROM it WHERE f = 'R' OR i = 1) SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN f = 'R' THEN 0 ELSE 1 END, i) AS sel_ord, p AS part FROM o WHERE k IN (SELECT k FROM it WHERE f = 'R')",
)
def add_union(spark, sf_dir):
    return parts(order_nodes(spark, sf_dir).select("li.R").add("li:first-child"))


@query("add_selection", f"WITH {ITEMS} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN f = 'R' THEN 0 ELSE 1 END, i) AS sel_ord, p AS part FROM it WHERE f = 'R' OR i = 1")
def add_selection(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return parts(nodes.select("li.R").add_selection(nodes.select("li:first-child")))


@query("is", "SELECT o_orderkey AS doc_id, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS found FROM orders")
def is_(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("li").is_(".R").withColumnRenamed("value", "found")


@query("is_selection", f"WITH {ITEMS} SELECT o_orderkey AS doc_id, o_orderkey IN (SELECT k FROM it WHERE f = 'R' AND i = 1) AS found FROM orders")
def is_selection(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return nodes.select("li:first-child").is_selection(nodes.select(".R")).withColumnRenamed("value", "found")


@query("find_path", f"WITH {ITEMS} SELECT k AS doc_id, i AS sel_ord, p AS part FROM it")
def find_path(spark, sf_dir):
    return parts(order_nodes(spark, sf_dir).find(["body", "div", "li"]))


@query("find_restricted", f"WITH {ITEMS} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY i) AS sel_ord, p AS part FROM it WHERE f = 'A' AND before = 'R'")
def find_restricted(spark, sf_dir):
    return parts(order_nodes(spark, sf_dir).find_descendants("div.order > ul > li.R + li.A"))


@query("find_restricted_repeats", f"WITH {ITEMS} SELECT b.k AS doc_id, b.p AS part, count(*) AS n FROM it a JOIN it b ON a.k = b.k AND a.i < b.i WHERE a.f = 'R' GROUP BY b.k, b.i, b.p")
def find_restricted_repeats(spark, sf_dir):
    found = order_nodes(spark, sf_dir).find_descendants("li.R ~ li:hover")
    return found.each_attr("data-part").groupBy("doc_id", "node_id", F.col("value").alias("part")).agg(F.count("*").alias("n")).select("doc_id", "part", "n")


@query("base_uri", "SELECT page_id AS doc_id, 'https://x/' || page_id AS value FROM pages")
def base_uri(spark, sf_dir):
    html = F.concat(F.lit("<head><title>t</title><base href='https://x/"), F.col("page_id").cast("string"), F.lit("'><base href=no></head><base href=never>"))
    return Nodes.parse(pages(spark, sf_dir).select("page_id", html.alias("html"))).base_uri()


# -- attributes and classes --


@query("attr", "SELECT o_orderkey AS doc_id, o_orderpriority AS value FROM orders")
def attr(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("div").attr("data-prio")


@query("attr_or", "SELECT o_orderkey AS doc_id, 'none' AS value FROM orders")
def attr_or(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("div").attr("title", "none")


@query("attrs", "SELECT o_orderkey AS doc_id, 'class=order ' || o_orderstatus || ';id=o' || o_orderkey || ';data-prio=' || o_orderpriority AS value FROM orders")
def attrs(spark, sf_dir):
    rows = order_nodes(spark, sf_dir).select("div").attrs()
    return rows.select("doc_id", F.array_join(F.transform("value", lambda a: F.concat(a["name"], F.lit("="), a["value"])), ";").alias("value"))


@query("has_class", "SELECT l_orderkey AS doc_id, bool_or(l_returnflag = 'R') AS value FROM lineitem GROUP BY l_orderkey")
def has_class(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("li").has_class("R")


def tag_of(nodes: Nodes, selector: str) -> DataFrame:
    """doc_id, tag: the start tag of the selector's first match, from its columns."""
    text = F.concat(F.lit("<"), "tag", F.array_join(F.transform("attrs", lambda a: F.concat(F.lit(" "), a["name"], F.lit("="), a["value"])), ""), F.lit(">"))
    return nodes.select_single(selector).nodes("tag", "attrs").select("doc_id", text.alias("tag"))


_DIV = "'<div class=order ' || o_orderstatus || ' id=o' || o_orderkey || ' data-prio=' || o_orderpriority"


@query("set_attr", f"SELECT o_orderkey AS doc_id, {_DIV} || ' title=t>' AS tag FROM orders")
def set_attr(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return tag_of(nodes.set_attr(nodes.select("div"), "title", "t"), "div")


@query("set_attr_replaces", "SELECT o_orderkey AS doc_id, '<div class=order ' || o_orderstatus || ' id=new data-prio=' || o_orderpriority || '>' AS tag FROM orders")
def set_attr_replaces(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return tag_of(nodes.set_attr(nodes.select("div"), "id", "new"), "#new")


@query("remove_attrs", "SELECT o_orderkey AS doc_id, '<div class=order ' || o_orderstatus || '>' AS tag FROM orders")
def remove_attrs(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return tag_of(nodes.remove_attrs(nodes.select("div"), ["id", "data-prio"]), "div")


@query("retain_attrs", "SELECT o_orderkey AS doc_id, '<div id=o' || o_orderkey || '>' AS tag FROM orders")
def retain_attrs(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return tag_of(nodes.retain_attrs(nodes.select("div"), ["id"]), "div")


@query("remove_all_attrs", "SELECT o_orderkey AS doc_id, '<div>' AS tag FROM orders")
def remove_all_attrs(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return tag_of(nodes.remove_all_attrs(nodes.select("div")), "div")


@query("add_class", f"SELECT o_orderkey AS doc_id, replace({_DIV} || '>', ' id=', ' new more id=') AS tag FROM orders")
def add_class(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return tag_of(nodes.add_class(nodes.select("div"), " new order  more"), "div.new.more")


@query("remove_class", "SELECT o_orderkey AS doc_id, '<div class=' || o_orderstatus || ' id=o' || o_orderkey || ' data-prio=' || o_orderpriority || '>' AS tag FROM orders")
def remove_class(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return tag_of(nodes.remove_class(nodes.select("div"), "order none"), "div")


@query("remove_class_all", "SELECT o_orderkey AS doc_id, '<div class= id=o' || o_orderkey || ' data-prio=' || o_orderpriority || '>' AS tag FROM orders")
def remove_class_all(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return tag_of(nodes.remove_class(nodes.select("div"), "order O F P"), "div")


@query("rename", f"WITH {ITEMS} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY i) AS sel_ord, p AS part FROM (SELECT *, row_number() OVER (PARTITION BY k, f = 'R' ORDER BY i) AS t FROM it) WHERE f = 'R' AND t <= 2")
def rename(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return parts(nodes.rename(nodes.select("li.R"), "dd").select("dd:nth-of-type(-n+2)"))


# -- text --

_TEXT = "string_agg('part ' || p, '' ORDER BY i)"


@query("text", f"WITH {ITEMS} SELECT o_orderkey AS doc_id, coalesce((SELECT {_TEXT} FROM it WHERE k = o_orderkey), '') AS text FROM orders")
def text(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("div").text().select("doc_id", F.col("value").alias("text"))


@query("text_joined", f"WITH {ITEMS} SELECT k AS doc_id, {_TEXT} || {_TEXT} AS text FROM it GROUP BY k")
def text_joined(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("ul, li").filter(":not(:empty)").text_joined().select("doc_id", F.col("value").alias("text"))


@query("immediate_text", f"WITH {ITEMS} SELECT k AS doc_id, i AS sel_ord, 'part ' || p AS text FROM it")
def immediate_text(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("li").immediate_text().select("doc_id", long("sel_ord").alias("sel_ord"), F.col("value").alias("text"))


@query("char_count", rf"WITH {PAGES} SELECT page_id AS doc_id, i AS sel_ord, length(trim(regexp_replace({decoded('raw')}, '\s+', ' ', 'g'))) AS n FROM paras")
def char_count(spark, sf_dir):
    return page_nodes(spark, sf_dir).select("article > p").char_count().select("doc_id", long("sel_ord").alias("sel_ord"), F.col("value").alias("n"))


@query("formatted_text", f"WITH {ITEMS} SELECT k AS doc_id, string_agg('part ' || p, chr(10) ORDER BY i) AS text FROM it GROUP BY k")
def formatted_text(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("ul").filter(":not(:empty)").fold("formatted_text").select("doc_id", F.col("value").alias("text"))


@query("markdown", f"WITH {ITEMS} SELECT o_orderkey AS doc_id, coalesce((SELECT string_agg('- part ' || p, chr(10) ORDER BY i) FROM it WHERE k = o_orderkey), '') AS md FROM orders")
def markdown(spark, sf_dir):
    return render(orders_html(spark, sf_dir), "markdown").withColumnRenamed("value", "md")


def parts_table_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each hundred parts: a table of key and name."""
    row = F.concat(F.lit("<tr><td>"), F.col("p_partkey").cast("string"), F.lit("</td><td>"), F.col("p_name"), F.lit("</td></tr>"))
    rows = read(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 100).alias("page_id")).agg(F.array_sort(F.collect_list(F.struct("p_partkey", row.alias("r")))).alias("x"))
    html = F.concat(F.lit("<table><tr><th>Key</th><th>Näme</th></tr>"), F.array_join(F.transform("x", lambda r: r["r"]), ""), F.lit("</table>"))
    return rows.select(F.col("page_id").cast("long"), html.alias("html"))


@query(
    "markdown_table",
    r"SELECT CAST(p_partkey // 100 AS BIGINT) AS doc_id, '| Key | Näme |' || chr(10) || '| --- | ----- |' || chr(10) || string_agg('| ' || p_partkey || ' | ' || regexp_replace(p_name, '([`*_{}\[\]<>()#+.!|])', '\\\1', 'g') || ' |', chr(10) ORDER BY p_partkey) AS md FROM part GROUP BY p_partkey // 100",
)
def markdown_table(spark, sf_dir):
    return render(parts_table_html(spark, sf_dir), "markdown").withColumnRenamed("value", "md")


@query("table_cells", "SELECT CAST(p_partkey // 100 AS BIGINT) AS doc_id, row_number() OVER (PARTITION BY p_partkey // 100 ORDER BY p_partkey) AS sel_ord, p_name AS name FROM part")
def table_cells(spark, sf_dir):
    return extract(parts_table_html(spark, sf_dir), "table > tbody > tr > td:last-child", ["text"]).select("doc_id", long("sel_ord").alias("sel_ord"), F.col("text").alias("name"))


# -- serialisation --

_LI = """'<li class="item ' || f || ' ' || s || '" data-qty="' || q || '" data-part="' || p || '">part ' || p || '</li>'"""
_ORDER = f"""SELECT o_orderkey AS k, '<div class="order ' || o_orderstatus || '" id="o' || o_orderkey || '" data-prio="' || o_orderpriority || '">' AS head, coalesce((SELECT string_agg({_LI}, '' ORDER BY i) FROM it WHERE it.k = o_orderkey), '') AS lis FROM orders"""


def html_oracle(inside: str, more: str = "") -> str:
    return f"WITH {ITEMS}, o AS ({_ORDER}){more} SELECT k AS doc_id, {inside} AS html FROM o"


def html_of(nodes: Nodes, selector: str = "body", inner: bool = True) -> DataFrame:
    own = nodes.select(selector)
    return (own.inner_html() if inner else own.html()).withColumnRenamed("value", "html")


@query("serialize_html", html_oracle("'<html><head></head><body>' || head || '<ul>' || lis || '</ul></div></body></html>'"))
def serialize_html(spark, sf_dir):
    return render(orders_html(spark, sf_dir), "html").withColumnRenamed("value", "html")


@query("inner_html", html_oracle("'<ul>' || lis || '</ul>'"))
def inner_html(spark, sf_dir):
    return html_of(order_nodes(spark, sf_dir), "div")


@query("outer_html", html_oracle("'<ul>' || lis || '</ul>'"))
def outer_html(spark, sf_dir):
    return html_of(order_nodes(spark, sf_dir), "ul", False)


@query("to_fragment", html_oracle("'<html><ul>' || lis || '</ul></html>'"))
def to_fragment(spark, sf_dir):
    return order_nodes(spark, sf_dir).select("ul").to_fragment().render("html").withColumnRenamed("value", "html")


@query("fragment", html_oracle("'<html>' || head || '<ul>' || lis || '</ul></div></html>'"))
def fragment(spark, sf_dir):
    return render(orders_html(spark, sf_dir), "html", fragment=True).withColumnRenamed("value", "html")


# -- structural edits --

EDITS = {
    "append_html": ("ul", "append_html", ("<li>new</li>",), "head || '<ul>' || lis || '<li>new</li></ul></div>'"),
    "prepend_html": ("ul", "prepend_html", ("<li>a</li><li>b</li>",), "head || '<ul><li>a</li><li>b</li>' || lis || '</ul></div>'"),
    "before_html": ("ul", "before_html", ("<p>x</p>",), "head || '<p>x</p><ul>' || lis || '</ul></div>'"),
    "after_html": ("ul", "after_html", ("<p>x</p>y",), "head || '<ul>' || lis || '</ul><p>x</p>y</div>'"),
    "replace_with_html": ("ul", "replace_with_html", ("<p>x</p>",), "head || '<p>x</p></div>'"),
    "replace_with_nothing": ("ul", "replace_with_html", ("",), "head || '</div>'"),
    "set_html": ("div", "set_html", ("<b>1</b>",), "head || '<b>1</b></div>'"),
    "set_text": ("div", "set_text", ("a < b",), "head || 'a &lt; b</div>'"),
    "wrap_html": ("ul", "wrap_html", ("<section></section>",), "head || '<section><ul>' || lis || '</ul></section></div>'"),
    "unwrap": ("ul", "unwrap", (), "'<ul>' || lis || '</ul>'"),
    "strip": ("body", "strip_elements", ("div", "ul"), "lis"),
    "remove_children": ("ul", "remove_children", (), "head || '<ul></ul></div>'"),
}


def _edit_query(selector: str, verb: str, args: tuple) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nodes = order_nodes(spark, sf_dir)
        return html_of(nodes.select(selector).edit(verb, *args))

    return run


for _name, (_selector, _verb, _args, _inside) in EDITS.items():
    query(f"edit_{_name}", html_oracle(_inside))(_edit_query(_selector, _verb, _args))


@query("edit_remove", f"WITH {ITEMS} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY i) AS sel_ord, p AS part FROM it WHERE f <> 'R'")
def edit_remove(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return parts(nodes.select("li.R").edit("remove").select("ul > li"))


@query("edit_remove_positions", f"WITH {ITEMS} SELECT k AS doc_id, p AS part FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY i) AS o FROM it WHERE f <> 'R') WHERE o = 2")
def edit_remove_positions(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return parts(nodes.select("li.R").edit("remove").select("li:nth-child(2)")).select("doc_id", "part")


@query("edit_append_selection", f"WITH {ITEMS} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN f = 'R' THEN 1 ELSE 0 END, i) AS sel_ord, p AS part FROM it")
def edit_append_selection(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return parts(nodes.select("ul").edit("append_selection", source=nodes.select("li.R")).select("ul > li"))


@query("edit_prepend_selection", f"WITH {ITEMS} SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY CASE WHEN f = 'R' THEN 0 ELSE 1 END, i) AS sel_ord, p AS part FROM it")
def edit_prepend_selection(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return parts(nodes.select("ul").edit("prepend_selection", source=nodes.select("li.R")).select("ul > li"))


@query("edit_normalize", "SELECT o_orderkey AS doc_id, 1::BIGINT AS n, 'xy' AS text FROM orders")
def edit_normalize(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    nodes = nodes.select("ul").edit("replace_with_html", "x")
    nodes = nodes.select("div").edit("append_html", "y")
    nodes = nodes.select("div").edit("normalize")
    return nodes.select("div").text("n_child").select("doc_id", long("n_child").alias("n"), F.col("value").alias("text"))


@query("validate", "SELECT page_id AS doc_id, 'none' AS problem FROM pages WHERE false")
def validate(spark, sf_dir):
    return page_nodes(spark, sf_dir).validate()


@query("validate_links", "SELECT o_orderkey AS doc_id, 0::BIGINT AS problems FROM orders")
def validate_links(spark, sf_dir):
    nodes = order_nodes(spark, sf_dir)
    return checked(nodes.select("li").edit("wrap_html", "<b></b>"))


@query("node_counts", "SELECT o_orderkey AS doc_id, 6 + 2 * count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def node_counts(spark, sf_dir):
    return order_nodes(spark, sf_dir).sizes().withColumnRenamed("value", "n")
