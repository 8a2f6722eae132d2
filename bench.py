"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from sylvan.operators.frame import Nodes
from sylvan.queries import QUERIES, orders_html, pages
from sylvan.session import builder
from sylvan.sources.pages import extract, parse, render

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def main() -> None:
    spark = builder("bench", CPUS, int(CPUS) if CPUS.isdigit() else 8).config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("OFF")
    source = pages(spark, SF_DIR).repartition(int(CPUS) if CPUS.isdigit() else 8).cache()
    n_pages = source.count()
    times: dict[str, float] = {}

    def timed(name: str, make) -> None:
        start = time.time()
        try:
            make().write.format("noop").mode("overwrite").save()
            times[name] = round(time.time() - start, 3)
            print(name, times[name], file=sys.stderr, flush=True)
        except Exception as error:  # one query that fails doesn't end the run
            print(f"{name}: {str(error)[:200]}", file=sys.stderr)

    extract(source.limit(8), "a").count()  # starts the workers
    timed("parse", lambda: parse(source))
    timed("serialize", lambda: render(source, "html"))
    timed("markdown", lambda: render(source, "markdown"))
    timed("formatted_text", lambda: render(source, "formatted_text"))
    nodes = Nodes.parse(source)
    nodes.df = nodes.df.cache()
    n_nodes = nodes.df.count()
    # the six published forms of one selection, over a cached node table
    timed("select_simple", lambda: nodes.select("body nav li a[href]").rows)
    timed("select_precompiled", lambda: nodes._in_order(nodes.plan().select("body nav li a[href]")).rows)
    timed("select_lazy", lambda: nodes.plan().select("body nav li a[href]").select("doc_id", "node_id"))
    timed("select_serial", lambda: nodes.select("body").select("nav li").select("a[href]").rows)
    timed("find", lambda: nodes.find(["body", "li", "a"]).rows)
    timed("find_restricted", lambda: nodes.find_descendants("body nav li a[href]").rows)
    # the same from raw pages, fused with parsing
    timed("extract_css", lambda: extract(source, "body nav li a[href]", ["text"], ["href"]))
    timed("extract_restricted", lambda: extract(source, "body nav li a[href]", ["text"], ["href"], engine="mini"))
    timed("add_class", lambda: nodes.add_class(nodes.select("p"), "one two three").df)
    timed("remove_class", lambda: nodes.remove_class(nodes.select(".ad"), "ad x").df)
    timed("prepend_html", lambda: nodes.select("p").edit("prepend_html", "<b>1</b><i>2</i>").df)
    timed("char_count", lambda: nodes.select("body").char_count())
    timed("text", lambda: nodes.select("article").text())
    timed("orders_html", lambda: orders_html(spark, SF_DIR))
    for name in ("nav_links", "para_text", "b_reconstruct", "sel_class", "sel_li_adjacent", "serialize_html"):
        timed(f"q_{name}", lambda name=name: QUERIES[name](spark, SF_DIR))
    print(json.dumps({"metric": "total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": SF_DIR.rsplit("sf", 1)[-1], "pages": n_pages, "nodes": n_nodes, "pages_per_sec_parse": round(n_pages / times.get("parse", 1e9), 1)}))
    spark.stop()


if __name__ == "__main__":
    main()
