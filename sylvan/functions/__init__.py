"""SQL functions over HTML strings: html_text, html_md, html_formatted, html_attr, and the table functions parse_html and html_select."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from sylvan.css.match import select
from sylvan.css.parser import parse
from sylvan.markup.markdown import to_markdown
from sylvan.markup.textfmt import formatted
from sylvan.markup.treebuilder import parse_document
from sylvan.schema import NAMES, rows_of
from sylvan.session import ship


def html_text(html: pd.Series) -> pd.Series:
    return html.map(lambda h: parse_document(h).root.string())


def html_md(html: pd.Series) -> pd.Series:
    return html.map(lambda h: to_markdown(parse_document(h).root))


def html_formatted(html: pd.Series) -> pd.Series:
    return html.map(lambda h: formatted(parse_document(h).root))


def html_attr(html: pd.Series, selector: pd.Series, name: pd.Series) -> pd.Series:
    """An attribute of the first match of a selector."""
    known: dict = {}

    def one(h, s, n):
        if s not in known:
            known[s] = parse(s)
        found = select([parse_document(h).root], known[s])
        return found[0].attr(n) if found else None

    return pd.Series([one(*r) for r in zip(html, selector, name, strict=True)], dtype=object)


class HtmlSelect:
    """Rows of ordinal, node id, name, text for each match of a selector."""

    def eval(self, html: str, selector: str) -> Iterator[tuple]:
        for i, n in enumerate(select([parse_document(html).root], selector)):
            yield i + 1, n.id, n.tag, n.string()


class ParseHtml:
    """Rows of a page's nodes: id, parent, document order, last below, depth, kind, name, text."""

    def eval(self, html: str) -> Iterator[tuple]:
        at = [NAMES.index(c) for c in ("node_id", "parent_id", "pre", "last", "depth", "kind", "tag", "text")]
        for row in rows_of(parse_document(html)):
            yield tuple(row[i] for i in at)


def register(spark: SparkSession) -> SparkSession:
    """Make the functions known to SQL in this session."""
    ship(spark)
    for f in (html_text, html_md, html_formatted, html_attr):
        spark.udf.register(f.__name__, F.pandas_udf(f, "string"))
    spark.udtf.register("html_select", F.udtf(HtmlSelect, returnType="sel_ord int, node_id int, tag string, text string"))
    spark.udtf.register("parse_html", F.udtf(ParseHtml, returnType="node_id int, parent_id int, pre int, last int, depth int, kind string, tag string, text string"))
    return spark
