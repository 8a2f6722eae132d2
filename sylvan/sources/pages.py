"""Pages to node tables, or straight to the nodes that a selector finds."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.css import match, mini
from sylvan.css.parser import parse as parse_selector
from sylvan.markup.dom import Document, Node
from sylvan.markup.edit import edit
from sylvan.markup.forms import Forms, Stage
from sylvan.markup.markdown import to_markdown
from sylvan.markup.serialize import to_html
from sylvan.markup.textfmt import char_count, formatted
from sylvan.schema import batch_of, ddl, rows_of
from sylvan.session import ship

BATCH = 1 << 20  # characters of HTML parsed before a batch of rows is handed on


def take_apart(docs: list[Document]) -> None:
    """Empties the list of trees that nothing needs any more, and cuts the links in them that would keep them."""
    stack = [d.root for d in docs]
    docs.clear()
    while stack:
        node = stack.pop()
        node.parent, own, node.children = None, node.children, []
        stack += own
        if node.template is not None:
            stack.append(node.template)


def _parsed(batches: Iterator[pa.RecordBatch], fragment: bool, change: Callable[[Document], None] | None = None, stages: Sequence[Stage] | None = None, lazy: bool = False):
    """Documents in groups of about BATCH characters: ids as an Arrow array, and the trees, changed if so wished, one after the other.

    A tree is good until the next, which may be the same with other values (see sylvan.markup.forms). Trees hold
    cycles. They are taken apart after use, so that between groups there is little garbage left to collect; what
    the worker holds besides is left out of that.
    """
    forms = Forms(fragment, change, stages, lazy)
    gc.disable()
    gc.freeze()
    try:
        for batch in batches:
            sizes = pc.binary_length(batch.column(1)).fill_null(0).to_pylist()
            start = total = 0
            for i, n in enumerate([*sizes, None]):
                if n is None or total and total + n > BATCH:
                    if i > start:
                        part = batch.slice(start, i - start)
                        yield part.column(0), map(forms.read, part.column(1).to_pylist())
                        if forms.spent:
                            take_apart(forms.spent)
                            gc.collect()
                    start, total = i, 0
                total += n or 0
    finally:
        gc.unfreeze()
        gc.enable()


def pages_of(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """doc_id, html."""
    ship(pages.sparkSession)
    return pages.select(F.col(id_col).alias("doc_id"), F.col(html_col).cast("string").alias("html"))


def parse(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", fragment: bool = False, change: Callable[[Document], None] | None = None) -> DataFrame:
    """The node table of all pages, each changed first if so wished. One pass, no shuffle; null pages count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, docs in _parsed(batches, fragment, change):
            yield batch_of(ids.to_pylist(), [rows_of(d, [d_context(d)] if fragment else []) for d in docs], ids.type)

    def d_context(doc):
        from sylvan.markup.dom import HTML, Node

        return Node(1, "element", "body", HTML)  # the context element, which has no place

    source = pages_of(pages, id_col, html_col)
    return source.mapInArrow(run, ddl(source.schema["doc_id"].dataType.simpleString()))


def each_document(
    source: DataFrame, fragment: bool, find: Callable[[Document], list[Node]], work: Callable[[list[Node], Document], list[tuple]], fields: Sequence[tuple[str, pa.DataType, str]], *,
    reads: str = "tree", tests: frozenset | None = None, change: Callable[[Document], None] | None = None, stages: Sequence[Stage] | None = None,
) -> DataFrame:
    """doc_id and the fields (name, Arrow type, SQL type) of the rows that work makes of what find finds in each document of doc_id, html: one pass, no shuffle.

    Each document is changed first if so wished; stages: the same change, edit by edit. reads: what work looks at
    besides: the tree; form, by `written` only; or nothing, handing values on as they are. tests: what find asks of values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, docs in _parsed(batches, fragment, change, stages, True):
            owner: list[int] = []
            columns: list[list] = [[] for _ in fields]
            for i, d in enumerate(docs):
                if d.form is not None and reads == "nothing":
                    owner += [i] * d.form.rows(columns, find, work, tests)
                    continue
                if d.form is not None and reads == "tree":
                    d.form.fill()
                own = work(find(d), d)
                if own:
                    owner += [i] * len(own)
                    for out, new in zip(columns, zip(*own, strict=True), strict=True):
                        out += new
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, (_, t, _) in zip(columns, fields, strict=True))], names=["doc_id", *(f[0] for f in fields)])

    return source.mapInArrow(run, ", ".join([f"doc_id {source.schema['doc_id'].dataType.simpleString()}", *(f"`{n}` {t}" for n, _, t in fields)]))


def documents(pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", fragment: bool = False) -> DataFrame:
    """doc_id, kind, quirks_mode, errors (in order) of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, docs in _parsed(batches, fragment):
            kinds, quirks, errors = zip(*((d.root.kind, d.quirks, d.errors) for d in docs), strict=True)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(kinds), pa.array(quirks), pa.array(errors, pa.list_(pa.string()))],
                names=["doc_id", "kind", "quirks_mode", "errors"],
            )

    source = pages_of(pages, id_col, html_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, kind string, quirks_mode string, errors array<string>")


#: What can be written of a node: each takes a node and gives a string or number.
FOLDS = {
    "text": lambda n: n.string(),
    "immediate_text": lambda n: n.text if n.kind == "text" else "".join(c.text for c in n.children if c.kind == "text"),
    "html": to_html,
    "inner_html": lambda n: to_html(n, True),
    "formatted_text": formatted,
    "formatted_text_whole": lambda n: formatted(n, True),
    "markdown": to_markdown,
    "char_count": char_count,
}


def written(output: str, node: Node, doc: Document):
    """A node of a document as one of FOLDS."""
    if doc.form is not None and output in ("html", "inner_html"):
        return doc.form.html(node, output == "inner_html")
    return FOLDS[output](node)


def extract(
    pages: DataFrame, selector: str, outputs: Sequence[str] = ("text",), attrs: Sequence[str] = (), *, engine: str = "css", id_col: str = "page_id", html_col: str = "html",
    fragment: bool = False, single: bool = False,
) -> DataFrame:
    """doc_id, sel_ord, node_id, tag, and the outputs and attributes of the nodes found, in one pass without a shuffle.

    engine: css; mini, the restricted selectors from the root; or path, names separated by spaces.
    outputs: of FOLDS. attrs: attribute names, as columns attr_<name>. single: the first match only.
    """
    if engine == "css":
        selector_list = parse_selector(selector)
        finder = lambda d: match.select([d.root], selector_list, d.trees)
    elif engine == "mini":
        finder = lambda d: mini.find_descendants(d.root, selector)
    else:
        names = selector.split()
        finder = lambda d: mini.find(d.root, names)
    types = [pa.int32(), pa.int32(), pa.string(), *(pa.int64() if o == "char_count" else pa.string() for o in outputs), *(pa.string() for _ in attrs)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, docs in _parsed(batches, fragment):
            owner, rows = [], []
            for i, d in enumerate(docs):
                own = finder(d)[: 1 if single else None]
                owner += [i] * len(own)
                rows += [(k, n.id, n.tag, *(written(o, n, d) for o in outputs), *(n.attr(a) for a in attrs)) for k, n in enumerate(own, 1)]
            columns = zip(zip(*rows, strict=True) if rows else [()] * len(types), types, strict=True)
            columns = [ids.take(pa.array(owner, pa.int64())), *(pa.array(c, t) for c, t in columns)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "sel_ord", "node_id", "tag", *outputs, *(f"attr_{a}" for a in attrs)])

    source = pages_of(pages, id_col, html_col)
    kinds = [f"{o} {'long' if o == 'char_count' else 'string'}" for o in outputs] + [f"`attr_{a}` string" for a in attrs]
    return source.mapInArrow(run, ", ".join([f"doc_id {source.schema['doc_id'].dataType.simpleString()}, sel_ord int, node_id int, tag string", *kinds]))


def render(pages: DataFrame, output: str, *, id_col: str = "page_id", html_col: str = "html", fragment: bool = False) -> DataFrame:
    """doc_id, value: whole documents written as one of FOLDS, without a node table in between."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, docs in _parsed(batches, fragment):
            yield pa.RecordBatch.from_arrays([ids, pa.array([str(written(output, d.root, d)) for d in docs], pa.string())], names=["doc_id", "value"])

    source = pages_of(pages, id_col, html_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, value string")


def rewrite(pages: DataFrame, steps: Sequence[tuple], output: str = "html", *, id_col: str = "page_id", html_col: str = "html", fragment: bool = False) -> DataFrame:
    """doc_id, value: documents after edits, in one pass without a shuffle.

    A step is (selector, verb, *arguments): the verbs of sylvan.markup.edit with text or HTML arguments,
    and set_attr(name, value), remove_attrs(*names), retain_attrs(*names), add_class(names),
    remove_class(names). Each step selects in the document that the steps before it left.
    """
    parsed = [(parse_selector(selector), verb, args) for selector, verb, *args in steps]
    def change(doc: Document) -> None:
        for selectors, verb, args in parsed:
            edit(doc, match.select([doc.root], selectors), verb, *args)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, docs in _parsed(batches, fragment, change):
            yield pa.RecordBatch.from_arrays([ids, pa.array([str(written(output, d.root, d)) for d in docs], pa.string())], names=["doc_id", "value"])

    source = pages_of(pages, id_col, html_col)
    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, value string")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the path) and html of HTML files, each a page."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("doc_id"), F.col("value").alias("html"))
