"""Node tables and selections over them: every verb takes and gives DataFrames, for all documents at once.

A selection is doc_id, sel_ord, node_id; sel_ord, from 1, is its order within a document. Verbs of one
document become verbs of each document; getters of the first node give a row per document.
"""

from __future__ import annotations

import gc
import tempfile
from collections.abc import Callable, Iterator, Sequence
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.css import match, mini
from sylvan.css.parser import SelectorError, parse
from sylvan.markup.dom import HTML, Document, Node
from sylvan.markup.edit import copied, violations
from sylvan.markup.edit import edit as edit_tree
from sylvan.markup.forms import Stage
from sylvan.plans.selector import KEY, Plan, compound_column, mini_column
from sylvan.schema import FIELDS, NAMES, OWN, batch_of, classes_of, ddl, rows_of, tree_of
from sylvan.session import ship, shuffle_partitions
from sylvan.sources.pages import FOLDS, each_document, pages_of, written
from sylvan.sources.pages import parse as parse_pages

SPACE = r"[\t\n\x0B\f\r \x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def ranked(rows: DataFrame, *order) -> DataFrame:
    """doc_id, sel_ord, node_id: each node once, in the order given, which starts anew in each document."""
    first = rows.withColumn("__o", F.struct(*order)).groupBy(*KEY).agg(F.min("__o").alias("__o"))
    return first.withColumn("sel_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("__o"))).select("doc_id", "sel_ord", "node_id")


class Nodes:
    """A node table, partitioned by document once so that no join or window on it shuffles again.

    The number of partitions is spark.sql.shuffle.partitions as it stands: tables are small beside the
    work on them, so adaptive execution, which goes by bytes, would put them in too few.

    Edits whose targets are found by a route (selectors and steps from the document) make a list of steps
    on the first table, carried out together document by document, however long the chain. Edits of other
    targets of an edited table cut its plan by a checkpoint, so that plans grow with the number of edits.

    What a route leads to in parsed pages (edited or not) is read from the pages in one pass, with no table,
    shuffle or join in between, as a plan over the table would parse the pages once for each of its parts.
    A table that is set (`nodes.df = nodes.df.cache()`) is used instead.
    """

    def __init__(self, df: DataFrame | None, partitioned: bool = False, base: Nodes | None = None, steps: tuple = (), edited: bool = False, source: tuple | None = None):
        self.base, self.steps, self.edited = base, steps, edited or bool(steps)
        self.source, self.given = source, False
        self._df = df if df is None or partitioned else dealt(df)

    @property
    def df(self) -> DataFrame:
        if self._df is None:
            origin, steps = self.origin, self.steps
            if origin is None:
                self._df = rebuilt(self.base.df, steps)
            else:
                pages, fragment = origin
                self._df = dealt(parse_pages(pages, id_col="doc_id", fragment=fragment, change=(lambda doc: carried_out(doc, steps)) if steps else None))
        return self._df

    @df.setter
    def df(self, df: DataFrame) -> None:
        self._df, self.given = df, True

    @property
    def origin(self) -> tuple | None:
        """The pages (doc_id, html) that the steps start from, and whether they are fragments; None if the table is what there is."""
        top = self.base or self
        return None if self.given or top.given else top.source

    @classmethod
    def parse(cls, pages: DataFrame, *, id_col: str = "page_id", html_col: str = "html", fragment: bool = False) -> Nodes:
        return cls(None, source=(pages_of(pages, id_col, html_col), fragment))

    def sizes(self) -> DataFrame:
        """doc_id, value: how many nodes each document has, those in templates included."""
        if self.origin is not None:
            return self.root()._fused([VALUE_LONG], lambda _, doc: [(sum(1 for n in everything(doc)),)])
        return self.df.groupBy("doc_id").agg(F.count("*").alias("value"))

    @classmethod
    def new(cls, ids: DataFrame, kind: str = "document", tag: str | None = None) -> Nodes:
        """A tree of nothing but its root for each of the ids (first column): document, fragment or element."""
        root = [F.lit(v).cast(t).alias(n) for (n, _, t), v in zip(FIELDS, alone(0, kind, tag), strict=True)]
        return cls(ids.select(F.col(f"`{ids.columns[0]}`").alias("doc_id"), *root))

    def create(self, kind: str = "element", tag: str | None = None, text: str | None = None, ns: str = HTML) -> tuple[Nodes, Selection]:
        """The table with one more node in each document, which stands nowhere yet, and that node."""
        top = self.df.groupBy("doc_id").agg((F.max("node_id") + 1).alias("node_id"), (F.max("pre") + 1).alias("pre"))
        own = dict(zip(NAMES, alone(0, kind, tag, text, ns, attached=False), strict=True))
        new = top.select("doc_id", *(F.col(n) if n in ("node_id", "pre") else F.col("pre").alias("last") if n == "last" else F.lit(own[n]).cast(t).alias(n) for n, _, t in FIELDS))
        out = Nodes(self.df.unionByName(new).repartition(shuffle_partitions(self.df.sparkSession), "doc_id"), partitioned=True, edited=True)
        return out, Selection(out, new.select("doc_id", F.lit(1).alias("sel_ord"), "node_id"))

    def plan(self) -> Plan:
        return Plan(self.df)

    def _then(self, targets: Selection, verb: str, args: tuple, source: Selection | None = None) -> tuple | None:
        """The steps of this table with one more, if the targets' routes are known."""
        known = targets.owner is self and targets.route is not None and (source is None or source.owner is self and source.route is not None)
        return (*self.steps, (targets.route, verb, args, source.route if source is not None else None)) if known else None

    def settle(self) -> DataFrame:
        """The rows; of an edited table, with their plan cut."""
        if self.edited and not getattr(self, "_cut", False):
            self.df, self._cut = cut(self.df), True
        return self.df

    # -- selections --

    def selection(self, rows: DataFrame, *order) -> Selection:
        return Selection(self, ranked(rows, *(order or ("pre",))))

    def _in_order(self, rows: DataFrame) -> Selection:
        ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("pre"))
        return Selection(self, rows.select("doc_id", "node_id", "pre").withColumn("sel_ord", ordinal).select("doc_id", "sel_ord", "node_id"))

    def select(self, selector: str | tuple) -> Selection:
        """All elements that match, in document order; SelectorError if it isn't a selector. A matcher() is as good."""
        parsed = matcher(selector)
        return Selection(self, lambda: self._in_order(self.plan().select(parsed)).rows, (("select", parsed),))

    def try_select(self, selector: str) -> Selection | None:
        """None if it isn't a selector. A document where nothing matches has no rows, as for every selection."""
        try:
            return self.select(selector)
        except SelectorError:
            return None

    def select_single(self, selector: str) -> Selection:
        return self.select(selector).first()

    def all(self, condition: Column | str = "attached") -> Selection:
        return self._in_order(self.df.filter(condition))

    def root(self) -> Selection:
        return Selection(self, lambda: self.all("attached and parent_id is null").rows, ())

    def html_root(self) -> Selection:
        return Selection(self, lambda: self._in_order(self.plan().elements.filter("depth = 1 and elem_idx = 1")).rows, (("top",),))

    def _part(self, tag: str) -> Selection:
        def rows() -> DataFrame:
            top = self.plan().elements.filter("depth = 1 and tag = 'html'")
            own = self.plan().elements.filter((F.col("tag") == tag) & (F.col("depth") == 2))
            own = own.join(top.select(F.col("doc_id"), F.col("node_id").alias("parent_id")), ["doc_id", "parent_id"], "left_semi")
            return self._in_order(own).first().rows

        return Selection(self, rows, (("part", tag),))

    def head(self) -> Selection:
        return self._part("head")

    def body(self) -> Selection:
        return self._part("body")

    def get(self, ids: DataFrame) -> Selection:
        """The nodes of doc_id, node_id that are there."""
        return self._in_order(self.df.join(ids.select(*KEY).distinct(), KEY, "left_semi"))

    def base_uri(self) -> DataFrame:
        """doc_id, value: the href of the first base that is a child of the head."""
        return self.head().children().filter("base").first().attr("href")

    def find(self, path: Sequence[str], start: Selection | None = None) -> Selection:
        """Elements by a path of names; steps before the last don't enter what they match."""
        walk = lambda: self._walk([mini.Mini(tag=name) for name in path], start)
        return walk() if start is not None else Selection(self, lambda: walk().rows, (("find", list(path)),))

    def find_descendants(self, path: str, start: Selection | None = None) -> Selection:
        """Elements by a path of restricted selectors, with repeats where several steps lead to one."""
        steps = mini.parse_path(path)
        return self._walk(steps, start) if start is not None else Selection(self, lambda: self._walk(steps, None).rows, (("find_descendants", path),))

    def child_path(self, names: Sequence[str], start: Selection | None = None) -> Selection:
        """The first child element of the first name, of that the first of the second, and so on."""
        found = start or self.root()
        for name in names:
            found = found.child("element", F.col("tag") == name)
        return found

    def _walk(self, path: list, start: Selection | None) -> Selection:
        if start is None and path and all(s.combinator in (" ", ">") for s in path):
            # what a step finds lies apart, so the path's order is that of the document
            root = F.col("parent_id").isNull()
            return self._in_order(self.plan().marked([root, *map(mini_column, path)], ["", *(s.combinator for s in path)], outermost=True))
        found = (start or self.root()).nodes("pre", "last", "parent_id", "sib_idx").withColumn("o", F.array(F.col("sel_ord")))
        elements = self.plan().elements
        for i, s in enumerate(path):
            own = elements.filter(mini_column(s)).select("doc_id", "node_id", "parent_id", "pre", "last", "sib_idx")
            left = found.select(*(F.col(c).alias(f"l_{c}") for c in ("doc_id", "node_id", "parent_id", "pre", "last", "sib_idx", "o")))
            same = F.col("doc_id") == F.col("l_doc_id")
            if s.combinator == " ":
                rows = own.join(left, same & (F.col("l_pre") < F.col("pre")) & (F.col("pre") <= F.col("l_last")))
                if i < len(path) - 1:  # outermost matches only
                    outer = own.select(*(F.col(c).alias(f"m_{c}") for c in ("doc_id", "pre", "last")))
                    between = (F.col("doc_id") == F.col("m_doc_id")) & (F.col("l_pre") < F.col("m_pre")) & (F.col("m_pre") < F.col("pre")) & (F.col("pre") <= F.col("m_last"))
                    rows = rows.join(outer, between, "left_anti")
            elif s.combinator == ">":
                rows = own.join(left, same & (F.col("parent_id") == F.col("l_node_id")))
            else:
                rows = own if s.combinator == "~" else None
                after = same & (F.col("parent_id") == F.col("l_parent_id")) & (F.col("l_sib_idx") < F.col("sib_idx"))
                if rows is not None:
                    rows = rows.join(left, after)
                else:
                    following = elements.select("doc_id", "node_id", "parent_id", "pre", "last", "sib_idx").join(left, after)
                    nearest = F.row_number().over(Window.partitionBy("doc_id", "l_node_id", "o").orderBy("sib_idx"))
                    following = following.withColumnRenamed("l_o", "o").withColumn("n", nearest).filter("n = 1").withColumnRenamed("o", "l_o").drop("n")
                    rows = following.join(own.select(*KEY), KEY, "left_semi")
            found = rows.select("doc_id", "node_id", "parent_id", "pre", "last", "sib_idx", F.concat("l_o", F.array("pre")).alias("o"))
        ordinal = F.row_number().over(Window.partitionBy("doc_id").orderBy("o"))
        return Selection(self, found.withColumn("sel_ord", ordinal).select("doc_id", "sel_ord", "node_id"))

    # -- whole documents --

    def render(self, output: str) -> DataFrame:
        """doc_id, value: each document as one of FOLDS."""
        return self.root().fold(output).select("doc_id", "value")

    def edit(self, targets: Selection, verb: str, *args, source: Selection | None = None) -> Nodes:
        """The table after a structural edit of the targets, numbered anew: see sylvan.markup.edit.edit.

        Where a node would come to stand below itself, its document stays as it is; see `impossible`.
        """
        steps = self._then(targets, verb, args, source)
        if steps is not None:
            return Nodes(None, base=self.base or self, steps=steps)
        rows = self.settle()
        for own, name in [(targets, "__target"), *([(source, "__source")] if source is not None else [])]:
            rows = rows.join(own.rows.select(*KEY, F.col("sel_ord").alias(name)), KEY, "left")
        return Nodes(rebuilt(rows, ((None, verb, args, None),)), partitioned=True, edited=True)

    def impossible(self, targets: Selection, source: Selection) -> DataFrame:
        """doc_id of the documents where a source is one of the targets or holds one, which no edit moves there."""
        held = source.nodes("pre", "last").select(F.col("doc_id").alias("s_doc"), F.col("pre").alias("s_pre"), F.col("last").alias("s_last"))
        inside = (F.col("doc_id") == F.col("s_doc")) & (F.col("s_pre") <= F.col("pre")) & (F.col("pre") <= F.col("s_last"))
        return targets.nodes("pre").join(held, inside, "left_semi").select("doc_id").distinct()

    def merge(self, other: Nodes) -> Nodes:
        """Documents with copies of what is in the body of other's document of the same id at the end of theirs; ids go on from the last."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows:
                return empty_rows(left.schema.field("doc_id").type)
            doc, _, extra = tree_of(columns_of(left))
            body = body_of(doc)
            new = body_of(tree_of(columns_of(right))[0]) if right.num_rows else None
            if body is not None and new is not None:
                for c in new.children:
                    body.append(copied(doc, c))
            return numbered(left, doc, extra)

        kind = self.df.schema["doc_id"].dataType.simpleString()
        right = other.settle()
        right = right.toDF(*right.columns)  # the same table may stand on both sides
        return Nodes(self.settle().groupBy("doc_id").cogroup(right.groupBy("doc_id")).applyInArrow(run, ddl(kind)), partitioned=True, edited=True)

    def validate(self) -> DataFrame:
        """doc_id, problem: where intervals, parents or positions of the table don't fit together."""
        own = self.df.filter("attached")
        up = own.select("doc_id", F.col("node_id").alias("parent_id"), F.col("pre").alias("p_pre"), F.col("last").alias("p_last"), F.col("depth").alias("p_depth"), F.col("n_child").alias("p_n"))
        rows = own.filter("parent_id is not null").join(up, ["doc_id", "parent_id"], "left")
        problem = (
            F.when(F.col("p_pre").isNull(), "no such parent")
            .when((F.col("pre") <= F.col("p_pre")) | (F.col("last") > F.col("p_last")), "outside its parent")
            .when(F.col("depth") != F.col("p_depth") + 1, "depth")
            .when(F.col("sib_idx") > F.col("p_n"), "position")
        )
        return rows.select("doc_id", problem.alias("problem")).filter("problem is not null")

    # -- attributes and classes: columns only, unless they follow other edits --

    def _where(self, targets: Selection, verb: str, args: tuple, **new: Column) -> Nodes:
        """New column values in the targets' rows; attribute columns follow attrs."""
        steps = self._then(targets, verb, args)
        if steps is not None and (self.steps or self.origin is not None):
            return Nodes(None, base=self.base or self, steps=steps)
        hit = targets.rows.select(*KEY, F.lit(True).alias("__hit"))
        rows = self.settle().join(hit, KEY, "left")
        element = F.col("__hit") & (F.col("kind") == "element")
        for name, value in new.items():
            rows = rows.withColumn(name, F.when(element, value).otherwise(F.col(name)))
        if "attrs" in new:
            rows = rows.withColumn("id_attr", F.when(element, attr_value("id")).otherwise(F.col("id_attr")))
            rows = rows.withColumn("classes", F.when(element, tokens(F.coalesce(attr_value("class"), F.lit("")))).otherwise(F.col("classes")))
        return Nodes(rows.select("doc_id", *NAMES), partitioned=True, base=self if steps else None, steps=steps or (), edited=True)

    def set_attr(self, targets: Selection, name: str, value: str) -> Nodes:
        return self._where(targets, "set_attr", (name, value), attrs=with_attr(F.col("attrs"), name, F.lit(value)))

    def remove_attrs(self, targets: Selection, names: Sequence[str]) -> Nodes:
        return self._where(targets, "remove_attrs", tuple(names), attrs=F.filter("attrs", lambda a: ~a["name"].isin(list(names)))) if names else self

    def retain_attrs(self, targets: Selection, names: Sequence[str]) -> Nodes:
        return self._where(targets, "retain_attrs", tuple(names), attrs=F.filter("attrs", lambda a: a["name"].isin(list(names)) if names else F.lit(False)))

    def remove_all_attrs(self, targets: Selection) -> Nodes:
        return self.retain_attrs(targets, [])

    def add_class(self, targets: Selection, names: str) -> Nodes:
        new = list(dict.fromkeys(names.split()))
        if not new:
            return self
        own = tokens(F.coalesce(attr_value("class"), F.lit("")))
        return self._where(targets, "add_class", (names,), attrs=with_attr(F.col("attrs"), "class", F.array_join(F.concat(own, F.array_except(F.array(*map(F.lit, new)), own)), " ")))

    def remove_class(self, targets: Selection, names: str) -> Nodes:
        old = names.split()
        if not old:
            return self
        kept = F.array_join(F.filter(tokens(F.coalesce(attr_value("class"), F.lit(""))), lambda c: ~c.isin(old)), " ")
        return self._where(targets, "remove_class", (names,), attrs=F.when(attr_value("class").isNull(), F.col("attrs")).otherwise(with_attr(F.col("attrs"), "class", kept)))

    def rename(self, targets: Selection, name: str) -> Nodes:
        """New names, and positions among siblings of one name counted anew."""
        own = self._where(targets, "rename", (name,), tag=F.lit(name))
        if own._df is None:
            return own
        rows = own.df
        alike = Window.partitionBy("doc_id", "parent_id", "ns", "tag", F.col("kind") == "element")
        place = {"type_idx": F.row_number().over(alike.orderBy("sib_idx")), "type_ridx": F.row_number().over(alike.orderBy(F.desc("sib_idx")))}
        rows = rows.withColumns({k: F.when(F.col("kind") == "element", v) for k, v in place.items()})
        return Nodes(rows.select("doc_id", *NAMES), partitioned=True, base=own.base, steps=own.steps, edited=True)


#: Columns of what is read from pages: names, Arrow types and SQL types.
MEMBER = [("sel_ord", pa.int32(), "int"), ("node_id", pa.int32(), "int")]
#: Columns of the node table that hand values on as they are, or don't hold any.
PLAIN = {"kind", "ns", "tag", "parent_id", "n_child", "n_elem", "id_attr", "text", "attached"}
VALUE, VALUE_LONG, VALUE_BOOL = ("value", pa.string(), "string"), ("value", pa.int64(), "long"), ("value", pa.bool_(), "boolean")


def dealt(df: DataFrame) -> DataFrame:
    return df.repartition(shuffle_partitions(ship(df.sparkSession)), "doc_id")


def carried_out(doc: Document, steps: tuple) -> None:
    """Edits of one document: (route, verb, arguments, source's route)."""
    for route, verb, args, source in steps:
        targets = follow(doc, route)
        edit_tree(doc, targets, verb, *((follow(doc, source),) if source is not None else args))


def stage(route: tuple, verb: str, args: tuple, source: tuple | None) -> Stage:
    """An edit as one that may be done once for several pages."""

    def find(doc: Document) -> tuple[list[Node], list[Node]]:
        return follow(doc, route), follow(doc, source) if source is not None else []

    def change(doc: Document, targets: list[Node], sources: list[Node]) -> None:
        edit_tree(doc, targets, verb, *((sources,) if source is not None else args))

    own = asked((*route, *([("add", source)] if source is not None else [])))
    return Stage(find, change, own, verb in ("add_class", "remove_class"))


def everything(doc: Document) -> Iterator[Node]:
    """All nodes, those in templates included."""
    roots = [doc.root]
    for root in roots:
        for n in root.walk():
            yield n
            if n.template is not None:
                roots.append(n.template)


def alone(id_: int, kind: str, tag: str | None = None, text: str | None = None, ns: str = HTML, attached: bool = True) -> tuple:
    """The row of a node that stands by itself."""
    node = Node(id_, kind, tag, ns if kind == "element" else None, text=text)
    return (*rows_of(Document(node))[0][:-1], attached)


def columns_of(table: pa.Table, *more: str) -> dict[str, list]:
    table = table.sort_by("pre")
    return {c: table[c].to_pylist() for c in (*NAMES, *more)}


def empty_rows(id_type: pa.DataType) -> pa.Table:
    return pa.Table.from_batches([batch_of([], [], id_type)])


def numbered(table: pa.Table, doc: Document, extra: list[Node]) -> pa.Table:
    """The rows of a document that has the id of a table."""
    return pa.Table.from_batches([batch_of([table["doc_id"][0].as_py()], [rows_of(doc, extra)], table.schema.field("doc_id").type)])


def body_of(doc: Document) -> Node | None:
    top = next((c for c in doc.root.children if c.kind == "element" and c.tag == "html"), None)
    return next((c for c in top.children if c.kind == "element" and c.tag == "body"), None) if top is not None else None


def follow(doc: Document, route: tuple) -> list[Node]:
    """The nodes at the end of a route in one document, in order: what the selection of the same steps holds.

    In a tree that serves several pages they are found once for those of which the route's selectors ask the same.
    """
    if doc.kept is None:
        return walked(doc, route)
    own = doc.kept.get(id(route)) or doc.form.kept(route, asked(route))
    return own.get(lambda: walked(doc, route))


def asked(route: tuple) -> frozenset | None:
    """What a route asks of attribute values (see match.tests); None if texts, or values in other ways, have a say in where it leads."""
    out: frozenset = frozenset()
    for step, *args in route:
        own: frozenset | None = frozenset()
        if step in ("select", "filter"):
            own = match.tests(args[0])
        elif step in ("add", "filter_selection"):
            own = asked(args[0])
        elif step == "find_descendants" and any(s.id is not None or s.classes or s.attrs for s in mini.parse_path(args[0])):
            own = None
        if own is None:
            return None
        out |= own
    return out


def walked(doc: Document, route: tuple) -> list[Node]:
    found = [doc.root]
    for step, *args in route:
        if step == "select":
            found = match.select(found, *args, doc.trees)
        elif step == "get":
            found = found[args[0] : args[0] + 1]
        elif step == "last":
            found = found[-1:]
        elif step == "parent":
            found = list({id(n.parent): n.parent for n in found if n.parent is not None}.values())
        elif step == "children":
            found = list({id(c): c for n in found for c in n.elements()}.values())
        elif step == "filter":
            hits = matching(found, *args, doc.trees)
            found = [n for n in found if id(n) in hits]
        elif step == "add":
            found = list({id(n): n for n in [*found, *follow(doc, args[0])]}.values()) if found or args[1] else []
        elif step == "filter_selection":
            both = {id(n) for n in follow(doc, args[0])}
            found = [n for n in found if id(n) in both] if both else found
        elif step == "ancestors":
            found = list({id(a): a for n in found for a in above(n, *args)}.values())
        elif step == "descendants":
            found = list({id(d): d for n in found for d in n.walk() if d is not n}.values())
        elif step == "beside":
            found = list({id(b): b for n in found if (b := beside(n, *args)) is not None}.values())
        elif step == "top":
            found = doc.root.elements()[:1]
        elif step == "part":
            found = [c for top in doc.root.elements() if top.tag == "html" for c in top.elements() if c.tag == args[0]][:1]
        else:
            found = (mini.find if step == "find" else mini.find_descendants)(doc.root, *args)
    return found


def matching(nodes: list[Node], parsed: tuple, trees: dict | None = None) -> set[int]:
    """Which of the nodes of one document match, by identity: elements, documents and fragments."""
    if not nodes:
        return set()
    top = nodes[0]
    while top.parent is not None:
        top = top.parent
    tree = match.tree_under(top, trees)
    return {id(n) for n, hit in zip(tree.nodes, tree.any([tree.complex(s) for s in parsed]), strict=True) if hit}


def above(node: Node, most: int | None, kinds: str) -> Iterator[Node]:
    """Ancestors, nearest first."""
    n = 0
    while (node := node.parent) is not None and not (most and n >= most):
        n += 1
        if kinds != "element" or node.kind == "element":
            yield node


def beside(node: Node, by: int) -> Node | None:
    """The next element sibling, or the previous one."""
    if node.parent is None:
        return None
    own = node.parent.children
    at = next(i for i, c in enumerate(own) if c is node)
    return next((c for c in (own[at + 1 :] if by > 0 else own[:at][::-1]) if c.kind == "element"), None)


def by_document(rows: DataFrame, work: Callable[[dict[str, list]], object], schema: str, batch: Callable) -> DataFrame:
    """work(columns) of every document of rows, in the order of pre; batch(ids, results, id type) gives Arrow batches of them.

    Documents come as rows that a window has put together, many to a batch, which costs far less than a group
    each; a document's first row is the one numbered 1.
    """
    numbered_ = rows.withColumn("__n", F.row_number().over(Window.partitionBy("doc_id").orderBy("pre")))
    names = numbered_.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {c: [] for c in names}
        ids, results, size, id_type = [], [], 0, None
        gc.disable()  # trees hold cycles: collecting between batches halves the work
        try:
            for more in chain(batches, [None]):
                if more is not None:
                    id_type = more.column("doc_id").type
                    held = {c: held[c] + more.column(c).to_pylist() for c in names}
                heads = [i for i, n in enumerate(held["__n"]) if n == 1] + ([len(held["__n"])] if more is None else [])
                for a, b in zip(heads, heads[1:], strict=False):
                    ids.append(held["doc_id"][a])
                    results.append(work({c: v[a:b] for c, v in held.items()}))
                    size += b - a
                    if size >= 1 << 14:
                        yield batch(ids, results, id_type)
                        ids, results, size = [], [], 0
                        gc.collect()
                if heads:
                    held = {c: v[heads[-1] :] for c, v in held.items()}
            if ids:
                yield batch(ids, results, id_type)
        finally:
            gc.enable()

    return numbered_.mapInArrow(run, schema)


def rebuilt(rows: DataFrame, steps: tuple) -> DataFrame:
    """The node table after the steps (route, verb, arguments, source's route), document by document.

    Without a route, targets and source are the rows with __target and __source, their order.
    """
    given = [c for c in ("__target", "__source") if c in rows.columns]

    def work(columns: dict[str, list]) -> list[tuple]:
        doc, nodes, extra = tree_of(columns)
        flagged = [[nodes[i] for _, i in sorted((o, i) for o, i in zip(columns[g], columns["node_id"], strict=True) if o is not None)] for g in given]
        for step in steps:
            if step[0] is None:
                targets, *more = flagged
                edit_tree(doc, targets, step[1], *(more or step[2]))
            else:
                carried_out(doc, (step,))
        return rows_of(doc, [n for n in extra if n.parent is None])

    return by_document(rows, work, ddl(rows.schema["doc_id"].dataType.simpleString()), batch_of)


def cut(df: DataFrame) -> DataFrame:
    """df from a reliable checkpoint, in the folder that spark.checkpoint.dir names; set here only where all is one machine."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sylvan-"))
    return df.checkpoint()


def matcher(selector: str | tuple) -> tuple:
    """A selector, parsed once for any number of selections."""
    return parse(selector) if isinstance(selector, str) else selector


def before(sorted_: Column, value: Column) -> Column:
    """How many of an array in order are `value` at most: a binary search."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(sorted_) + 1)).cast("int") + 1)

    def halve(a: Column, _) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        right = (a["low"] < a["high"]) & (F.get(sorted_, middle) <= value)
        return F.struct(F.when(right, middle + 1).otherwise(a["low"]).alias("low"), F.when(right | (a["low"] >= a["high"]), a["high"]).otherwise(middle).alias("high"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(sorted_).alias("high")), halve, lambda a: a["low"])


def tokens(value: Column) -> Column:
    return F.filter(F.split(value, r"[ \t\n\r\f]+"), lambda c: c != "")


def attr_value(name: str) -> Column:
    return F.get(F.filter("attrs", lambda a: a["name"] == name), F.lit(0))["value"]


def with_attr(attrs: Column, name: str, value: Column) -> Column:
    """attrs with the first of the name replaced, or a new one at the end."""
    at = F.array_position(F.transform(attrs, lambda a: a["name"]), F.lit(name))
    made = lambda a: F.struct(a["ns"].alias("ns"), a["prefix"].alias("prefix"), a["name"].alias("name"), value.alias("value"))
    none = F.lit(None).cast("string")
    new = F.array(F.struct(none.alias("ns"), none.alias("prefix"), F.lit(name).alias("name"), value.alias("value")))
    return F.when(at == 0, F.concat(attrs, new)).otherwise(F.transform(attrs, lambda a, i: F.when(i == at - 1, made(a)).otherwise(a)))


class Selection:
    """doc_id, sel_ord, node_id of the selected nodes of each document.

    path: the steps from the document that lead there, where those are known; route: the same, where edits may follow them.
    """

    def __init__(self, owner: Nodes, rows, path: tuple | None = None):
        self.owner, self._rows, self.path = owner, rows, path

    @property
    def route(self) -> tuple | None:
        return None if self.path is None or any(step[0] == "beside" for step in self.path) else self.path

    @property
    def rows(self) -> DataFrame:
        if callable(self._rows):
            read = self._fused(MEMBER, lambda own, _: [(i, n.id) for i, n in enumerate(own, 1)], "nothing")
            self._rows = self._rows() if read is None else read
        return self._rows

    def _routed(self, rows, *step) -> Selection:
        return Selection(self.owner, rows, (*self.path, step) if self.path is not None else None)

    def _with(self, rows, other: Selection, step: str, *more) -> Selection:
        """What comes of another selection of the same documents."""
        known = self.path is not None and other.path is not None and other.owner is self.owner
        return Selection(self.owner, rows, (*self.path, (step, other.path, *more)) if known else None)

    def _fused(self, fields: list[tuple], work: Callable[[list[Node], Document], list[tuple]], reads: str = "tree") -> DataFrame | None:
        """doc_id and the fields of what work(members, document) gives for each document, in one pass over the pages; None where only the table is known.

        reads: see each_document.
        """
        origin, path, steps = self.owner.origin, self.path, self.owner.steps
        if origin is None or path is None:
            return None

        def find(doc: Document) -> list[Node]:
            return follow(doc, path)

        change = (lambda doc: carried_out(doc, steps)) if steps else None
        return each_document(*origin, find, work, fields, reads=reads, tests=asked(path), change=change, stages=[stage(*step) for step in steps])

    def _read(self, columns: Sequence[str], fields: list[tuple] = (), *values: Callable[[Node], object], plain: bool = True) -> DataFrame | None:
        """doc_id, sel_ord, node_id, a field for each of the values of a member, and columns of the node table, as _fused. plain: values are handed on as they are."""
        own, at = [OWN.get(n) for n in columns], [NAMES.index(n) for n in columns]

        def work(found: list[Node], doc: Document) -> list[tuple]:
            if all(own):
                gets = (*values, *own)
                return [(i, n.id, *(f(n) for f in gets)) for i, n in enumerate(found, 1)]
            rows = {r[0]: r for r in rows_of(doc)} if found else {}
            return [(i, n.id, *(f(n) for f in values), *(rows[n.id][k] for k in at)) for i, n in enumerate(found, 1)]

        return self._fused([*MEMBER, *fields, *(FIELDS[k] for k in at)], work, "nothing" if plain and PLAIN.issuperset(columns) else "tree")

    def nodes(self, *columns: str) -> DataFrame:
        """The selected rows of the node table, all columns unless some are named, with sel_ord."""
        names = columns or tuple(n for n in NAMES if n != "node_id")
        read = self._read(names)
        if read is not None:
            return read.select(*KEY, "sel_ord", *names)
        return self.rows.join(self.owner.df.select(*KEY, *names), KEY)

    def each_attr(self, name: str) -> DataFrame:
        """doc_id, sel_ord, node_id, value: the attribute of each member."""
        read = self._read((), [VALUE], lambda n: n.attr(name))
        return read if read is not None else self.nodes("attrs").select("doc_id", "sel_ord", "node_id", attr_value(name).alias("value"))

    def _new(self, rows: DataFrame, *order) -> Selection:
        return Selection(self.owner, ranked(rows, *order))

    # -- filters and set algebra --

    def select(self, selector: str | tuple) -> Selection:
        """Matches below the members, member by member, each once; its left parts may stand above them."""
        parsed = matcher(selector)

        def rows() -> DataFrame:
            found = self.owner.plan().select(parsed).select("doc_id", "node_id", "pre")
            roots = self.nodes("pre", "last")
            if self.route is not None and all(step[0] == "select" for step in self.route):
                # members in document order: the outermost one that holds a match comes first, and matches follow in their order
                none = F.lit(None).cast("int")
                both = found.select(*KEY, "pre", none.alias("last")).unionByName(roots.select(*KEY, "pre", "last"))
                reach = F.max("last").over(Window.partitionBy("doc_id").orderBy("pre").rangeBetween(Window.unboundedPreceding, -1))
                return self.owner._in_order(both.withColumn("__r", reach).filter("last is null and __r >= pre")).rows
            roots = roots.select(F.col("doc_id").alias("l_doc_id"), F.col("pre").alias("l_pre"), "last", "sel_ord")
            inside = (F.col("doc_id") == F.col("l_doc_id")) & (F.col("l_pre") < F.col("pre")) & (F.col("pre") <= F.col("last"))
            return self._new(found.join(roots, inside), "sel_ord", "pre").rows

        return self._routed(rows, "select", parsed)

    def filter(self, selector: str) -> Selection:
        parsed = matcher(selector)

        def rows() -> DataFrame:
            own = self.owner.plan().select(parsed, self.owner.plan().holders.join(self.rows.select(*KEY), KEY, "left_semi"))
            return self._renumber(self.rows.join(own.select(*KEY), KEY, "left_semi")).rows

        return self._routed(rows, "filter", parsed)

    def try_filter(self, selector: str) -> Selection | None:
        try:
            return self.filter(selector)
        except SelectorError:
            return None

    def _renumber(self, rows: DataFrame) -> Selection:
        return Selection(self.owner, rows.withColumn("sel_ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("sel_ord"))).select("doc_id", "sel_ord", "node_id"))

    def filter_selection(self, other: Selection) -> Selection:
        """Members of both; where other has none in a document, the members unchanged."""

        def rows() -> DataFrame:
            some = other.rows.select("doc_id", F.lit(True).alias("some")).distinct()
            both = other.rows.select(*KEY, F.lit(True).alias("both"))
            return self._renumber(self.rows.join(some, "doc_id", "left").join(both, KEY, "left").filter("some is null or both")).rows

        return self._with(rows, other, "filter_selection")

    def add_selection(self, other: Selection) -> Selection:
        """Members, then those of other that aren't yet; in documents without members, other's."""

        def rows() -> DataFrame:
            return self._new(self.rows.withColumn("side", F.lit(0)).unionByName(other.rows.withColumn("side", F.lit(1))), "side", "sel_ord").rows

        return self._with(rows, other, "add", True)

    def add(self, selector: str) -> Selection:
        """Members, then the document's other matches; documents without members stay without."""
        own = self.owner.select(selector)

        def rows() -> DataFrame:
            return self.add_selection(Selection(self.owner, own.rows.join(self.rows.select("doc_id").distinct(), "doc_id", "left_semi"))).rows

        return self._with(rows, own, "add", False)

    def is_(self, selector: str) -> DataFrame:
        """doc_id, value: whether any member matches; invalid selectors match nothing."""
        hits = self.try_filter(selector)
        read = hits._fused([VALUE_BOOL], lambda own, _: [(bool(own),)], "nothing") if hits is not None else None
        if read is not None:
            return read
        found = (hits.rows if hits is not None else self.rows.limit(0)).select("doc_id", F.lit(True).alias("hit")).distinct()
        return self._documents().join(found, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("value"))

    def is_selection(self, other: Selection) -> DataFrame:
        path = other.path
        read = self._fused([VALUE_BOOL], lambda own, doc: [(not {id(n) for n in own}.isdisjoint(map(id, follow(doc, path))),)]) if path is not None and other.owner is self.owner else None
        if read is not None:
            return read
        found = self.rows.join(other.rows.select(*KEY), KEY, "left_semi").select("doc_id", F.lit(True).alias("hit")).distinct()
        return self._documents().join(found, "doc_id", "left").select("doc_id", F.coalesce("hit", F.lit(False)).alias("value"))

    def node_is(self, selector: str) -> DataFrame:
        """doc_id, sel_ord, node_id, value: of each member whether it is an element that matches; false if it isn't a selector."""
        own = self.try_filter(selector)
        hits = (own.rows if own is not None else self.rows.limit(0)).select(*KEY, F.lit(True).alias("hit"))
        rows = self.nodes("kind").join(hits, KEY, "left")
        return rows.select("doc_id", "sel_ord", "node_id", (F.coalesce("hit", F.lit(False)) & (F.col("kind") == "element")).alias("value"))

    def mini_filter(self, selector: str) -> Selection:
        """Members that match a restricted selector, a single compound."""
        return self._renumber(self.nodes().filter(mini_column(mini.parse_one(selector))).select("doc_id", "sel_ord", "node_id"))

    def mini_is(self, selector: str) -> DataFrame:
        """doc_id, value: whether any member matches a restricted selector."""
        return self.mini_filter(selector).exists()

    def _documents(self) -> DataFrame:
        return self.owner.df.filter("attached and parent_id is null").select("doc_id")

    # -- traversal --

    def _joined(self, rows: DataFrame, condition: Column, *columns: str) -> DataFrame:
        left = self.nodes(*columns).select(*(F.col(c).alias(f"l_{c}") for c in ("doc_id", "node_id", "sel_ord", *columns)))
        return rows.join(left, (F.col("doc_id") == F.col("l_doc_id")) & condition)

    def parent(self) -> Selection:
        return self._routed(lambda: self._new(self._joined(self.owner.plan().nodes, F.col("node_id") == F.col("l_parent_id"), "parent_id"), "l_sel_ord").rows, "parent")

    def children(self, kinds: str = "element", reverse: bool = False) -> Selection:
        """Children of each member in turn, from the last one back if reverse."""

        def rows() -> DataFrame:
            own = self.owner.plan().elements if kinds == "element" else self.owner.plan().nodes
            return self._new(self._joined(own, F.col("parent_id") == F.col("l_node_id")), "l_sel_ord", F.col("sib_idx") * (-1 if reverse else 1)).rows

        return self._routed(rows, "children") if kinds == "element" and not reverse else Selection(self.owner, rows)

    def ancestors(self, most: int | None = None, kinds: str = "element") -> Selection:
        """Nearest first; most counts the document node."""

        def rows() -> DataFrame:
            near = self._joined(self.owner.plan().holders, (F.col("pre") < F.col("l_pre")) & (F.col("l_pre") <= F.col("last")), "pre", "depth")
            if most:
                near = near.filter(F.col("depth") >= F.col("l_depth") - most)
            if kinds == "element":
                near = near.filter("kind = 'element'")
            return self._new(near, "l_sel_ord", -F.col("depth")).rows

        return self._routed(rows, "ancestors", most, kinds)

    def descendants(self) -> Selection:
        def rows() -> DataFrame:
            return self._new(self._joined(self.owner.plan().nodes, (F.col("l_pre") < F.col("pre")) & (F.col("pre") <= F.col("l_last")), "pre", "last"), "l_sel_ord", "pre").rows

        return self._routed(rows, "descendants")

    def next_sibling(self) -> Selection:
        return self._routed(lambda: self._beside(1).rows, "beside", 1)

    def prev_sibling(self) -> Selection:
        return self._routed(lambda: self._beside(-1).rows, "beside", -1)

    def _beside(self, by: int) -> Selection:
        """The next or previous element sibling: of elements, the one whose place is beside theirs."""
        elements = self.owner.plan().elements
        same = F.col("parent_id") == F.col("l_parent_id")
        near = self._joined(elements, same & (F.col("elem_idx") == F.col("l_elem_idx") + by), "parent_id", "elem_idx").select("doc_id", "node_id", "l_sel_ord")
        others = Selection(self.owner, self.nodes("kind").filter("kind <> 'element'").select("doc_id", "sel_ord", "node_id"))
        after = (F.col("sib_idx") - F.col("l_sib_idx")) * by > 0
        rows = others._joined(elements, same & after, "parent_id", "sib_idx")
        pick = F.min_by("node_id", F.abs(F.col("sib_idx") - F.col("l_sib_idx")))
        return self._new(near.unionByName(rows.groupBy("doc_id", "l_sel_ord").agg(pick.alias("node_id")).select("doc_id", "node_id", "l_sel_ord")), "l_sel_ord")

    def child(self, which: str = "first", condition: Column | None = None) -> Selection:
        """One child each: the first or last of any kind, or the first element (that meets a condition)."""
        plan = self.owner.plan()
        rows, own = (plan.elements, F.col("elem_idx") == 1) if which == "element" else (plan.nodes, F.col("sib_idx") == (1 if which == "first" else F.col("l_n_child")))
        child = F.col("parent_id") == F.col("l_node_id")
        if condition is None:
            return self._new(self._joined(rows, child & own, "n_child"), "l_sel_ord")
        near = self._joined(rows.filter(condition), child).groupBy("doc_id", "l_sel_ord")
        return self._new(near.agg((F.max_by if which == "last" else F.min_by)("node_id", "sib_idx").alias("node_id")), "l_sel_ord")

    def siblings(self, which: str) -> Selection:
        """Of any kind: next, previous, or last (none for a node that is the last)."""
        nodes = self.owner.plan().nodes
        if which == "last":
            up = self.owner.plan().holders.select(F.col("doc_id").alias("u_doc"), F.col("node_id").alias("u_id"), F.col("n_child").alias("u_n"))
            nodes = nodes.join(up, (F.col("doc_id") == F.col("u_doc")) & (F.col("parent_id") == F.col("u_id")) & (F.col("sib_idx") == F.col("u_n")))
        by = {"next": F.col("sib_idx") == F.col("l_sib_idx") + 1, "previous": F.col("sib_idx") == F.col("l_sib_idx") - 1, "last": F.col("sib_idx") > F.col("l_sib_idx")}[which]
        return self._new(self._joined(nodes, (F.col("parent_id") == F.col("l_parent_id")) & by, "parent_id", "sib_idx"), "l_sel_ord")

    def first(self) -> Selection:
        return self.get(0)

    def last(self) -> Selection:
        return self._routed(lambda: self.rows.groupBy("doc_id").agg(F.max_by("node_id", "sel_ord").alias("node_id")).select("doc_id", F.lit(1).alias("sel_ord"), "node_id"), "last")

    def get(self, index: int) -> Selection:
        return self._routed(lambda: self.rows.filter(F.col("sel_ord") == index + 1).select("doc_id", F.lit(1).alias("sel_ord"), "node_id"), "get", index)

    def length(self) -> DataFrame:
        """doc_id, value: members of every document, 0 where there are none."""
        read = self._fused([VALUE_LONG], lambda own, _: [(len(own),)], "nothing")
        if read is not None:
            return read
        own = self.rows.groupBy("doc_id").agg(F.count("*").alias("n"))
        return self._documents().join(own, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).cast("long").alias("value"))

    def exists(self) -> DataFrame:
        return self.length().select("doc_id", (F.col("value") > 0).alias("value"))

    # -- getters of the first member --

    def attr(self, name: str, default: str | None = None) -> DataFrame:
        value = self.first().each_attr(name)
        return value.select("doc_id", F.coalesce("value", F.lit(default)).alias("value") if default is not None else "value")

    def attrs(self) -> DataFrame:
        return self.first().nodes("attrs").select("doc_id", F.transform("attrs", lambda a: F.struct(a["name"], a["value"])).alias("value"))

    def id_attr(self) -> DataFrame:
        return self.attr("id")

    def class_attr(self) -> DataFrame:
        return self.attr("class")

    def has_attr(self, name: str) -> DataFrame:
        return self.first().nodes("attrs").select("doc_id", F.coalesce(F.exists("attrs", lambda a: a["name"] == name), F.lit(False)).alias("value"))

    def has_class(self, name: str) -> DataFrame:
        """Whether any member has the class."""
        read = self._fused([VALUE_BOOL], lambda own, _: [(any(name in classes_of(n) for n in own if n.kind == "element"),)] if own else [])
        if read is not None:
            return read
        return self.nodes("classes").groupBy("doc_id").agg(F.coalesce(F.bool_or(F.array_contains("classes", name)), F.lit(False)).alias("value"))

    # -- text --

    def text(self, *columns: str) -> DataFrame:
        """doc_id, sel_ord, node_id, value: the text below each member, in order; then the columns of the node table that are named.

        A document's pieces of text are one array, of which each member has a slice.
        """
        read = self._read(columns, [VALUE], Node.string)
        if read is not None:
            return read
        nodes = self.owner.plan().nodes.filter("kind = 'text'").select("doc_id", "pre", "text")
        pieces = nodes.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pre", "text"))).alias("__t"))
        pieces = pieces.select("doc_id", F.transform("__t", lambda t: t["pre"]).alias("__at"), F.transform("__t", lambda t: t["text"]).alias("__t"))
        rows = self.nodes("pre", "last", *columns).join(pieces, "doc_id", "left")
        start, end = before(F.col("__at"), F.col("pre") - 1), before(F.col("__at"), F.col("last"))
        value = F.array_join(F.slice("__t", start + 1, end - start), "")
        return rows.select("doc_id", "sel_ord", "node_id", F.coalesce(value, F.lit("")).alias("value"), *columns)

    def immediate_text(self) -> DataFrame:
        read = self._read((), [VALUE], FOLDS["immediate_text"])
        if read is not None:
            return read
        texts = self.owner.plan().nodes.filter("kind = 'text'").select(F.col("doc_id").alias("t_doc_id"), F.col("parent_id").alias("t_parent"), F.col("node_id").alias("t_id"), F.col("pre").alias("t_pre"), F.col("text").alias("t_text"))
        own = (F.col("doc_id") == F.col("t_doc_id")) & ((F.col("t_parent") == F.col("node_id")) | (F.col("t_id") == F.col("node_id")))
        return self._concat(self.rows.join(texts, own, "left"))

    def _concat(self, rows: DataFrame) -> DataFrame:
        parts = F.array_sort(F.collect_list(F.when(F.col("t_pre").isNotNull(), F.struct("t_pre", "t_text"))))
        return rows.groupBy("doc_id", "sel_ord", "node_id").agg(F.array_join(F.transform(parts, lambda t: t["t_text"]), "").alias("value"))

    def text_joined(self) -> DataFrame:
        """doc_id, value: the members' texts one after the other, which repeats what overlaps."""
        read = self._fused([VALUE], lambda own, _: [("".join(n.string() for n in own),)] if own else [])
        if read is not None:
            return read
        parts = F.array_sort(F.collect_list(F.struct("sel_ord", "value")))
        return self.text().groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda t: t["value"]), "").alias("value"))

    def char_count(self) -> DataFrame:
        """Characters with each run of white space as one, and none at the ends."""
        one = F.regexp_replace("value", f"{SPACE}+", " ")
        return self.text().select("doc_id", "sel_ord", "node_id", F.length(F.btrim(one)).cast("long").alias("value"))

    def fold(self, output: str, **options) -> DataFrame:
        """doc_id, sel_ord, node_id, value: each member written as one of FOLDS (markdown: with skip), document by document."""
        fold = FOLDS[output]
        read = self._read((), [VALUE], lambda n: str(fold(n, **options)), plain=False)
        if read is not None:
            return read
        own = self.rows
        rows = self.owner.df.join(own.select("doc_id").distinct(), "doc_id", "left_semi").join(own, KEY, "left")

        def work(columns: dict[str, list]) -> list[tuple]:
            _, nodes, _ = tree_of(columns)
            return [(o, i, str(fold(nodes[i], **options))) for o, i in sorted((o, i) for o, i in zip(columns["sel_ord"], columns["node_id"], strict=True) if o is not None)]

        def batch(ids: list, results: list[list[tuple]], id_type: pa.DataType) -> pa.RecordBatch:
            ordinal, node, value = zip(*(r for own in results for r in own), strict=True) if any(results) else ((), (), ())
            owner = pa.array([i for i, own in zip(ids, results, strict=True) for _ in own], id_type)
            return pa.RecordBatch.from_arrays([owner, pa.array(ordinal, pa.int32()), pa.array(node, pa.int32()), pa.array(value, pa.string())], names=["doc_id", "sel_ord", "node_id", "value"])

        kind = self.owner.df.schema["doc_id"].dataType.simpleString()
        return by_document(rows, work, f"doc_id {kind}, sel_ord int, node_id int, value string", batch)

    def _of_first(self, output: str, default: str | None) -> DataFrame:
        """doc_id, value of the first member of every document; default where there is none."""
        read = self.first()._fused([VALUE], lambda own, doc: [(str(written(output, own[0], doc)) if own else default,)], "form" if output in ("html", "inner_html") else "tree")
        if read is not None:
            return read
        own = self.first().fold(output).select("doc_id", "value")
        return self._documents().join(own, "doc_id", "left").select("doc_id", F.coalesce("value", F.lit(default)).alias("value"))

    def html(self) -> DataFrame:
        return self._of_first("html", "")

    def inner_html(self) -> DataFrame:
        return self._of_first("inner_html", "")

    def try_html(self) -> DataFrame:
        """As html, and null where there is no member."""
        return self._of_first("html", None)

    def try_inner_html(self) -> DataFrame:
        return self._of_first("inner_html", None)

    def to_fragment(self) -> Nodes:
        """New documents: the whole one if the first member is its root or html, else a fragment with a copy of its subtree."""
        own = self.first().rows
        rows = self.owner.settle().join(own.select("doc_id", F.col("node_id").alias("__first")), "doc_id")

        def work(columns: dict[str, list]) -> list[tuple]:
            doc, nodes, extra = tree_of(columns)
            node = nodes[columns["__first"][0]]
            if node is not doc.root and node.tag != "html":
                new = Document(Node(0, "fragment"))
                context, top = new.new("element", tag="body", ns=HTML), new.new("element", tag="html", ns=HTML)
                new.root.append(top)
                top.append(copied(new, node))
                doc, extra = new, [context]
            return rows_of(doc, extra)

        kind = self.owner.df.schema["doc_id"].dataType.simpleString()
        return Nodes(by_document(rows, work, ddl(kind), batch_of), partitioned=True, edited=True)

    # -- edits --

    def edit(self, verb: str, *args, source: Selection | None = None) -> Nodes:
        return self.owner.edit(self, verb, *args, source=source)


def matches(selector: str) -> Column:
    """A compound selector as a condition on node rows."""
    own = [compound_column(s.compounds[0]) if len(s.compounds) == 1 else None for s in parse(selector)]
    if any(c is None for c in own):
        raise SelectorError(f"{selector!r} needs other rows")
    out = own[0]
    for c in own[1:]:
        out = out | c
    return out


def checked(nodes: Nodes) -> DataFrame:
    """doc_id, problems of the links between nodes, rebuilt document by document."""
    read = nodes.root()._fused([("problems", pa.int64(), "long")], lambda _, doc: [(len(violations(doc)),)])
    if read is not None:
        return read

    def batch(ids: list, results: list[int], id_type: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids, id_type), pa.array(results, pa.int64())], names=["doc_id", "problems"])

    return by_document(nodes.df, lambda columns: len(violations(tree_of(columns)[0])), f"doc_id {nodes.df.schema['doc_id'].dataType.simpleString()}, problems long", batch)
