"""Selectors as plans over a node table: filters, semi joins and anti joins.

Positions are columns, so structural pseudo-classes are filters. A selector whose compounds are all
conditions on a row is one pass: rows that meet any of them are marked step by step by windows within
the document, since a node lies below a marked one exactly if the greatest end of the marked ones before
it reaches it. Work goes by rows, not by pairs of them. Other selectors are left semi joins on the
document. Windows and joins hold doc_id, so a table that is partitioned by it is never shuffled again.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sylvan.css.match import CASELESS
from sylvan.css.mini import Mini
from sylvan.css.parser import NEVER, Attr, Complex, Compound, Pseudo, parse

KEY = ["doc_id", "node_id"]
PLACE = ["doc_id", "node_id", "parent_id", "pre", "last", "elem_idx"]


def literal_op(op: str, value: Column, want: str) -> Column:
    if op == "=":
        return value == want
    if op == "|=":
        return (value == want) | value.startswith(want + "-")
    if not want:
        return F.lit(False)
    if op == "~=":
        return F.array_contains(F.split(value, r"[ \t\n\r\f]+"), want)
    return value.startswith(want) if op == "^=" else value.endswith(want) if op == "$=" else value.contains(want)


def attr_column(test: Attr) -> Column:
    def holds(a: Column) -> Column:
        own = a["name"] == test.name if not test.any_ns else F.lower(a["name"]) == test.name
        own = own & (a["ns"].isNull() if not test.any_ns else F.lit(True))
        if test.op is None:
            return own
        if test.ignore_case or test.name in CASELESS:
            folded = literal_op(test.op, F.lower(a["value"]), test.value.lower())
            return own & (folded if test.ignore_case else F.when(F.col("ns") == "html", folded).otherwise(literal_op(test.op, a["value"], test.value)))
        return own & literal_op(test.op, a["value"], test.value)

    return F.coalesce(F.exists("attrs", holds), F.lit(False))


def nth_column(place: Column, a: int, b: int) -> Column:
    if a == 0:
        return place == b
    return (F.pmod(place - b, F.lit(abs(a))) == 0) & ((place - b >= 0) if a > 0 else (place - b <= 0))


def pseudo_column(p: Pseudo) -> Column | None:
    """A pseudo-class as a condition on the row; None where it needs other rows."""
    name = p.name
    if name in NEVER:
        return F.lit(False)
    if name in ("root", "scope"):
        return F.col("kind") == "document"
    places = {"first-child": ("elem_idx", 0, 1), "last-child": ("elem_ridx", 0, 1), "first-of-type": ("type_idx", 0, 1), "last-of-type": ("type_ridx", 0, 1)}
    places |= {"nth-child": ("elem_idx", p.a, p.b), "nth-last-child": ("elem_ridx", p.a, p.b), "nth-of-type": ("type_idx", p.a, p.b), "nth-last-of-type": ("type_ridx", p.a, p.b)}
    if name in places:
        column, a, b = places[name]
        return F.coalesce(nth_column(F.col(column), a, b), F.lit(False))
    if name == "only-child":
        return F.coalesce((F.col("elem_idx") == 1) & (F.col("elem_ridx") == 1), F.lit(False))
    if name == "only-of-type":
        return F.coalesce((F.col("type_idx") == 1) & (F.col("type_ridx") == 1), F.lit(False))
    if name == "empty":
        return (F.col("kind") == "element") & (F.col("n_elem") == 0) & (F.col("n_solid") == 0)
    if name == "only-text":
        return (F.col("kind") == "element") & (F.col("n_child") == 1) & (F.col("n_solid") == 1)
    if name in ("any-link", "link"):
        return F.coalesce(F.col("tag").isin("a", "area", "link") & F.exists("attrs", lambda a: a["name"] == "href"), F.lit(False))
    if name in ("not", "is", "where"):
        own = [compound_column(s.compounds[0]) if len(s.compounds) == 1 else None for s in p.selectors]
        if any(c is None for c in own):
            return None
        some = reduce(or_, own, F.lit(False))
        return ~some if name == "not" else some
    return None


def compound_column(c: Compound) -> Column | None:
    """A compound as one condition on the row; None where a part needs other rows."""
    parts = [pseudo_column(p) for p in c.pseudos]
    return None if any(p is None for p in parts) else reduce(lambda a, b: a & b, parts, simple_column(c))


def simple_column(c: Compound) -> Column:
    own = F.lit(True)
    if c.tag is not None:
        html = F.coalesce(F.col("tag") == (c.tag.lower()), F.lit(False))
        own = own & (html if c.tag == c.tag.lower() else F.when(F.col("ns") == "html", html).otherwise(F.coalesce(F.col("tag") == c.tag, F.lit(False))))
        own = own & (F.col("kind") == "element")
    if c.ns == "":
        own = own & (F.col("kind") != "element")
    for i in c.ids:
        own = own & F.coalesce(F.col("id_attr") == i, F.lit(False))
    for k in c.classes:
        own = own & F.coalesce(F.array_contains("classes", k), F.lit(False))
    for a in c.attrs:
        own = own & attr_column(a)
    return own


def beside(left: DataFrame, combinator: str) -> tuple[DataFrame, Column]:
    """The left side of a combinator with its columns renamed, and the condition that joins it."""
    a = left.select(*(F.col(c).alias(f"l_{c}") for c in PLACE))
    same = F.col("doc_id") == F.col("l_doc_id")
    if combinator == " ":
        return a, same & (F.col("l_pre") < F.col("pre")) & (F.col("pre") <= F.col("l_last"))
    if combinator == ">":
        return a, same & (F.col("parent_id") == F.col("l_node_id"))
    near = F.col("elem_idx") == F.col("l_elem_idx") + 1 if combinator == "+" else F.col("l_elem_idx") < F.col("elem_idx")
    return a, same & (F.col("parent_id") == F.col("l_parent_id")) & near


def mirrored(right: DataFrame, combinator: str) -> tuple[DataFrame, Column]:
    """The right side of a combinator, for nodes that have it to their right."""
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in PLACE))
    same = F.col("doc_id") == F.col("r_doc_id")
    if combinator == " ":
        return b, same & (F.col("pre") < F.col("r_pre")) & (F.col("r_pre") <= F.col("last"))
    if combinator == ">":
        return b, same & (F.col("r_parent_id") == F.col("node_id"))
    near = F.col("r_elem_idx") == F.col("elem_idx") + 1 if combinator == "+" else F.col("elem_idx") < F.col("r_elem_idx")
    return b, same & (F.col("r_parent_id") == F.col("parent_id")) & near


class Plan:
    """Compiles selectors over one node table."""

    def __init__(self, nodes: DataFrame):
        self.nodes = nodes.filter("attached")
        self.elements = self.nodes.filter("kind = 'element'")
        self.holders = self.nodes.filter("kind in ('element', 'document', 'fragment')")

    def compound(self, rows: DataFrame, c: Compound) -> DataFrame:
        rows = rows.filter(simple_column(c))
        for p in c.pseudos:
            own = pseudo_column(p)
            rows = rows.filter(own) if own is not None else self.relational(rows, p)
        return rows

    def relational(self, rows: DataFrame, p: Pseudo) -> DataFrame:
        if p.name in ("not", "is", "where"):
            return rows.join(self.union(p.selectors, self.holders), KEY, "left_anti" if p.name == "not" else "left_semi")
        if p.name == "has":
            found = [rows.join(*mirrored(self.leftmost(s), s.combinators[0]), "left_semi").select(*KEY) for s in p.selectors]
            return rows.join(reduce(DataFrame.unionByName, found).distinct(), KEY, "left_semi") if len(found) > 1 else rows.join(*mirrored(self.leftmost(p.selectors[0]), p.selectors[0].combinators[0]), "left_semi")
        texts = self.nodes.filter("kind = 'text'").select("doc_id", "pre", "text")
        b = texts.select(F.col("doc_id").alias("r_doc_id"), F.col("pre").alias("r_pre"), F.col("text").alias("r_text"))
        inside = (F.col("doc_id") == F.col("r_doc_id")) & (F.col("pre") < F.col("r_pre")) & (F.col("r_pre") <= F.col("last"))
        if p.name == "has-text":
            return rows.join(b.filter(F.col("r_text").contains(p.text)), inside, "left_semi")
        whole = rows.select(*KEY, "pre", "last").join(b, inside, "left").groupBy(*KEY)  # contains
        joined = whole.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_pre", "r_text"))), lambda t: t["r_text"]), "").alias("t"))
        return rows.join(joined.filter(F.col("t").contains(p.text)).select(*KEY), KEY, "left_semi")

    def leftmost(self, s: Complex) -> DataFrame:
        """Nodes that match the first compound of a relative selector and have the others to their right."""
        right = self.compound(self.elements, s.compounds[-1])
        for c, combinator in zip(reversed(s.compounds[:-1]), reversed(s.combinators[1:]), strict=True):
            right = self.compound(self.elements, c).join(*mirrored(right, combinator), "left_semi")
        return right

    def marked(self, conditions: list[Column], combinators: list[str], outermost: bool = False) -> DataFrame:
        """Rows of PLACE that meet the last condition and have the others to their left, one by one through the combinators.

        outermost: a descendant step before the last takes no match that lies in another.
        """
        rows = self.holders.select(*PLACE, *(F.coalesce(c, F.lit(False)).alias(f"__{i}") for i, c in enumerate(conditions)))
        rows = rows.filter(reduce(or_, (F.col(f"__{i}") for i in range(len(conditions)))))
        before = Window.partitionBy("doc_id").orderBy("pre").rowsBetween(Window.unboundedPreceding, -1)
        beside = Window.partitionBy("doc_id", "parent_id").orderBy("elem_idx")
        mark = F.col("__0")
        ends = lambda: F.coalesce(F.max(F.when(F.col("__m"), F.col("last"))).over(before), F.lit(-1))
        for i, combinator in enumerate(combinators):
            if i:
                rows = rows.withColumn("__m", mark)
                if outermost and combinators[i - 1] == " ":
                    rows = rows.withColumn("__e", ends()).withColumn("__m", F.col("__m") & (F.col("__e") < F.col("pre"))).drop("__e")
                if combinator == " ":
                    rows = rows.withColumn("__r", ends() >= F.col("pre"))
                elif combinator == ">":  # a marked row also stands among its children
                    own = F.struct(F.col("parent_id").alias("k"), F.lit(False).alias("above"))
                    up = F.struct(F.col("node_id").alias("k"), F.lit(True).alias("above"))
                    rows = rows.withColumn("__k", F.explode(F.when(F.col("__m"), F.array(own, up)).otherwise(F.array(own))))
                    rows = rows.withColumns({"__a": F.col("__k.above"), "__k": F.col("__k.k")})
                    rows = rows.withColumn("__r", F.max("__a").over(Window.partitionBy("doc_id", "__k"))).filter(~F.col("__a")).drop("__k", "__a")
                elif combinator == "+":
                    last = F.lag(F.when(F.col("__m"), F.col("elem_idx"))).over(beside)
                    rows = rows.withColumn("__r", F.coalesce(last == F.col("elem_idx") - 1, F.lit(False)))
                else:
                    some = F.max("__m").over(beside.rowsBetween(Window.unboundedPreceding, -1))
                    rows = rows.withColumn("__r", F.coalesce(some, F.lit(False)))
                mark = F.col("__r") & F.col(f"__{i}")
        return rows.filter(mark).select(*PLACE)

    def complex(self, s: Complex, last: DataFrame) -> DataFrame:
        own = [compound_column(c) for c in s.compounds]
        if len(own) > 1 and all(c is not None for c in own):
            own[-1] = own[-1] & (F.col("kind") == "element") if last is self.elements else own[-1]
            rows = self.marked(own, list(s.combinators))
            return rows if last is self.elements or last is self.holders else last.join(rows.select(*KEY), KEY, "left_semi")
        left = None
        for i, (c, combinator) in enumerate(zip(s.compounds, s.combinators, strict=True)):
            own = self.compound(last if i == len(s.compounds) - 1 else self.holders, c)
            left = own if left is None else own.join(*beside(left, combinator), "left_semi")
        return left

    def union(self, selectors: tuple, last: DataFrame) -> DataFrame:
        return reduce(DataFrame.unionByName, [self.complex(s, last).select(*KEY) for s in selectors]).distinct() if selectors else self.nodes.select(*KEY).limit(0)

    def select(self, selectors: tuple | str, rows: DataFrame | None = None) -> DataFrame:
        """Rows (elements, unless given) that match one of the selectors."""
        parsed = parse(selectors) if isinstance(selectors, str) else selectors
        rows = self.elements if rows is None else rows
        if len(parsed) == 1:
            return self.complex(parsed[0], rows)
        own = [compound_column(s.compounds[0]) if len(s.compounds) == 1 else None for s in parsed]
        if all(c is not None for c in own):
            return rows.filter(reduce(or_, own))
        return rows.join(self.union(parsed, rows), KEY, "left_semi")


def mini_column(s: Mini) -> Column:
    own = F.col("kind") == "element"
    if s.tag is not None:
        own = own & (F.col("tag") == s.tag)
    if s.id is not None:
        own = own & F.coalesce(F.col("id_attr") == s.id, F.lit(False))
    for c in s.classes:
        own = own & F.coalesce(F.array_contains("classes", c), F.lit(False))
    for name, op, want in s.attrs:
        test = (lambda n, o, w: lambda a: (a["name"] == n) & (F.lit(True) if o is None else (F.length(a["value"]) > 0) & literal_op(o, a["value"], w)))(name, op, want)
        own = own & F.coalesce(F.exists("attrs", test), F.lit(False))
    return own
