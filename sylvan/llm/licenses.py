"""Licence scans: Dice coefficient over word bigrams between the parts of a text and licence templates.

Parts are every line, every block of neighbouring lines that aren't blank (where it has several) and
the whole text (where it has several blocks). Normalised words are lower-case runs of letters and
digits; a part is its set of bigrams. Two sets of a and b bigrams with m in common have the
coefficient 2 m / (a + b), which can reach t only if a / b lies between t / (2 - t) and its inverse:
templates outside those bounds are never compared.

Only DataFrame functions, all within a row: no shuffle, and no row is matched with another, so hot
sources and common lines cost nothing more. Templates are a bounded constant.

Null or empty texts match nothing, as do parts of one word. Repeated rows give repeated results; of
templates with one name the best counts, then the first. Empty tables give empty results. Only the
text is read; the result's columns start with __sv_.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.license_templates import TEMPLATES
from sylvan.llm.quality import RUN, found, let

TOKEN = r"[\p{L}\p{N}]+"


def bigrams(text: Column) -> Column:
    """The set of bigrams of a text, as an array."""
    return F.array_distinct(found(F.array_join(found(F.lower(text), TOKEN), " "), RUN % 1, 1))


def template_set(templates: Sequence[tuple[str, str]]) -> Column:
    """A constant array of (name, bigrams), without templates of one word."""
    rows = []
    for name, text in templates:
        words = re.findall(r"[^\W_]+", text.lower())
        pairs = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))
        if pairs:
            rows.append(F.struct(F.lit(name).alias("name"), F.split(F.lit("\n".join(pairs)), "\n").alias("bigrams")))
    return F.array(*rows)


def parts(text: Column) -> Column:
    """Array of (unit, index, bigrams): lines and blocks are counted from 0."""

    def unit(name: str, values: Column) -> Column:
        return F.transform(values, lambda x, i: F.struct(F.lit(name).alias("unit"), i.alias("index"), bigrams(x).alias("bigrams")))

    lines = F.split(text, "\n")
    blocks = F.filter(F.split(text, r"\n[\x20\x09\x0B-\x0D]*(?=\n)"), lambda b: b.rlike(r"[^\x20\x09-\x0D]"))
    many = F.filter(F.transform(blocks, lambda b: F.btrim(b, F.lit("\n"))), lambda b: F.instr(b, "\n") > 0)
    whole = F.when(F.size(blocks) > 1, F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.filter(F.concat(unit("line", lines), unit("block", many), unit("text", whole)), lambda p: F.size(p["bigrams"]) > 0)


def scan(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.8, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """docs with __sv_matches: array of (unit, index, name, common, size, template_size, dice)."""
    known = template_set(templates)

    def matches(part: Column) -> Column:
        own, n = part["bigrams"], F.size(part["bigrams"])
        near = F.filter(known, lambda t: (n >= F.size(t["bigrams"]) * (threshold / (2 - threshold))) & (n * (threshold / (2 - threshold)) <= F.size(t["bigrams"])))
        rows = F.transform(near, lambda t: F.struct(t["name"].alias("name"), F.size(F.array_intersect(own, t["bigrams"])).cast("long").alias("common"), F.size(t["bigrams"]).cast("long").alias("b")))
        rows = F.transform(rows, lambda r: F.struct(part["unit"].alias("unit"), part["index"].cast("long").alias("index"), r["name"].alias("name"), r["common"].alias("common"), n.cast("long").alias("size"), r["b"].alias("template_size"), (2 * r["common"] / (n + r["b"])).alias("dice")))
        return F.filter(rows, lambda r: r["dice"] >= threshold)

    def best(rows: Column) -> Column:
        """Of matches of one part and name, the best; the first of equals."""
        beaten = lambda r, i: F.exists(F.transform(rows, lambda q, j: F.struct(q.alias("q"), j.alias("j"))), lambda x: (x["q"]["name"] == r["name"]) & ((x["q"]["dice"] > r["dice"]) | (x["q"]["dice"] == r["dice"]) & (x["j"] < i)))
        return F.filter(rows, lambda r, i: ~beaten(r, i))

    found_ = F.flatten(F.transform(parts(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), lambda p: let(matches(p), best)))
    return docs.withColumn("__sv_matches", found_)


ORACLE = """
WITH lines AS (
  SELECT rid, doc_id, text, string_split(text, chr(10)) AS l, list_filter(string_split_regex(text, '\\n[ \\t\\x0B-\\x0D]*\\n([ \\t\\x0B-\\x0D]*\\n)*'), lambda x: regexp_matches(x, '[^ \\t-\\r]')) AS b
  FROM (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents)
), parts AS (
  SELECT rid, 'line' AS unit, generate_subscripts(l, 1) - 1 AS idx, unnest(l) AS t FROM lines
  UNION ALL
  SELECT rid, 'block', generate_subscripts(m, 1) - 1, unnest(m) FROM (SELECT rid, list_filter(list_transform(b, lambda x: trim(x, chr(10))), lambda x: contains(x, chr(10))) AS m FROM lines)
  UNION ALL
  SELECT rid, 'text', 0, text FROM lines WHERE len(b) > 1
), words AS (
  SELECT rid, unit, idx, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w FROM parts
), sets AS (
  SELECT rid, unit, idx, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g FROM words WHERE len(w) > 1
), templates AS (
  SELECT k, name, list_distinct(list_transform(generate_series(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1])) AS g
  FROM (SELECT k, name, regexp_extract_all(lower(t), '[\\p{L}\\p{N}]+') AS w FROM (VALUES %s) v(k, name, t))
), hits AS (
  SELECT rid, unit, idx, name, max(dice) AS dice FROM (
    SELECT s.rid, s.unit, s.idx, t.name, 2 * len(list_intersect(s.g, t.g)) / (len(s.g) + len(t.g)) AS dice
    FROM sets s, templates t WHERE len(s.g) >= len(t.g) * 0.6666666666 AND len(t.g) >= len(s.g) * 0.6666666666
  ) WHERE dice >= 0.8 GROUP BY ALL
)
SELECT d.doc_id, count(h.name) AS n_matches, coalesce(string_agg(DISTINCT h.name, ',' ORDER BY h.name), '') AS licenses,
  coalesce(string_agg(h.unit || ':' || h.idx || ':' || h.name, ',' ORDER BY h.unit, h.idx, h.name), '') AS matches, coalesce(max(h.dice), 0) AS best_dice
FROM lines d LEFT JOIN hits h USING (rid) GROUP BY d.rid, d.doc_id
""" % ", ".join(f"({k}, '{name}', '{text}')" for k, (name, text) in enumerate(TEMPLATES))
