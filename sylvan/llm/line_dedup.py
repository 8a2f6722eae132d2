"""Line dedup across documents by deletion neighbourhoods.

A line's words are its runs of other than white space, with A-Z lower-cased; every line with a word is
compared. An occurrence goes if an earlier occurrence, in the order of id, text hash and line number,
has the same words, or is one edit away: a unit replaced, added or left out, where one edit is an eighth
of the line at most. Units are words in lines of `near_words` words or more; in shorter lines, where a
word would be too much, they are the characters of the words joined by single spaces, from `near_chars`
characters on; lines shorter than that are compared for equality. Lines of words and lines of characters
aren't near each other. Lines between which nothing earlier is that close stay: of a group, the earliest.

Equal lines meet in a minimum by a 128-bit hash, which combines before its shuffle, so a line that
stands everywhere is one row a task. For the rest each distinct line emits all its variants with one
unit deleted, as hashed keys, and itself: lines with a unit replaced share a variant at one place, a
line and the same line with a unit more share one as a whole. Partners are the least of each key,
never pairs of a group, and their edit distance is verified on the units. Only lines that share the
first or last units of half a line with another line need to emit variants, since one edit leaves a
half whole; that test loses none.

Null or empty texts have no lines to compare. Rows equal in id and text are one occurrence and share
their fate. Null ids come last. Empty tables give empty results. Internal columns start with __sv_.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from sylvan.llm.common import WORD, materialize, row_key, ship, slices, utf8
from sylvan.llm.quality import let

MULTIPLIER = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2 ** 64
INVERSE = pow(MULTIPLIER, -1, 1 << 64)
FEW = 1 << 20  # lines that may have a partner, up to which their hashes are broadcast to spare the others' words


def units(words: list[bytes], near_words: int, near_chars: int) -> tuple[list[bytes], bytes]:
    """What a line's edits count, and what stands between them; none in a line that is too short for an edit."""
    if len(words) >= near_words:
        return words, b" "
    text = b" ".join(words).decode()
    return ([c.encode() for c in text] if len(text) >= near_chars else []), b""


def halves(own: list[bytes], between: bytes) -> list[int]:
    """Hashes of the first and last units of half a line, for lines as long and for those one longer or shorter."""
    n, out = len(own), []
    for m in {(n - 1) // 2, (n - 2) // 2} if n else ():
        for side, part in ((b"<", own[:m]), (b">", own[n - m :])):
            out.append(xxhash.xxh64_intdigest(side + between + b"|" + between.join(part), m) - (1 << 63))
    return out


def deletions(own: list[bytes], between: bytes) -> tuple[np.ndarray, int]:
    """Hashes of the line without its i-th unit, for each i, and of the line."""
    seed = len(between)
    h = np.array([xxhash.xxh64_intdigest(w, seed) for w in own], np.uint64)
    powers = np.full(len(h), MULTIPLIER, np.uint64)
    powers[0] = 1
    powers = np.multiply.accumulate(powers)
    sums = np.cumsum(h * powers)
    before = np.concatenate([[np.uint64(0)], sums[:-1]]).astype(np.uint64)
    return (before + (sums[-1] - sums) * np.uint64(INVERSE)).view(np.int64), int(sums[-1].view(np.int64))


def scan(docs: DataFrame, id_col: str, text_col: str, names: list[str], kinds: str, batch_bytes: int, row) -> DataFrame:
    """A pass over all lines: row(words) gives the values of a line, or None to leave it out; then come its place's columns."""
    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    types = {"binary": pa.binary(), "long": pa.int64(), "array<long>": pa.list_(pa.int64())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = row()
        for batch in batches:
            for part in slices(batch, "__sv_text", batch_bytes):
                owner, place, values = [], [], []
                for i, t in enumerate(utf8(part.column("__sv_text"))):
                    for j, line in enumerate(t.lower().split(b"\n")):
                        own = make(line.split())
                        if own is not None:
                            owner.append(i)
                            place.append(j)
                            values.append(own)
                ids = pa.array(owner, pa.int32())
                columns = [pa.array([v[k] for v in values], types[t]) for k, t in enumerate(kinds.split())]
                yield pa.RecordBatch.from_arrays([*columns, part.column(0).take(ids), part.column(1).take(ids), pa.array(place, pa.int32())], names=[*names, "__sv_id", "__sv_hash", "__sv_line"])

    rows = docs.select(*row_key(id_col, text_col), F.col(f"`{text_col}`").alias("__sv_text"))
    own = ", ".join(f"{n} {k}" for n, k in zip(names, kinds.split(), strict=True))
    return rows.mapInArrow(run, f"{own}, __sv_id {kind}, __sv_hash long, __sv_line int")


def variants(lines: DataFrame, near_words: int, near_chars: int) -> DataFrame:
    """Of lines (short, words): key, place of the deleted unit (-1: none), short."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "words", 1 << 20):
                keys, place, owner = [], [], []
                short = part.column(0).to_numpy(zero_copy_only=False)
                for i, text in enumerate(utf8(part.column("words"))):
                    less, own = deletions(*units(text.split(), near_words, near_chars))
                    keys += [less, [own]]
                    place += [np.arange(len(less)), [-1]]
                    owner.append(np.full(len(less) + 1, i))
                if owner:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).astype(np.int64)), pa.array(np.concatenate(place).astype(np.int32)), pa.array(short[np.concatenate(owner)])], names=["key", "place", "short"])

    return lines.select("short", "words").mapInArrow(run, "key long, place int, short long")


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether two lines are at edit distance 1 in units: what they share from both ends leaves one unit at most."""
    if len(a) > len(b):
        a, b = b, a
    gap, n = len(b) - len(a), len(a)
    if gap > 1 or a == b:
        return False
    front = next((i for i in range(n) if a[i] != b[i]), n)
    back = next((i for i in range(n - front) if a[n - 1 - i] != b[n - 1 - i + gap]), n - front)
    return front + back >= n - 1 + gap


def kept_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", near_words: int = 8, near_chars: int = 8, batch_bytes: int = 4 << 20) -> DataFrame:
    """The occurrences that stay of the lines that have words: __sv_id, __sv_hash, __sv_line."""
    spark = docs.sparkSession
    digest = xxhash.xxh3_128_digest

    def hashed():
        return lambda words: (digest(b" ".join(words)), halves(*units(words, near_words, near_chars))) if words else None

    def verified(own: pd.Series, other: pd.Series) -> pd.Series:
        parts = lambda text: units(text.split(), near_words, near_chars)
        return pd.Series([x[1] == y[1] and one_edit(x[0], y[0]) for x, y in zip(own.map(parts), other.map(parts), strict=True)], dtype=bool)

    rows = scan(docs, id_col, text_col, ["key", "halves"], "binary array<long>", batch_bytes, hashed)
    place = F.struct(F.col("__sv_id").isNull().alias("none"), "__sv_id", "__sv_hash", "__sv_line")
    lines = materialize(rows.groupBy("key").agg(F.min(place).alias("at"), F.any_value("halves").alias("halves")), "lines")
    shared = lines.select(F.explode("halves").alias("half"), "key")
    met = shared.groupBy("half").agg(F.count("*").alias("n")).filter("n > 1").select("half")
    near = materialize(shared.join(met, "half", "left_semi").select("key").distinct(), "near")
    short = F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")  # the first eight bytes
    few = spark.sparkContext.broadcast(np.sort(near.select(short.alias("s")).toArrow()["s"].to_numpy()) if near.count() <= FEW else None)

    def spelled():
        chosen = few.value

        def make(words: list[bytes]):
            if not words:
                return None
            text = b" ".join(words)
            key = digest(text)
            if chosen is not None:
                s = int.from_bytes(key[:8], "big", signed=True)
                k = np.searchsorted(chosen, s)
                if k == len(chosen) or chosen[k] != s:
                    return None
            return key, text

        return make

    text = scan(docs, id_col, text_col, ["key", "words"], "binary binary", batch_bytes, spelled).groupBy("key").agg(F.any_value("words").alias("words"))
    near = materialize(text.join(lines.join(near, "key", "left_semi").select("key", "at"), "key").select(short.alias("short"), "at", "words"), "near_lines")
    made = variants(near, near_words, near_chars)
    crowd = made.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key")
    made = made.join(crowd, "key", "left_semi")
    made = materialize(made.join(near.select("short", "at"), "short").select("key", "place", "at"), "variants")
    whole = made.filter("place < 0").groupBy("key").agg(F.min("at").alias("first"))
    less = made.filter("place >= 0")
    replaced = less.join(less.groupBy("key", "place").agg(F.min("at").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"), ["key", "place"])
    added = less.join(whole, "key")
    left_out = made.filter("place < 0").join(less.groupBy("key").agg(F.min("at").alias("first")), "key")
    pairs = replaced.select("at", "first").unionByName(added.select("at", "first")).unionByName(left_out.select("at", "first")).filter("first < at").distinct()
    pairs = pairs.join(near.select("at", F.col("words").alias("own")), "at").join(near.select(F.col("at").alias("first"), F.col("words").alias("other")), "first")
    dropped = materialize(pairs.filter(F.pandas_udf(verified, BooleanType())("own", "other")).select("at").distinct(), "dropped")
    return lines.select("at").join(dropped, "at", "left_anti").select("at.__sv_id", "at.__sv_hash", "at.__sv_line")


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with __sv_text (without the lines that go), __sv_n_lines (that have words) and __sv_n_kept (of those)."""
    kept = kept_lines(docs, id_col=id_col, text_col=text_col, **options)
    kept = kept.groupBy(F.col("__sv_id").alias("__sv_kept_id"), F.col("__sv_hash").alias("__sv_kept_hash")).agg(F.collect_set("__sv_line").alias("__sv_kept"))
    own = docs.select("*", *(c.alias(n) for c, n in zip(row_key(id_col, text_col), ("__sv_own_id", "__sv_own_hash"), strict=True)))
    own = own.join(kept, F.col("__sv_own_id").eqNullSafe(F.col("__sv_kept_id")) & (F.col("__sv_own_hash") == F.col("__sv_kept_hash")), "left")
    stays = F.coalesce("__sv_kept", F.array().cast("array<int>"))

    def result(lines):  # lines are taken by their places, so the work grows with their number
        blank = F.filter(F.transform(lines, lambda x, i: F.when(~x.rlike(WORD[:-1]), i)), lambda i: i.isNotNull())
        joined = lambda places: F.array_join(F.transform(places, lambda i: F.get(lines, i)), "\n")
        return let(blank, lambda b: F.struct(let(F.array_sort(F.concat(stays, b)), joined).alias("text"), (F.size(lines) - F.size(b)).cast("long").alias("n")))

    out = own.withColumn("__sv_lines", let(F.split(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), "\n"), result)).withColumn("__sv_n_kept", F.size(stays).cast("long"))
    same = F.col("__sv_lines.n") == F.col("__sv_n_kept")
    return out.select(*(f"`{c}`" for c in docs.columns), F.when(same, F.col(f"`{text_col}`")).otherwise(F.col("__sv_lines.text")).alias("__sv_text"), F.col("__sv_lines.n").alias("__sv_n_lines"), "__sv_n_kept")


def dedup(docs: DataFrame, *, text_col: str = "text", length_col: str | None = "n_chars", **options) -> DataFrame:
    """The documents, in their own columns, without the lines that go and without documents that held nothing else.

    A document that had no line to begin with stays as it is. length_col, where it is there, is set to the new text's length.
    """
    out = dedup_lines(docs, text_col=text_col, **options)
    same = F.col("__sv_n_lines") == F.col("__sv_n_kept")
    out = out.filter(same | (F.col("__sv_n_kept") > 0))
    new = {text_col: F.col("__sv_text")}
    if length_col in docs.columns:
        new[length_col] = F.when(same, F.col(f"`{length_col}`")).otherwise(F.length("__sv_text")).cast(docs.schema[length_col].dataType)
    return out.select(*(new.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns))


#: The same as DuckDB SQL, for ids that are there once: doc_id, n_lines, n_removed, text_sha256.
ORACLE = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS raw, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line FROM documents
), w AS (
  SELECT *, regexp_extract_all(translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM l
), k AS (
  SELECT doc_id, line, raw, w, len(w) AS n, array_to_string(w, ' ') AS s, doc_id * 1000000 + line AS f FROM w
), u AS (
  SELECT s, any_value(w) AS w, any_value(n) >= 8 AS words, CASE WHEN any_value(n) >= 8 THEN any_value(n) ELSE length(s) END AS n, min(f) AS f FROM k WHERE n > 0 GROUP BY s
), v AS (
  SELECT s, words, n, f, i, CASE WHEN words THEN array_to_string(list_concat(w[1:i - 1], w[i + 1:]), ' ') ELSE substr(s, 1, i - 1) || substr(s, i + 1) END AS v
  FROM (SELECT *, unnest(generate_series(1, n)) AS i FROM u WHERE n >= 8)
), x AS (
  SELECT s FROM (SELECT s, f, min(f) OVER (PARTITION BY words, n, i, v) AS m FROM v) WHERE m < f
  UNION SELECT v.s FROM v JOIN u ON u.s = v.v AND u.words = v.words AND u.n >= 8 WHERE u.f < v.f
  UNION SELECT u.s FROM v JOIN u ON u.s = v.v AND u.words = v.words AND u.n >= 8 WHERE v.f < u.f
), g AS (
  SELECT k.doc_id, k.line, k.raw, k.n, k.n = 0 OR (u.s IS NOT NULL AND x.s IS NULL) AS keep
  FROM k LEFT JOIN u ON k.s = u.s AND k.f = u.f LEFT JOIN x ON x.s = k.s
)
SELECT doc_id, count(*) FILTER (n > 0) AS n_lines, count(*) FILTER (n > 0 AND NOT keep) AS n_removed,
  sha256(coalesce(string_agg(raw, chr(10) ORDER BY line) FILTER (keep), '')) AS text_sha256
FROM g GROUP BY doc_id
"""
