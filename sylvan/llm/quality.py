"""Quality rules: plain counts of a text, and the log-likelihood ratio of its hashed n-grams.

Tokens are runs of letters, digits and underscores, or of anything else but white space, in lower
case; grams are single tokens and pairs, hashed to 2 ** BITS buckets. Two multinomials over buckets
are counted, of trusted documents (label 1; at most `max_trusted` of them, chosen by a hash of the
id: a documented bound on the labelled sample, which makes it a broadcast of fixed size) and of every
document of the raw corpus. A text's score is its grams' mean log ratio, so length cancels, and a
text is kept if the score is at least `threshold`.

All of it is DataFrame functions: one pass explodes grams into a partial aggregation by bucket (no
key is hot after it), and a second reads each row with the table of ratios, of fixed size, as a
constant. Texts are never shuffled.

Null or empty texts have no words and fail the base rules. A text without grams scores 0. No trusted
document: every ratio is 0 and only base rules reject. Repeated rows give repeated results, and count
as often as they are there. Empty tables give empty results. Internal columns start with __sv_.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import WORD

BITS = 14
TOKEN = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]+"
#: A word and the n - 1 words after it, of words joined by single spaces.
RUN = r"(?<![^ ])(?=([^ ]++(?: [^ ]++){%d}))"


def let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def joined(left: Column, right: Column, shift: int) -> Column:
    """Hashes of left[i] and right[i + shift], for each i that has both."""
    n = F.greatest(F.size(right) - shift, F.lit(0))
    return F.zip_with(F.slice(left, F.lit(1), n), F.slice(right, F.lit(1 + shift), n), lambda a, b: F.xxhash64(a, b))


def runs_of_five(words: Column) -> Column:
    """A hash of each five words in a row."""
    four = lambda h: let(joined(h, h, 1), lambda two: joined(two, two, 2))
    return let(hashes(words), lambda h: joined(four(h), h, 4))


def covered(runs: Column, n: int) -> Column:
    """Words that stand in runs of n words which are there twice or more; runs: hashes of all of them in order."""

    def repeats(ordered: Column) -> Column:
        same = lambda x, i: (i > 0) & (F.get(ordered, i - 1)["h"] == x["h"]) | F.coalesce(F.get(ordered, i + 1)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(ordered, same), lambda x: x["p"]))

    ordered = F.sort_array(F.transform(runs, lambda x, i: F.struct(x.alias("h"), i.alias("p"))))
    grow = lambda a, p: F.struct((a["n"] + n - F.greatest(a["end"] - p, F.lit(0))).cast("long").alias("n"), (p + n).cast("int").alias("end"))
    count = F.aggregate(let(ordered, repeats), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), grow, lambda a: a["n"])
    return F.when(F.size(F.array_distinct(runs)) == F.size(runs), F.lit(0).cast("long")).otherwise(count)


def singles(text: Column) -> Column:
    return hashes(found(F.lower(text), TOKEN))


def bucket(h: Column) -> Column:
    return h.bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")


def counts(text: Column) -> Column:
    """A struct of the plain counts; one expression that names each step once, so that no filter pushed below repeats a step."""
    dup_lines = lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long")

    def of_words(t: Column, w: Column) -> Column:
        n = F.size(w).cast("long")
        return F.struct(
            n.alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD[:-1])), dup_lines).alias("n_dup_lines"),
            let(runs_of_five(w), lambda r: covered(r, 5)).alias("n_repeat_words"),
        )

    return let(text, lambda t: let(found(t, WORD), lambda w: of_words(t, w)))


def failed(c: Column) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def ratios(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_trusted: int = 20000, smoothing: float = 1.0) -> DataFrame:
    """One row with `ratios`: log of the trusted over the raw share of each bucket, an array of 2 ** BITS."""
    trusted = labels.select(F.col(f"`{id_col}`").alias("__sv_id"), F.col(f"`{label_col}`").alias("__sv_y")).filter("__sv_id is not null and __sv_y is not null")
    trusted = trusted.groupBy("__sv_id").agg(F.min("__sv_y").alias("__sv_y")).filter("__sv_y > 0")
    trusted = trusted.orderBy(F.xxhash64(F.col("__sv_id").cast("string")), "__sv_id").limit(max_trusted).select("__sv_id", F.lit(1).alias("__sv_trusted"))
    rows = docs.select(F.col(f"`{id_col}`").alias("__sv_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("__sv_text"))
    rows = rows.join(F.broadcast(trusted), "__sv_id", "left")  # max_trusted ids
    grams = let(singles(F.col("__sv_text")), lambda h: F.concat(h, joined(h, h, 1)))
    grams = rows.select(F.coalesce("__sv_trusted", F.lit(0)).alias("t"), F.explode(grams).alias("h")).select("t", bucket(F.col("h")).alias("b"))
    counts = grams.groupBy("b").agg(F.sum("t").alias("t"), F.count("*").alias("n"))
    size = 1 << BITS
    all_buckets = docs.sparkSession.range(size).select(F.col("id").cast("int").alias("b"))
    counts = all_buckets.join(counts, "b", "left").select("b", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("n", F.lit(0)).alias("n"))
    one = counts.agg(F.sort_array(F.collect_list(F.struct("b", "t", "n"))).alias("c"), F.sum("t").alias("nt"), F.sum("n").alias("nr"))
    ratio = lambda x: F.log((x["t"] + smoothing) / (F.col("nt") + smoothing * size)) - F.log((x["n"] + smoothing) / (F.col("nr") + smoothing * size))
    return one.select(F.when(F.col("nt") == 0, F.array_repeat(F.lit(0.0), size)).otherwise(F.transform("c", ratio)).alias("ratios"))


def verdict(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", threshold: float = -0.25, **options) -> Column:
    """A struct of base (the counts), base_failed, score and kept of each row of docs."""
    table = ratios(docs, labels, id_col=id_col, text_col=text_col, **options).first()["ratios"]  # 2 ** BITS numbers
    weights = F.split(F.lit(",".join(map(repr, table))), ",").cast("array<double>")  # folds into one constant
    add = lambda a, h: a + F.get(weights, bucket(h))
    total = lambda h: F.aggregate(joined(h, h, 1), F.aggregate(h, F.lit(0.0), add), add)
    mean = let(singles(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), lambda h: F.when(F.size(h) == 0, F.lit(0.0)).otherwise(total(h) / (2 * F.size(h) - 1)))
    base = counts(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))
    row = lambda c, m: F.struct(c.alias("base"), failed(c).alias("base_failed"), m.alias("score"), (~failed(c) & (m >= threshold)).alias("kept"))
    return let(base, lambda c: let(mean, lambda m: row(c, m)))


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs with __sv_verdict."""
    return docs.withColumn("__sv_verdict", verdict(docs, labels, **options))


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents, in their own columns, that are kept."""
    return docs.filter(verdict(docs, labels, **options)["kept"])
