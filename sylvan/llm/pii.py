"""Personal data by weak supervision: labelers vote, expectation-maximisation weighs them, a classifier learns.

Spans of four kinds are found by pattern (`base_spans`) and always stay. Besides, every word that
holds a digit or an @ is a candidate. Six labelers vote yes, no or nothing on each: the strict
patterns, loose patterns, a gazetteer of domains and issuer prefixes, the words before and after,
and number formats. Votes are independent given the truth (Dawid and Skene's model); its parameters
come from expectation-maximisation over the counts of vote patterns, of which there are at most
3 ** 6. The expected truth of each candidate then trains a naive Bayes classifier over hashed
features of the candidate and its context (2 ** FEATURE_BITS buckets), and candidates that it
accepts outside the base spans are added.

Only DataFrame functions. Spans come from one row's text alone: positions are running sums of the
lengths of gaps and matches, in blocks, so that work grows with the text and not with its square.
The two tables that are fit are counted over all documents by partial aggregation on a few keys, and
have a fixed size. Texts are never shuffled.

Positions are code points, ends exclusive. Null or empty texts have no spans. Repeated rows give
repeated results. Without any candidate nothing is learned and only base spans are there. Empty
tables give empty results. Columns added to docs start with __sv_.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sylvan.llm.common import materialize
from sylvan.llm.quality import found, let

BLOCK = 256
FEATURE_BITS = 12

#: Each kind: a test that spares other texts, where a match can start, the match, what it must pass.
#: Runs are possessive and start at their first character, which leaves the matches as they are and
#: the work in proportion to the text.
NUMBER = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]?[0-9])"
KINDS = {
    "email": ("@", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (r"[0-9]\.[0-9]+\.[0-9]+\.[0-9]", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (r"[0-9](?:[\x20-]?[0-9]){13}", r"[0-9]++(?:[\x20-][0-9]++)*+"),
    "phone": (r"\+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
CANDIDATE = ("[0-9@]", r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]*[0-9@][^\x20\x09-\x0D]*")
EDGES = r"^[\"'(\[{<,;:.!?]+|[\"')\]}>,;:.!?]+$"

#: Fixed word lists of the gazetteer and context labelers.
BEFORE_YES = "account address call card cell contact cvv e-mail email fax iban id ip key mail mobile msisdn nr passport passwd password phone pin pwd secret ssn tel telephone token user visa whatsapp".split()
BEFORE_NO = "article chapter equation figure fig line no number page pages part section step table v version vol volume year".split()
AFTER_NO = "am bytes cm days euro euros hours kb kg km mb miles million minutes mm months pages percent pm times years".split()
DOMAINS = "com net org edu gov io de fr es co uk".split()
LABELERS = ("strict", "loose", "gazetteer", "before", "after", "format")


def running(lengths: Column) -> Column:
    """The sums of all earlier elements, block by block."""
    scan = lambda x: F.aggregate(x, F.array(F.lit(0).cast("long")), lambda a, v: F.concat(a, F.array(F.element_at(a, -1) + v)))

    def joined(blocks: Column) -> Column:
        sums = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("long"), lambda a, v: a + v))
        return let(scan(sums), lambda before: F.flatten(F.transform(blocks, lambda b, i: F.transform(F.slice(scan(b), F.lit(1), F.size(b)), lambda v: v + F.get(before, i)))))

    blocks = lambda x: F.when(F.size(x) == 0, F.array().cast("array<array<bigint>>")).otherwise(F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda b: F.slice(x, b * BLOCK + 1, F.lit(BLOCK))))
    return let(lengths, lambda x: let(blocks(x), joined))


def located(text: Column, test: str, pattern: str) -> Column:
    """Array of (gap, match, start, end) of the leftmost non-overlapping matches."""
    whole = rf"(?s)\G(.*?)({pattern})"

    def spans(pair: Column) -> Column:
        lengths = F.transform(pair, lambda p: (F.length(p["gap"]) + F.length(p["match"])).cast("long"))
        place = lambda before: F.transform(pair, lambda p, i: F.struct(p["gap"].alias("gap"), p["match"].alias("match"), (F.get(before, i) + F.length(p["gap"])).alias("start"), (F.get(before, i) + F.length(p["gap"]) + F.length(p["match"])).alias("end")))
        return let(running(lengths), place)

    pairs = F.arrays_zip(found(text, whole, 1).alias("gap"), found(text, whole, 2).alias("match"))
    none = F.array().cast("array<struct<gap:string,match:string,start:bigint,end:bigint>>")
    return F.when(text.rlike(test), let(pairs, spans)).otherwise(none)


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    def value(d: Column, i: Column) -> Column:
        twice = F.when(i % 2 == 1, d * 2).otherwise(d)
        return twice - F.when(twice > 9, 9).otherwise(0)

    each = F.transform(F.split(F.reverse(number), ""), lambda d, i: F.coalesce(value(d.cast("int"), i), F.lit(0)))
    return F.aggregate(each, F.lit(0), lambda a, v: a + v) % 10 == 0


PASSES: dict[str, Callable[[Column], Column]] = {
    "email": lambda m: F.lit(True),
    "ip": lambda m: m.rlike(rf"^{NUMBER}(?:\.{NUMBER}){{3}}$"),
    "card": lambda m: let(digits(m), lambda d: F.length(d).between(14, 19) & luhn(d)),
    "phone": lambda m: F.length(digits(m)).between(10, 15),
}


def base_spans(text: Column, kind: str) -> Column:
    """Array of (start, end) of a kind's spans, in order."""
    kept = F.filter(located(text, *KINDS[kind]), lambda s: PASSES[kind](s["match"]))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def overlaps(spans: Column, start: Column, end: Column) -> Column:
    """Whether one of the spans, in order and apart from each other, meets [start, end): a binary search."""
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(spans) + 1)).cast("int"))

    def halve(a: Column, _) -> Column:
        middle = F.floor((a["low"] + a["high"]) / 2).cast("int")
        left = (a["low"] < a["high"]) & (F.get(spans, middle)["start"] < end)
        return F.struct(F.when(left, middle + 1).otherwise(a["low"]).alias("low"), F.when(left, a["high"]).otherwise(F.least(middle, a["high"])).alias("high"))

    last = F.aggregate(steps, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), halve, lambda a: F.get(spans, a["low"] - 1)["end"])
    return F.when(F.size(spans) == 0, F.lit(False)).otherwise(F.coalesce(last > start, F.lit(False)))


def word(text: Column, pattern: str) -> Column:
    return F.lower(F.regexp_replace(F.regexp_extract(text, pattern, 1), r"[\p{P}\p{S}]+", ""))


def spanned(text: Column) -> Column:
    """A struct of each kind's base spans, and of candidates: (start, end, token, before, after, strict).

    One expression that names each step once, so that no filter pushed below repeats a step.
    """

    def candidates(t: Column, base: Column, rows: Column) -> Column:
        tail = F.substr(t, (F.get(rows, F.size(rows) - 1)["end"] + 1).cast("int"), F.lit(64))

        def one(r: Column, i: Column) -> Column:
            after = F.coalesce(F.substring(F.get(rows, i + 1)["gap"], 1, 64), tail)
            token = F.regexp_replace(r["match"], EDGES, "")
            lead = F.length(F.regexp_extract(r["match"], r"^[\"'(\[{<,;:.!?]*", 0))
            strict = F.lit(False)
            for k in KINDS:
                strict = strict | overlaps(base[k], r["start"], r["end"])
            return F.struct(
                (r["start"] + lead).alias("start"), (r["start"] + lead + F.length(token)).alias("end"), token.alias("token"),
                word(F.right(r["gap"], F.lit(64)), r"([^\x20\x09-\x0D=:|-][^\x20\x09-\x0D]*+)[\x20\x09-\x0D=:|-]*$").alias("before"),
                word(after, r"^[\x20\x09-\x0D]*([^\x20\x09-\x0D]+)").alias("after"), strict.alias("strict"),
            )

        return F.filter(F.transform(rows, one), lambda c: c["end"] > c["start"])

    def joined(t: Column, base: Column) -> Column:
        found_ = let(located(t, *CANDIDATE), lambda rows: candidates(t, base, rows))
        return F.struct(*(base[k].alias(k) for k in KINDS), found_.alias("candidates"))

    bases = lambda t: F.struct(*(base_spans(t, k).alias(k) for k in KINDS))
    return let(text, lambda t: let(bases(t), lambda base: joined(t, base)))


def vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "+").when(no, "-").otherwise("0")


def votes(c: Column) -> Column:
    """The labelers' votes as a word of +, - and 0, in the order of LABELERS."""
    t, low = c["token"], F.lower(c["token"])
    n = F.length(digits(t))
    inside = lambda value, words: value.isin(words)
    loose = t.rlike(r"^[^@\s]+@[^@\s]+\.[^@\s]+$|^[0-9]{3}-[0-9]{2}-[0-9]{4}$|^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|^AKIA[A-Z0-9]{16}$|^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$") | low.rlike(r"(?:^|[^a-z])[0-9a-f]{16,}$|^(?:password|passwd|pwd|secret|token|key)[=:]")
    return F.concat(
        vote(c["strict"], F.lit(False)),
        vote(loose, n < 3),
        vote(F.regexp_extract(low, r"@[^\s]*\.([a-z]+)$", 1).isin(DOMAINS) | t.rlike(r"^(?:4[0-9]{15}|5[1-5][0-9]{14}|3[47][0-9]{13}|6011[0-9]{12})$"), F.lit(False)),
        vote(inside(c["before"], BEFORE_YES), inside(c["before"], BEFORE_NO)),
        vote(F.lit(False), inside(c["after"], AFTER_NO)),
        vote((F.length(t) >= 12) & (n >= 4), t.rlike(r"^[$€£]?[0-9]{1,4}(?:[.,:/][0-9]{1,4}){0,2}%?$|^v[0-9.]+$|^[0-9]+(?:st|nd|rd|th)$")),
    )


def features(c: Column) -> Column:
    """Hashed features of a candidate; the labelers' own verdicts aren't among them."""
    t = c["token"]
    shape = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.regexp_replace(t, r"\p{Lu}+", "A"), r"\p{Ll}+", "a"), "[0-9]+", "9"), "(?:a9|9a){3,}", "x")
    parts = {
        "shape": F.substring(shape, 1, 24), "before": c["before"], "after": c["after"], "start": F.lower(F.substring(t, 1, 4)),
        "digits": F.least(F.length(digits(t)), F.lit(20)).cast("string"), "length": F.least(F.length(t), F.lit(40)).cast("string"),
    }
    return F.array(*(F.pmod(F.xxhash64(F.lit(k), v), F.lit(1 << FEATURE_BITS)).cast("int") for k, v in parts.items()))


def expectation(patterns: dict[str, int], rounds: int = 60) -> tuple[dict[str, float], dict[str, dict[str, tuple[float, float]]], float]:
    """Of each vote pattern the chance that it marks personal data; the labelers' vote rates; the prior.

    patterns: how often each occurs; at most 3 ** len(LABELERS). The first guess counts each vote alike.
    """
    truth = {p: 1 / (1 + math.exp(-2.0 * (p.count("+") - p.count("-")) + 0.5)) for p in patterns}
    rates: dict[str, dict[str, tuple[float, float]]] = {}
    prior = 0.5
    for _ in range(rounds):
        total = sum(patterns.values())
        yes = sum(n * truth[p] for p, n in patterns.items())
        prior = (yes + 1) / (total + 2)
        for k, name in enumerate(LABELERS):
            own = {}
            for v in "+-0":
                a = sum(n * truth[p] for p, n in patterns.items() if p[k] == v)
                b = sum(n * (1 - truth[p]) for p, n in patterns.items() if p[k] == v)
                own[v] = ((a + 0.5) / (yes + 1.5), (b + 0.5) / (total - yes + 1.5))
            for v, agrees in (("+", 0), ("-", 1)):  # no labeler is trusted to be worse than chance
                if own[v][agrees] < own[v][1 - agrees]:
                    mean = (own[v][0] + own[v][1]) / 2
                    own[v] = (mean, mean)
            rates[name] = own
        for p in patterns:
            z = math.log(prior / (1 - prior)) + sum(math.log(rates[name][v][0] / rates[name][v][1]) for name, v in zip(LABELERS, p, strict=True))
            truth[p] = 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))
    return truth, rates, prior


def fit(docs: DataFrame, text_col: str) -> tuple[list[float], float, dict]:
    """Log ratios of the features, the classifier's bias and the labelers' rates."""
    both = lambda c: F.struct(votes(c).alias("v"), features(c).alias("f"))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = materialize(docs.select(F.transform(spanned(text)["candidates"], both).alias("c")), "votes").select(F.explode("c").alias("c")).select("c.v", "c.f")
    patterns = {r["v"]: r["n"] for r in rows.groupBy("v").agg(F.count("*").alias("n")).collect()}  # 3 ** 6 at most
    size = 1 << FEATURE_BITS
    if not patterns:
        return [0.0] * size, -1.0, {}
    truth, rates, prior = expectation(patterns)
    chance = F.lit(0.0)
    for p, t in truth.items():
        chance = F.when(F.col("v") == p, F.lit(t)).otherwise(chance)
    counts = rows.select(chance.alias("t"), F.explode("f").alias("f")).groupBy("f").agg(F.sum("t").alias("a"), F.sum(1 - F.col("t")).alias("b")).collect()  # 2 ** FEATURE_BITS at most
    yes, no = sum(r["a"] for r in counts), sum(r["b"] for r in counts)
    ratios = [0.0] * size
    for r in counts:
        ratios[r["f"]] = math.log((r["a"] + 0.5) / (yes + 0.5 * size)) - math.log((r["b"] + 0.5) / (no + 0.5 * size))
    return ratios, math.log(prior / (1 - prior)), rates


def find(docs: DataFrame, *, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """docs with __sv_pii, a struct of each kind's (start, end), and of base and spans.

    base and spans are arrays of (start, rank, kind, end) in the order of start and kind. Added spans
    have the kinds contact (with an @), secret (with letters) and number.
    """
    ratios, bias, _ = fit(docs, text_col)
    weights = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    goal = math.log(threshold / (1 - threshold))
    accepted = lambda c: ~c["strict"] & (F.aggregate(features(c), F.lit(bias), lambda a, f: a + F.get(weights, f)) >= goal)
    span = lambda start, rank, kind, end: F.struct(start.alias("start"), rank.alias("rank"), kind.alias("kind"), end.alias("end"))
    kind = lambda t: F.when(F.instr(t, "@") > 0, "contact").when(t.rlike("[A-Za-z]"), "secret").otherwise("number")
    ranked = lambda spans, i, k: F.transform(spans, lambda s: span(s["start"], F.lit(i), F.lit(k), s["end"]))

    def result(s: Column) -> Column:
        base = F.array_sort(F.concat(*(ranked(s[k], i, k) for i, k in enumerate(KINDS))))
        added = F.transform(F.filter(s["candidates"], accepted), lambda c: span(c["start"], F.lit(9), kind(c["token"]), c["end"]))
        both = lambda b: F.struct(*(s[k].alias(k) for k in KINDS), b.alias("base"), F.array_sort(F.concat(b, added)).alias("spans"))
        return let(base, both)

    return docs.withColumn("__sv_pii", let(spanned(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))), result))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
