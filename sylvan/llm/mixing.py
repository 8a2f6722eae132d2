"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

Sources in code-point order (null last) get the given weights in turn. Together they are to give
`share` times all words; a source stops at `max_epochs` times its own, and what that leaves over goes
to the others by weight, round after round, until none is above its cap. Each source then takes all
its documents floor(target / size) times, and the rest of its target from the documents that come
first in the order of a seeded 64-bit hash, up to the document nearest the target.

Only DataFrame functions. One pass computes (source, hash, words) of each row, a table of a few bytes
a row; the hash order is cut by sums over the 2 ** 8 ranges of the hash's first 8 bits, then of the next
8 inside the range that holds the cut, and so on for 32 bits, and by an exact running sum inside the last
range, so that a source of any size puts 2 ** 8 rows in a task. What is
decided is a row per source, joined to the documents by broadcast while there are few sources and
with salted keys beyond that. Texts are never shuffled.

Null texts have no words. Null is a source of its own. Rows equal in id and text share their fate, and
each counts. A source without words has target 0. Empty tables give empty results. Internal columns
start with __sv_.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sylvan.llm.common import WORD, materialize

RANGES, STEP = 32, 8  # bits of the hash that its ranges use, and one round of cutting
FEW = 100_000  # sources whose plan is broadcast
SALTS = 64


def measured(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """docs with __sv_source, __sv_size (words) and __sv_key (the seeded hash)."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = F.xxhash64(F.lit(seed), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), text)
    return docs.withColumns({"__sv_source": F.col(f"`{source_col}`"), "__sv_size": F.regexp_count(text, F.lit(WORD)).cast("long"), "__sv_key": key})


def ranked(sources: DataFrame) -> DataFrame:
    """sources with __sv_rank from 0 in code-point order, null last: ranges are ranked apart, then offset."""
    order = [F.col("__sv_source").isNull(), F.col("__sv_source")]
    parts = sources.repartitionByRange(*order).withColumn("__sv_part", F.spark_partition_id())
    parts = materialize(parts, "sources")
    counts = sorted((r["__sv_part"], r["count"]) for r in parts.groupBy("__sv_part").count().collect())  # a row per partition
    offsets, total = [], 0
    for part, n in counts:
        offsets.append((part, total))
        total += n
    offset = parts.sparkSession.createDataFrame(offsets, "__sv_part int, __sv_offset long")
    rank = F.row_number().over(Window.partitionBy("__sv_part").orderBy(*order)) - 1
    return parts.withColumn("__sv_rank", rank).join(F.broadcast(offset), "__sv_part").withColumn("__sv_rank", F.col("__sv_rank") + F.col("__sv_offset")).drop("__sv_part", "__sv_offset")


def water_fill(sources: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """sources (with __sv_source, __sv_total, __sv_rank) with __sv_target."""
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("__sv_rank") % len(weights) + 1).cast("int"))
    rows = materialize(sources.withColumns({"__sv_weight": weight, "__sv_cap": F.col("__sv_total") * float(max_epochs)}), "weights")
    budget = share * (rows.agg(F.sum("__sv_total")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:  # each round caps at least one source more, or ends
        above = F.col("__sv_weight") * level >= F.col("__sv_cap") if capped >= 0 else F.lit(False)
        full, free, n = rows.agg(F.sum(F.when(above, F.col("__sv_cap"))), F.sum(F.when(~above, F.col("__sv_weight"))), F.count(F.when(above, 1))).first()
        if n == capped or not free:
            break
        level, capped = (budget - (full or 0.0)) / free, n
    target = F.least(F.col("__sv_weight") * level, F.col("__sv_cap")) if free else F.col("__sv_cap")
    return rows.withColumn("__sv_target", target)


def attach(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """rows with the columns of their source's plan."""
    plan = plan.withColumnRenamed("__sv_source", "__sv_plan_source")
    same = F.col("__sv_source").eqNullSafe(F.col("__sv_plan_source"))
    if n_sources <= FEW:
        return rows.join(F.broadcast(plan), same, "left").drop("__sv_plan_source")
    rows = rows.withColumn("__sv_salt", F.pmod("__sv_key", F.lit(SALTS)).cast("int"))
    plan = plan.withColumn("__sv_plan_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.join(plan, same & (F.col("__sv_salt") == F.col("__sv_plan_salt")), "left").drop("__sv_plan_source", "__sv_salt", "__sv_plan_salt")


def within(rows: DataFrame, cut: DataFrame, n_sources: int, bits: int) -> DataFrame:
    """rows whose hash begins with the bits of their source's range, with its plan."""
    out = attach(rows, cut, n_sources).filter("__sv_range is not null")
    return out.filter(F.shiftrightunsigned("__sv_key", 64 - bits) == F.col("__sv_range")) if bits else out


def narrowed(rows: DataFrame, cut: DataFrame, n_sources: int, bits: int) -> DataFrame:
    """cut (source, goal, words before its range, range of so many bits) with the range of STEP bits more that holds the goal."""
    at = F.shiftrightunsigned("__sv_key", 64 - bits - STEP).bitwiseAND(F.lit((1 << STEP) - 1))
    sums = within(rows, cut, n_sources, bits).groupBy("__sv_source", "__sv_goal", "__sv_start", "__sv_range", at.alias("__sv_at")).agg(F.sum("__sv_size").alias("__sv_sum"))
    over = Window.partitionBy("__sv_source").orderBy("__sv_at")
    sums = sums.withColumn("__sv_start", F.col("__sv_start") + F.sum("__sv_sum").over(over) - F.col("__sv_sum")).filter("__sv_goal > __sv_start")
    last = sums.groupBy("__sv_source").agg(F.max_by(F.struct("__sv_goal", "__sv_start", (F.col("__sv_range") * (1 << STEP) + F.col("__sv_at")).alias("__sv_range")), "__sv_at").alias("c"))
    return last.select("__sv_source", "c.*")


def plan_sources(rows: DataFrame, *, weights: Sequence[float] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2.0) -> tuple[DataFrame, int]:
    """The plan of each source, and their number; rows: measured() ones.

    __sv_total, __sv_target; __sv_whole repetitions of every document; one more of those whose hash
    lies in a range below __sv_range, or in it at a place up to __sv_low.
    """
    sources = rows.groupBy("__sv_source").agg(F.sum("__sv_size").alias("__sv_total"))
    sources = water_fill(ranked(sources), weights, share, max_epochs)
    epochs = F.when(F.col("__sv_total") == 0, F.lit(0.0)).otherwise(F.least(F.col("__sv_target") / F.col("__sv_total"), F.lit(float(max_epochs))))
    sources = sources.withColumn("__sv_whole", F.floor(epochs)).withColumn("__sv_rest", F.col("__sv_target") - F.col("__sv_whole") * F.col("__sv_total"))
    sources = materialize(sources.drop("__sv_rank", "__sv_weight", "__sv_cap"), "targets")
    n = sources.count()
    small = rows.select("__sv_source", "__sv_size", "__sv_key")
    cut = sources.filter("__sv_rest > 0").select("__sv_source", F.col("__sv_rest").alias("__sv_goal"), F.lit(0.0).alias("__sv_start"), F.lit(0).cast("long").alias("__sv_range"))
    for bit in range(0, RANGES, STEP):
        cut = materialize(narrowed(small, cut, n, bit), "ranges")
    inside = within(small, cut, n, RANGES).withColumn("__sv_place", F.col("__sv_key").bitwiseAND(F.lit((1 << 64 - RANGES) - 1)))
    inside = inside.groupBy("__sv_source", "__sv_range", "__sv_start", "__sv_goal", "__sv_place").agg(F.sum("__sv_size").alias("__sv_sum"))
    middle = F.col("__sv_start") + F.sum("__sv_sum").over(Window.partitionBy("__sv_source").orderBy("__sv_place")) - F.col("__sv_sum") / 2
    low = inside.withColumn("__sv_middle", middle).groupBy("__sv_source", "__sv_range").agg(F.coalesce(F.max(F.when(F.col("__sv_middle") <= F.col("__sv_goal"), F.col("__sv_place"))), F.lit(-1)).alias("__sv_low"))
    low = low.withColumnRenamed("__sv_source", "__sv_low_source")
    plan = sources.join(low, F.col("__sv_source").eqNullSafe(F.col("__sv_low_source")), "left").select("__sv_source", "__sv_total", "__sv_target", "__sv_whole", F.coalesce("__sv_range", F.lit(-1)).alias("__sv_range"), F.coalesce("__sv_low", F.lit(-1)).alias("__sv_low"))
    return materialize(plan, "plan"), n


def decide(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """measured() rows with their source's plan and __sv_copies, how often the mix takes them."""
    at, place = F.shiftrightunsigned("__sv_key", 64 - RANGES), F.col("__sv_key").bitwiseAND(F.lit((1 << 64 - RANGES) - 1))
    more = (at < F.col("__sv_range")) | (at == F.col("__sv_range")) & (place <= F.col("__sv_low"))
    return attach(rows, plan, n_sources).withColumn("__sv_copies", F.col("__sv_whole") + more.cast("long"))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, **options) -> DataFrame:
    """The mix: each document as often as it is taken, in its own columns."""
    rows = measured(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)
    small = materialize(rows.select("__sv_source", "__sv_size", "__sv_key"), "sizes")
    taken = decide(rows, *plan_sources(small, **options)).filter("__sv_copies > 0")
    return taken.withColumn("__sv_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__sv_copies")))).select(*(f"`{c}`" for c in docs.columns))
