"""The queries opN_<name>: each applies its operator to whole tables and derives the digest columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.llm.common import table


def op1_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.language_model import score

    return score(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.line_dedup import dedup_lines

    rows = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select(
        "doc_id", F.col("__sv_n_lines").alias("n_lines"), (F.col("__sv_n_lines") - F.col("__sv_n_kept")).alias("n_removed"),
        F.sha2(F.coalesce("__sv_text", F.lit("")).cast("binary"), 256).alias("text_sha256"),
    )


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from sylvan.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.decontaminate import find_matches

    found = find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.pii import KINDS, find, listed

    pii = F.col("__sv_pii")
    return find(table(spark, sf_dir, "documents")).select(
        "doc_id", *(F.size(pii[k]).cast("long").alias(f"n_{k}") for k in KINDS),
        F.sha2(listed(pii["base"]).cast("binary"), 256).alias("base_sha256"), listed(pii["spans"]).alias("spans"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.simhash import classes

    rows = classes(table(spark, sf_dir, "documents"))
    return rows.select(F.col("__sv_id").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.licenses import scan

    rows = scan(table(spark, sf_dir, "documents")).select("doc_id", F.col("__sv_matches").alias("m"))
    order = F.array_sort(F.transform("m", lambda r: F.struct(r["unit"], r["index"], r["name"])))
    return rows.select(
        "doc_id", F.size("m").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda r: r["name"]))), ",").alias("licenses"),
        F.array_join(F.transform(order, lambda r: F.concat_ws(":", r["unit"], r["index"].cast("string"), r["name"])), ",").alias("matches"),
        F.coalesce(F.array_max(F.transform("m", lambda r: r["dice"])), F.lit(0.0)).alias("best_dice"),
    )


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.common import materialize
    from sylvan.llm.mixing import decide, measured, plan_sources

    rows = measured(table(spark, sf_dir, "documents")).select("doc_id", "__sv_source", "__sv_size", "__sv_key")
    rows = materialize(rows, "sizes")
    taken = decide(rows, *plan_sources(rows))
    return taken.select(
        "doc_id", F.col("__sv_size").alias("size"), F.col("__sv_total").alias("source_size"), F.col("__sv_target").alias("target"),
        (F.col("__sv_size") * F.col("__sv_copies")).alias("taken"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.toxicity import fit, remainder, score

    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "worst_window")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from sylvan.llm.quality import judge

    judged = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    v = F.col("__sv_verdict")
    return judged.select("doc_id", *(v["base"][n].alias(n) for n in base), *(v[n].alias(n) for n in ("base_failed", "kept", "score")))


QUERIES = {f.__name__: f for f in (op1_lm_scores, op2_line_dedup, op3_token_counts, op4_decontaminate, op5_pii, op6_simhash, op7_licenses, op8_mixing, op9_toxicity, op10_quality)}


def _oracles() -> dict[str, str]:
    from sylvan.llm import decontaminate, licenses, line_dedup

    return {"op2_line_dedup": line_dedup.ORACLE, "op4_decontaminate": decontaminate.ORACLE, "op7_licenses": licenses.ORACLE}


ORACLES = _oracles()
