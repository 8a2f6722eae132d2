"""A corpus from raw documents: quality rules, line dedup, near-dedup, decontamination, source mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents; the last returns a
row for each time that the mix takes a document.

Every stage takes nulls in any column, keeps other columns as they are, whatever their names (those that
start with __sv_ are the operators' own), reads texts whole, and gives an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sylvan.llm import decontaminate, line_dedup, mixing, quality, simhash
from sylvan.llm.common import materialize, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    Null, empty and very short texts have too few words and go. A score at the threshold stays. Repeated
    rows share their fate. Without labelled documents only the base rules reject.
    """
    return quality.clean(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier line matches go, and documents that held nothing else.

    Earlier means the lesser id, then the lesser text hash, then the line's place; null ids come last.
    Rows equal in id and text are one occurrence and all stay. Null and empty texts stay.
    """
    return line_dedup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: of similarity 0.8 or so, by five-word shingles.

    The least id stays, null ids last, then the least text hash; of repeated rows one. Texts of fewer than
    five words are one shingle. All null and empty texts are one group.
    """
    return simhash.dedup(docs, words=5, wide=True, distance=simhash.WIDE_DISTANCE)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of a benchmark item go.

    A passage is ten of the item's words, or all if it has fewer. Null and empty texts hold none and stay;
    repeated rows share their fate. Items of null id count; items without words, or no items, remove nothing.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, as often as the target weights of their sources take them.

    Null is a source of its own, the last. Null and empty texts have no words, so taking them moves no
    total. Ties in hash go by the whole key; rows equal in id and text share their number of copies.
    """
    return mixing.mix(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", dedup_lines),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminated),
    ("mix_sources", mixed),
]

#: Hashed multinomials, fingerprints and seeded draws are not SQL; tests/llm/test_pipeline.py checks the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
