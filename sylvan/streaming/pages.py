"""Streams of pages: parsing and extraction hold no state, so they run on a stream as they do on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.sources.pages import extract, parse, render

SCHEMA = "page_id long, url string, html string"

__all__ = ["SCHEMA", "counted", "extract", "parse", "read_pages", "render"]


def read_pages(spark: SparkSession, folder: str, schema: str = SCHEMA, files_per_batch: int = 100) -> DataFrame:
    """Pages from Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def counted(found: DataFrame, time_col: str, every: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Nodes found by window of arrival and name, late ones dropped after the watermark."""
    return found.withWatermark(time_col, late).groupBy(F.window(time_col, every), "tag").agg(F.count("*").alias("n"))
