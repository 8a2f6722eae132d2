"""Session helpers shared by the library, the driver entry points and the tests."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

PACKAGE_ROOT = str(Path(__file__).resolve().parent.parent)


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package.

    Workers started on a machine that has the repository at the same path get it through
    PYTHONPATH; on other clusters pass the package with ``--py-files``, which this leaves alone.
    """
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if PACKAGE_ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, paths)])
    return spark


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def builder(app: str = "sylvan", cores: int | str = "*", partitions: int = 8) -> SparkSession.Builder:
    """A local session with the settings that the library recommends."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
