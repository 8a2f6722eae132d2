"""What several of the text operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sylvan.session import ship

#: Names of what this package writes to the shared folder.
PREFIX = "sv-"
#: Java and Python spelling of the words most operators count.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the given input folder, read by Spark so that any file system works."""
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all machines share: spark.checkpoint.dir, set here only where it is unset and all is one machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        path = f"file://{tempfile.mkdtemp(prefix='sylvan-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts lineage, survives the loss of executors, and computes df once for several readers. The
    folder stays, since results that are computed later read it; `clear` removes it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{PREFIX}{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession, frames: Iterable[DataFrame] = ()) -> None:
    """Delete what materialize wrote for these frames, whose readers are done; without frames, for the whole session's folder."""
    jvm = spark.sparkContext._jvm
    paths = {f.rsplit("/", 1)[0] for df in frames for f in df.inputFiles()}
    fs_of = lambda p: jvm.org.apache.hadoop.fs.Path(p).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not frames:
        base = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{PREFIX}*")
        paths = {str(s.getPath()) for s in base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(base) or ()}
    for p in paths:
        if f"/{PREFIX}" in p:
            fs_of(p).delete(jvm.org.apache.hadoop.fs.Path(p), True)


def slices(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of an Arrow batch of about `most` bytes of text each, one row at least."""
    lengths = pc.binary_length(batch.column(column)).fill_null(0).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield batch.slice(start, len(lengths) - start)


def utf8(column: pa.Array) -> list[bytes]:
    """The texts as UTF-8 bytes, null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def row_key(id_col: str, text_col: str) -> list:
    """Columns that tell rows apart: equal for exact repeats of a row only."""
    return [F.col(f"`{id_col}`").alias("__sv_id"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("__sv_hash")]
