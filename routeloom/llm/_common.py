"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but the ASCII white space bytes.  ``bytes.split()`` cuts at the same bytes.
WORD = r"[^\x20\x09-\x0D]+"

#: Spark's setting to drop a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder (URI) under the one that the cluster shares for checkpoints.

    Reads ``spark.checkpoint.dir``; only where it is unset and Spark is one process, as in tests, a temporary folder takes its
    place.  On a cluster each machine would write to its own disk, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="routeloom-")
        spark.sparkContext.setCheckpointDir(base)
    if base.startswith("/"):
        base = "file://" + base
    return os.path.join(base, f"routeloom-{uuid.uuid4().hex}")


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of queries inside are dropped when these end, as they are of no use then; a long chain of steps would else hold those of all."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def keep(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a cut of the lineage that survives lost executors."""
    path = shared_dir(spark)
    with cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_in = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``keep`` wrote, once what was made from them is written itself."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_in)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


#: A written table of at most so many rows, and so many bytes of (compressed) files, may go whole to every task.
SMALL_ROWS, SMALL_BYTES = 1_000_000, 16 << 20


def written_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``keep`` wrote."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_in)
    return path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).getContentSummary(path).getLength()


def is_small(df: DataFrame) -> bool:
    """Whether a table that ``keep`` wrote has few rows and bytes."""
    return written_bytes(df) <= SMALL_BYTES and df.count() <= SMALL_ROWS


def small_side(df: DataFrame) -> DataFrame:
    """A table that ``keep`` wrote, for a join: sent to all tasks if its rows and bytes are few (so that nothing large need be shuffled), else as it is."""
    return F.broadcast(df) if is_small(df) else df


def unused(docs: DataFrame, name: str) -> str:
    """A column name that a table hasn't got, in any case."""
    known = {c.lower() for c in docs.columns}
    while name.lower() in known:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
