"""Tables written between steps, in the folder that the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession) -> str:
    """The URI of a new folder under the one that the cluster shares for checkpoints; only local Spark may do without that."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="routeloom-")
        spark.sparkContext.setCheckpointDir(base)
    return os.path.join(f"file://{base}" if base.startswith("/") else base, f"step-{uuid.uuid4().hex}")


def materialize(df: DataFrame) -> DataFrame:
    """Write and read back: cuts the lineage in a way that survives lost executors."""
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
