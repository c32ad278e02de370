"""Route trees from streams of requests.

Parsing has no state and runs as it is on a stream.  Each micro-batch is reduced to its different requests, with counts and places in
the order, and written under its batch id, so a batch that runs again replaces what it wrote.  These facts hold all that a tree is built from, so
a tree of all batches is that of one batch with the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from routeloom.operators import lookup, routes
from routeloom.operators.routes import ALIKE, RouteTree, compact, request_counts
from routeloom.sources.requests import parse
from routeloom.sources.store import materialize


def counted(parsed: DataFrame) -> DataFrame:
    """The rows, counted by Spark as they pass, in a stream too: the metric ``requests`` of each batch has what was processed and what was wrong."""
    return parsed.observe("requests", *request_counts())


def ingest(requests: DataFrame, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the query that keeps ``folder`` (facts by batch) up to date; ``requests`` is a streaming DataFrame.  Bad rows are left out."""

    def write(batch: DataFrame, batch_id: int) -> None:
        compact(batch).write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return counted(parse(requests)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def facts(spark: SparkSession, folder: str, alike: list[str] = ALIKE) -> DataFrame:
    """The different requests of all batches so far: seq, last_seq, n and what they differ in, of which ``alike`` may take less; no rows before the first batch."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return compact(parse(spark.createDataFrame([], "seq long, method string, url string, body string")), alike)
    return compact(spark.read.parquet(folder), alike)


def tree(spark: SparkSession, folder: str, alike: list[str] = ALIKE, **options) -> RouteTree:
    """The tree of all batches so far; options as those of routes.build, ``alike`` as in ``compact``."""
    return routes.build(facts(spark, folder, alike), **options)


def unseen(requests: DataFrame, known: RouteTree, folder: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Start the query that writes to ``folder`` (by batch) the rows of a stream that a tree needs: with a new route, method, parameter, content type, header or cookie.

    A new value of a path variable or a parameter is nothing new; rows that can't be parsed are needed.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = materialize(batch)
        found = lookup.needed(rows, known).where("need").select("seq").distinct()
        rows.join(found, "seq", "left_semi").write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    return parse(requests).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
