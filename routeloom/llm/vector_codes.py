"""Vector code compression: product codes by exact integer k-means.

Components become integers ``floor(scale * x)``; a vector is cut into equal consecutive parts, each with a codebook of its own.  The
codebooks start as the parts of the vectors with the smallest ids, and each round assigns every part to its nearest entry and moves
the entries to their parts' floored means.  All arithmetic is on integers, so results are the same in any order of rows and for
any partitioning.

Vectors travel as columnar NumPy blocks (a row for each dimension), in an RDD of blocks.  Distances of a block are
added up dimension by dimension; ``np.add.at`` collects sums and counts of entries, int64 tensors that ``treeAggregate`` merges, so the driver gets
one pair of tensors a round, whatever the number of rows.  Only codebooks (parts x entries x dimensions) go to the tasks.

Behaviour on unusual input: rows whose vector is null, or holds null or non-finite components, take no part, nor do
vectors of another length than most have (of lengths that can be cut into equal parts; the smaller of two that are as frequent).  Null ids are
the largest, rows that repeat are rows of their own, and equal ids go by their vectors.  With fewer rows than entries the
codebooks have as many entries as rows; an empty table gives no rows.  Components so large that sums could leave 64 bits are worked on as Python's
integers; an error above the largest long is reported as that.  Further columns are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm._common import keep, table

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors that are worked on at once.
BLOCK = 2048
#: Integers below this have differences whose squares can be summed over 1024 dimensions in int64.
FITS = 1 << 24
LONG = (1 << 63) - 1


def takes_part(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & fine, F.lit(False))


def integers(x: np.ndarray, scale: int, small: bool) -> np.ndarray:
    """``floor(scale * x)`` of finite doubles, exactly: int64 where they are small, else Python's integers."""
    if small:
        return np.floor(x * scale).astype(np.int64)
    # Doubles from 2 ** 52 on are whole numbers, whose products Python has exactly.
    whole = [int(v) * scale if abs(v) >= 2.0**52 else math.floor(v * scale) for v in x.ravel().tolist()]
    return np.array([None, *whole], object)[1:].reshape(x.shape)


def columns(vectors: pa.Array, dims: int, scale: int, small: bool) -> np.ndarray:
    """A block: dims x rows."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return integers(flat.reshape(-1, dims).T.copy(), scale, small)


def nearest(block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the nearest entries and squared distances to them (parts x rows); of equal ones the lowest index."""
    parts, entries, width = books.shape
    n = block.shape[1]
    codes, errors = np.empty((parts, n), np.int64), np.empty((parts, n), block.dtype)
    for p in range(parts):
        distance = np.zeros((entries, n), block.dtype)
        for j in range(width):
            gap = block[p * width + j][None, :] - books[p, :, j][:, None]
            distance += gap * gap
        codes[p] = np.argmin(distance, axis=0)
        errors[p] = distance[codes[p], np.arange(n)]
    return codes, errors


def add_up(total: tuple[np.ndarray, np.ndarray], block: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums (parts x entries x width) and counts (parts x entries) with those of a block added."""
    sums, counts = total
    parts, _, width = books.shape
    codes, _ = nearest(block, books)
    for p in range(parts):
        np.add.at(sums[p], codes[p], block[p * width : (p + 1) * width].T)
        np.add.at(counts[p], codes[p], 1)
    return sums, counts


def moved(books: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries at the floored means of their parts; unused ones stay."""
    means = sums // np.maximum(counts, 1)[:, :, None]
    return np.where((counts > 0)[:, :, None], means, books)


def learn(rows: DataFrame, dims: int, small: bool, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> np.ndarray:
    """Codebooks (parts x entries x width) of vectors (vec_id, v) of one length."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()  # ``entries`` rows at most
    start = integers(np.array([r["v"] for r in first], np.float64), scale, small)
    books = start.reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                flat = batch.column(0).slice(at, BLOCK).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
                yield pa.RecordBatch.from_arrays([pa.array([flat.reshape(-1, dims).T.tobytes()], pa.binary())], names=["data"])

    data = rows.select("v").mapInArrow(blocks, "data binary").rdd.map(lambda r: integers(np.frombuffer(r["data"]).reshape(dims, -1), scale, small))
    for _ in range(rounds):
        zero = (np.zeros_like(books), np.zeros(books.shape[:2], np.int64))
        now = rows.sparkSession.sparkContext.broadcast(books)  # parts x entries x width integers
        sums, counts = data.treeAggregate(zero, lambda total, block, now=now: add_up(total, block, now.value), lambda a, b: (a[0] + b[0], a[1] + b[1]), depth=3)
        books = moved(books, sums, counts)
    return books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256) of ``vectors`` (vec_id, v, label); entries up to 256."""
    spark = vectors.sparkSession
    fine = vectors.where(takes_part(F.col("v"))).select(F.col("vec_id").cast("long").alias("vec_id"), "v", "label")
    # One row for each length that occurs.
    lengths = fine.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x)))).alias("most"))
    usual = lengths.where((F.col("dims") > 0) & (F.col("dims") % parts == 0)).orderBy(F.desc("n"), "dims").first()
    if usual is None:
        return spark.createDataFrame([], f"vec_id long, label {dict(vectors.dtypes)['label']}, code string, error long, label_error long, codebooks_sha256 string")
    dims = usual["dims"]
    small = usual["most"] * scale < FITS and dims <= 1 << 10
    rows = fine.where(F.size("v") == dims)
    books = learn(rows, dims, small, parts, entries, rounds, scale)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                codes, errors = nearest(columns(batch.column(2), dims, scale, small), books)
                text = codes.T.astype(np.uint8).copy()
                error = [min(x, LONG) for x in errors.sum(axis=0).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([r.tobytes().hex() for r in text]), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    coded = keep(spark, rows.select("vec_id", "label", "v").mapInArrow(encode, f"vec_id long, label {dict(vectors.dtypes)['label']}, code string, error long"))
    # Sums before the join, whose large groups Spark splits: a label that most rows have is no window of its own.
    total = F.least(F.sum(F.col("error").cast("decimal(38,0)")), F.lit(LONG)).cast("long")
    by_label = coded.groupBy(F.col("label").alias("label_")).agg(total.alias("label_error"))
    out = coded.join(by_label, F.col("label").eqNullSafe(F.col("label_"))).drop("label_")
    return out.withColumn("codebooks_sha256", F.lit(digest(books)))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"), "label")
    return compress(rows).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
