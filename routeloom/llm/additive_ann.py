"""Approximate nearest neighbours by additive quantisation.

A vector is approximated by a sum of one codeword from each of several full-dimensional codebooks.  The codebooks are
fitted on a bounded sample (``SAMPLE`` rows, those with the smallest id hashes): residual k-means first, then least
squares over all of them together.  Every row is encoded by beam search, which keeps the best few partial sums, and is stored
with its codes and the squared norm of its approximation.  A query's products with all codewords form a lookup table,
from which any row's score is a sum of table entries.  The best rows of each block of candidates by that score are
scored again on the original vectors, and the best of all blocks are the result.  How many, is chosen by the sample, for a recall of 0.9 and more at any number of dimensions.

Queries and candidates meet in blocks: each block of queries goes to each block of candidates, and a pair of blocks gives
at most ``k`` rows a query.  Of equal vectors in a block only the k + 1 with the smallest ids can be in a result, so only they
are kept: a vector that a third of all rows share costs no more than others.

Behaviour on unusual input: vectors that are null, zero or empty, hold null or non-finite components, or differ in length from the
largest part of the sample take no part, nor do null ids; rows that repeat an id and a vector count once; a query whose id has
several vectors uses the smallest; an empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routeloom.llm._common import keep, partitions, table

BOOKS, WORDS, SAMPLE, BEAM = 16, 128, 8192, 2
BLOCK_ROWS, BLOCK_QUERIES, SHORTLIST = 8192, 512, 320
#: Queries of the sample by which the shortlist is chosen, and the share of their true neighbours in a block that it has to hold.
TRIED, SHARE = 128, 0.98
RESULT = "query_id long, vec_id long, score double"


@dataclass
class Codebooks:
    words: np.ndarray  # books x words x dimensions, float32

    @property
    def shape(self) -> tuple[int, int, int]:
        return self.words.shape

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Codes (rows x books) by beam search."""
        m, k, _ = self.shape
        flat = self.words.reshape(m * k, -1)
        gram = flat @ flat.T
        own = np.diag(gram)
        out = np.empty((len(x), m), np.uint8)
        for at in range(0, len(x), 1024):
            part = x[at : at + 1024]
            n = len(part)
            dots = part @ flat.T
            codes = np.zeros((n, 1, 0), np.int64)
            error = np.zeros((n, 1), np.float32)
            for b in range(m):
                new = own[b * k : (b + 1) * k] - 2 * dots[:, None, b * k : (b + 1) * k]
                new = np.repeat(new, codes.shape[1], axis=1)
                for j in range(b):
                    new += 2 * gram[j * k + codes[:, :, j], b * k : (b + 1) * k]
                new += error[:, :, None]
                new = new.reshape(n, -1)
                keep_n = min(beam if b + 1 < m else 1, new.shape[1])
                best = np.argpartition(new, keep_n - 1, axis=1)[:, :keep_n]
                error = np.take_along_axis(new, best, axis=1)
                codes = np.concatenate([np.take_along_axis(codes, (best // k)[:, :, None], axis=1), (best % k)[:, :, None]], axis=2)
            out[at : at + n] = codes[:, 0]
        return out

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[b][codes[:, b]] for b in range(self.shape[0]))


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 6) -> np.ndarray:
    centres = x[rng.permutation(len(x))[:k]].copy()
    if len(centres) < k:
        centres = np.concatenate([centres, np.zeros((k - len(centres), x.shape[1]), np.float32)])
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1)[None, :] - 2 * x @ centres.T, axis=1)
        count = np.bincount(near, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, near, x)
        used = count > 0
        centres[used] = total[used] / count[used, None]
    return centres


def fit(x: np.ndarray, books: int = BOOKS, words: int = WORDS, seed: int = 7) -> Codebooks:
    """Codebooks from sample rows."""
    rng = np.random.default_rng(seed)
    rest, found = x.astype(np.float32).copy(), []
    for _ in range(books):
        c = _kmeans(rest, words, rng)
        found.append(c)
        rest -= c[np.argmin((c**2).sum(1)[None, :] - 2 * rest @ c.T, axis=1)]
    made = Codebooks(np.stack(found))
    codes = made.encode(x.astype(np.float32)).astype(np.int64) + np.arange(books) * words
    # Least squares for all codewords together, held near the first solution.
    gram = np.zeros((books * words, books * words), np.float32)
    for a in range(books):
        for b in range(books):
            np.add.at(gram, (codes[:, a], codes[:, b]), 1)
    flat = made.words.reshape(books * words, -1)
    right = np.zeros_like(flat)
    for a in range(books):
        np.add.at(right, codes[:, a], x.astype(np.float32))
    ridge = np.float32(10.0)
    flat = np.linalg.solve(gram + ridge * np.eye(len(gram), dtype=np.float32), right + ridge * flat)
    return Codebooks(flat.reshape(made.shape).astype(np.float32))


def takes_part(v: Column) -> Column:
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return v.isNotNull() & fine & F.exists(v, lambda x: x != 0)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.Table]]:
    """Rows (block, id, vector), in order of block, as one table for each block."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        blocks = batch.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(blocks[1:] != blocks[:-1]) + 1).tolist(), len(blocks)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if held and held[0].column(0)[0].as_py() != int(blocks[a]):
                yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield held[0].column(0)[0].as_py(), pa.Table.from_batches(held)


def _matrix(rows: pa.Table) -> np.ndarray:
    flat = rows.column(2).combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)


def _blocks(rows: DataFrame, n: int, dims: int) -> DataFrame:
    named = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int").alias("block"), "vec_id", F.col("v").cast("array<double>").alias("v"))
    return named.where(F.size("v") == dims).repartition(min(n, partitions(rows.sparkSession)), "block").sortWithinPartitions("block", "vec_id", "v")


def index_blocks(rows: DataFrame, books: Codebooks, n: int, copies: int) -> DataFrame:
    """One row for each block of candidates: ids, codes, squared norms of the approximations, and original vectors, packed."""
    dims = books.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, data in _groups(batches):
            ids, x = data.column(1).to_numpy(), _matrix(data)
            order = np.lexsort((ids, *x.T[::-1]))
            same = np.zeros(len(ids), bool)
            same[1:] = (x[order[1:]] == x[order[:-1]]).all(axis=1)
            start = np.maximum.accumulate(np.where(same, 0, np.arange(len(ids))))
            twice = np.zeros(len(ids), bool)
            twice[1:] = same[1:] & (ids[order[1:]] == ids[order[:-1]])
            nth = np.cumsum(~twice)
            fine = ~twice & (nth - nth[start] < copies)
            pick = np.sort(order[fine])
            ids, x = ids[pick], x[pick]
            codes = books.encode(x.astype(np.float32))
            norms = (books.decode(codes).astype(np.float64) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([block], pa.int32()), *(pa.array([a.tobytes()], pa.binary()) for a in (ids, codes, norms.astype(np.float32), x))],
                names=["block", "ids", "codes", "norms", "vectors"],
            )

    return _blocks(rows, n, dims).mapInArrow(run, "block int, ids binary, codes binary, norms binary, vectors binary")


def query_blocks(rows: DataFrame, n: int, dims: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data in _groups(batches):
            yield pa.RecordBatch.from_arrays([pa.array([data.column(1).to_numpy().tobytes()], pa.binary()), pa.array([_matrix(data).tobytes()], pa.binary())], names=["q_ids", "q_vectors"])

    return _blocks(rows, n, dims).mapInArrow(run, "q_ids binary, q_vectors binary")


def table_scores(books: np.ndarray, queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Approximate inner products (rows x queries), from the queries' lookup tables."""
    scores = np.zeros((len(codes), len(queries)), np.float32)
    for b in range(len(books)):
        scores += (books[b] @ queries.T.astype(np.float32)).take(codes[:, b], axis=0)
    return scores


def search_block(books: Codebooks, q_ids, queries, ids, codes, vectors, k: int, shortlist: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """query ids, ids and exact scores: the best k of one block of candidates (in order of id) for each query."""
    scores = table_scores(books.words, queries, codes)
    n = len(ids)
    if n > shortlist:
        limit = np.partition(scores, n - shortlist, axis=0)[n - shortlist]
        row, q = np.nonzero((scores >= limit).T)[::-1]
    else:
        q, row = (x.ravel() for x in np.indices((len(q_ids), n)))
    other = ids[row] != q_ids[q]
    q, row = q[other], row[other]
    exact = np.einsum("ij,ij->i", queries[q], vectors[row])
    order = np.lexsort((ids[row], -exact, q))
    q, row, exact = q[order], row[order], exact[order]
    first = np.searchsorted(q, np.arange(len(q_ids)))
    best = np.arange(len(q)) - first[q] < k
    return q_ids[q[best]], ids[row[best]], exact[best]


def shortlist_for(books: Codebooks, x: np.ndarray, k: int, least: int = SHORTLIST, share: float = SHARE) -> int:
    """So many rows of a block go on to exact scores that ``share`` of the true nearest are among them, by the sample's own rows.

    Codes tell less about vectors of more dimensions, whose shortlists are longer.  The sample stands for one block of candidates of its size.
    """
    if len(x) <= least:
        return least
    asked = x[:: max(1, len(x) // TRIED)][:TRIED]
    x = x[: BLOCK_ROWS]
    exact, rough = x @ asked.T, table_scores(books.words, asked, books.encode(x.astype(np.float32)))
    best = np.argpartition(-exact, min(k, len(x) - 1), axis=0)[:k]
    places = np.argsort(np.argsort(-rough, axis=0), axis=0)
    # The place that ``share`` of the true neighbours have at most, and a fourth above it, as the sample has shaped the codebooks.
    needed = np.quantile(np.take_along_axis(places, best, axis=0), share)
    return int(max(least, np.ceil(1.25 * (needed + 1))))


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, shortlist: int | None = None, sample: int = SAMPLE, block_rows: int = BLOCK_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query (vec_id, v) its k nearest of ``vectors`` (vec_id, v) by inner product, itself left out."""
    spark = vectors.sparkSession
    fine = vectors.where(F.col("vec_id").isNotNull() & takes_part(F.col("v"))).select(F.col("vec_id").cast("long").alias("vec_id"), "v")
    asked = queries.where(F.col("vec_id").isNotNull() & takes_part(F.col("v"))).groupBy(F.col("vec_id").cast("long").alias("vec_id")).agg(F.min("v").alias("v"))
    some = [r["v"] for r in fine.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()]
    if not some:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dims = Counter(map(len, some)).most_common(1)[0][0]
    known = np.array([v for v in some if len(v) == dims], np.float64)
    books = fit(known)
    shortlist = shortlist or shortlist_for(books, known, k)
    n, m = fine.count(), asked.count()
    blocks = max(1, -(-n // block_rows))
    index = keep(spark, index_blocks(fine, books, blocks, k + 1))
    parts = query_blocks(asked, max(1, -(-m // block_queries)), dims)
    sent = parts.select("q_ids", "q_vectors", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q_ids, q_vectors, ids, codes, vectors_ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = search_block(
                    books, np.frombuffer(q_ids, np.int64), np.frombuffer(q_vectors).reshape(-1, dims), np.frombuffer(ids, np.int64),
                    np.frombuffer(codes, np.uint8).reshape(-1, books.shape[0]), np.frombuffer(vectors_).reshape(-1, dims), k, shortlist,
                )
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    pairs = sent.join(index, "block").select("q_ids", "q_vectors", "ids", "codes", "vectors")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = pairs.mapInArrow(run, RESULT).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("v"))
    return search(rows, rows.where(F.col("vec_id") % 20 == 0))
