"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The n-grams of a text (its lower-cased UTF-8 bytes) are hashed into a table of fixed size, each counted once.  From labelled
texts comes the log of the ratio of an n-gram's share among toxic texts to that among others; it scales the feature,
and logistic regression with a penalty learns how far to trust each one.  The model is one weight for each slot of the table.

Behaviour on unusual input: a null or empty text has no n-grams and gets the score of the intercept; very long texts count
whole; rows that repeat get equal scores; without labels of both kinds every score is the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm._common import table
from routeloom.llm.labelled import SAMPLE_PER_LABEL, held_out, training_texts

ORDERS, SLOT_BITS = (4, 5), 18
_MULT = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


class NgramHasher:
    """Distinct slots of a text's n-grams, in one pass over its bytes for each order."""

    def __init__(self, orders: tuple[int, ...] = ORDERS, bits: int = SLOT_BITS):
        self.orders, self.bits = orders, bits
        self.mark = np.zeros(1 << bits, np.int64)

    def __call__(self, text: bytes) -> np.ndarray:
        buf = np.frombuffer(b" " + text.lower() + b" ", np.uint8).astype(np.uint64)
        found = []
        for i, n in enumerate(self.orders):
            if len(buf) < n:
                continue
            m = len(buf) - n + 1
            code = buf[:m].copy()
            for j in range(1, n):
                code |= buf[j : j + m] << np.uint64(8 * j)
            found.append((code * np.uint64(_MULT[i % 2]) + np.uint64(i) >> np.uint64(64 - self.bits)).astype(np.int64))
        if not found or not text:
            return np.zeros(0, np.int64)
        slots = np.concatenate(found)
        at = np.arange(len(slots))
        self.mark[slots] = at
        return slots[self.mark[slots] == at]


def train(texts: list[bytes], labels: list[int], share: float, least_texts: int = 4, least_ratio: float = 0.4, penalty: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights by slot, and the intercept.  share: of label 1 among all labelled rows, the answer where nothing can be learned."""
    hasher = NgramHasher()
    size = 1 << hasher.bits
    y = np.array(labels, np.float64)
    prior = min(max(share, 1e-4), 1 - 1e-4)
    if len(y) == 0 or y.min() == y.max():
        return np.zeros(size, np.float32), float(np.log(prior / (1 - prior)))
    rows = [hasher(t) for t in texts]
    counts = [np.zeros(size), np.zeros(size)]
    for slots, label in zip(rows, labels, strict=True):
        counts[label][slots] += 1
    a, b = counts[1] + 1, counts[0] + 1
    ratio = np.log(a / a.sum()) - np.log(b / b.sum())
    used = (counts[0] + counts[1] >= least_texts) & (np.abs(ratio) >= least_ratio)
    ratio = np.where(used, ratio, 0)
    place = np.cumsum(used) - 1
    cols = [place[s[used[s]]] for s in rows]
    of = np.repeat(np.arange(len(cols)), [len(c) for c in cols])
    col = np.concatenate(cols)
    r = ratio[used]
    w, bias, k = np.ones(len(r)) * 0.1, 0.0, len(r)
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both labels weigh the same
    rate, m1, m2 = 0.05, np.zeros(k + 1), np.zeros(k + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(of, (w * r)[col], len(y)) + bias
        miss = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * each
        grad = np.append(np.bincount(col, miss[of], k) * r + penalty * w, miss.sum())
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        step = rate * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
        w, bias = w - step[:-1], bias - step[-1]
    weights = np.zeros(size, np.float32)
    weights[used] = w * r
    return weights, float(bias)


def score(docs: DataFrame, weights: np.ndarray, intercept: float) -> DataFrame:
    """(doc_id, score) of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = NgramHasher()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            z = np.fromiter((weights[hasher(t)].sum(dtype=np.float64) for t in texts), np.float64, len(texts)) + intercept
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -500, 500))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, score double")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(*training_texts(docs, table(spark, sf_dir, "labels"), "toxic", SAMPLE_PER_LABEL))
    return score(docs, *model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
