"""Document quality from a linear-chain conditional random field over lines.

Each line of a text is good or bad.  Its features tell what it is made of (letters, capitals, digits, symbols, repeated
words, length and the like); the same features of the lines before and after it also count, and neighbouring lines
influence each other's labels.  Forward-backward gives each line's probability to be good, and the mean of these, weighted by
the lines' lengths, is the document's quality.  Training takes a document's label for all its lines and climbs the conditional
likelihood with exact gradients from the same forward-backward pass.

Behaviour on unusual input: a null or empty text is one empty line; very long texts and lines count whole; rows that
repeat get equal scores; without labels of both kinds every score is the share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from routeloom.llm._common import table
from routeloom.llm.labelled import SAMPLE_PER_LABEL, held_out, training_texts

#: Classes of bytes: letters below 128, capitals, bytes of other characters, digits, spaces, stops, bars, exclamations, the rest.
_CLASS = np.full(256, 8, np.int64)
_CLASS[ord("a") : ord("z") + 1] = 0
_CLASS[ord("A") : ord("Z") + 1] = 1
_CLASS[128:] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[32, 9, 10, 11, 12, 13]] = 4
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = 5
_CLASS[ord("|")] = 6
_CLASS[ord("!")] = 7
N_CLASS = 9
N_LINE = N_CLASS + 5
_BASE = np.uint64(0x9E3779B97F4A7C15)


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features (lines x N_LINE) of all lines of all texts, their lengths in bytes, and the number of lines of each text."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    breaks = buf == 10
    line = np.cumsum(breaks) - breaks
    n = int(line[-1]) + 1
    counts = np.bincount(line * N_CLASS + _CLASS[buf], minlength=n * N_CLASS).reshape(n, N_CLASS).astype(np.float64)
    ends = np.flatnonzero(breaks)
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = ends - starts
    counts[:, 4] -= 1  # the line's own end
    white = _CLASS[buf] == 4
    first = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    last = np.flatnonzero(~white & np.concatenate([white[1:], [True]])) + 1
    # Words are compared by hashes of the sum of bytes times powers of an odd base.
    powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(63, _BASE, np.uint64)]))
    at = np.arange(len(buf))
    inside = at - np.repeat(first, np.diff(np.append(first, len(buf)))) if len(first) and first[0] == 0 else at - np.concatenate([np.zeros(first[0] if len(first) else len(buf), np.int64), np.repeat(first, np.diff(np.append(first, len(buf))))])
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum((buf.astype(np.uint64) + np.uint64(7)) * powers[inside & 63], out=sums[1:])
    word = (sums[last] - sums[first]) * _BASE ^ (last - first).astype(np.uint64)
    of = line[first]
    n_words = np.bincount(of, minlength=n)
    again = np.zeros(len(word), bool)
    again[1:] = (word[1:] == word[:-1]) & (of[1:] == of[:-1])
    repeated = np.bincount(of[again], minlength=n)
    whole = np.maximum(size, 1)[:, None]
    share = counts / whole
    ends_well = (buf[np.maximum(ends - 1, 0)] == ord(".")) & (size > 0)
    out = np.column_stack([share * np.array([1, 2, 1, 3, 3, 5, 10, 10, 5.0]), repeated / np.maximum(n_words, 1), ends_well, size == 0, np.log1p(size) / 5, size / (np.maximum(n_words, 1) * 10.0 + 1)])
    out[:, -1] = np.minimum(out[:, -1], 5)
    per_text = np.fromiter((t.count(b"\n") + 1 for t in texts), np.int64, len(texts))
    return out, size.astype(np.float64), per_text


def node_features(lines: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """A line's features, its neighbours', whether it is first or last, and a constant."""
    n = len(lines)
    ends = np.cumsum(per_text)
    is_first, is_last = np.zeros(n, bool), np.zeros(n, bool)
    is_first[ends - per_text] = True
    is_last[ends - 1] = True
    before = np.roll(lines, 1, axis=0)
    before[is_first] = 0
    after = np.roll(lines, -1, axis=0)
    after[is_last] = 0
    return np.column_stack([lines, before, after, is_first, is_last, np.ones(n)])


@dataclass
class Crf:
    """weights: log-odds of good for a line.  pairs[a, b]: score of label a followed by b."""

    weights: np.ndarray
    pairs: np.ndarray
    scale: tuple[float, float] = (1.0, 0.0)  # from the log-odds of the weighted mean to those of the score

    def marginals(self, features: np.ndarray, per_text: np.ndarray, want_pairs: bool = False):
        """P(good) of each line; with want_pairs also the summed probabilities of neighbouring labels, and nothing is approximated."""
        z = np.clip(features @ self.weights, -30, 30)
        node = np.column_stack([np.exp(-z / 2), np.exp(z / 2)])
        step = np.exp(self.pairs)
        first = np.cumsum(per_text) - per_text
        order = np.argsort(-per_text, kind="stable")
        start, length = first[order], per_text[order]
        longest = int(length[0]) if len(length) else 0
        active = len(length) - np.searchsorted(length[::-1], np.arange(longest), side="right")
        fwd, bwd = np.empty_like(node), np.empty_like(node)
        state = None
        for t in range(longest):
            at = start[: active[t]] + t
            state = node[at] if state is None else (state[: active[t]] @ step) * node[at]
            state = state / state.sum(1, keepdims=True)
            fwd[at] = state
        state = np.zeros((0, 2))
        for t in range(longest - 1, -1, -1):
            at = start[: active[t]] + t
            more = np.full((active[t], 2), 0.5)
            k = len(state)
            if k:
                more[:k] = (state * node[at[:k] + 1]) @ step.T
                more[:k] /= more[:k].sum(1, keepdims=True)
            bwd[at] = more
            state = more
        both = fwd * bwd
        good = both[:, 1] / both.sum(1)
        if not want_pairs:
            return good
        inner = np.ones(len(node), bool)
        inner[np.cumsum(per_text) - 1] = False
        a = np.flatnonzero(inner)
        joint = fwd[a][:, :, None] * step[None] * (node[a + 1] * bwd[a + 1])[:, None, :]
        joint /= joint.sum((1, 2), keepdims=True)
        return good, joint.sum(0), a

    def score(self, texts: list[bytes]) -> np.ndarray:
        lines, size, per_text = line_features(texts)
        good = self.marginals(node_features(lines, per_text), per_text)
        weight = size + 1
        cuts = np.cumsum(per_text) - per_text
        mean = np.clip(np.add.reduceat(good * weight, cuts) / np.add.reduceat(weight, cuts), 1e-6, 1 - 1e-6)
        return 1 / (1 + np.exp(-(self.scale[0] * np.log(mean / (1 - mean)) + self.scale[1])))


def train(texts: list[bytes], labels: list[int], share: float, rounds: int = 120, penalty: float = 1e-3) -> Crf:
    """Maximum conditional likelihood with an L2 penalty; each document counts by the square root of its number of lines."""
    width = 3 * N_LINE + 3
    weights, pairs = np.zeros(width), np.zeros((2, 2))
    y_text = np.array(labels)
    if len(labels) == 0 or y_text.min() == y_text.max():
        prior = min(max(share, 1e-4), 1 - 1e-4)
        weights[-1] = np.log(prior / (1 - prior))
        return Crf(weights, pairs)
    # A megabyte at a time: the features are small, what they are made from is not.
    groups, size = [[]], 0
    for text in texts:
        if groups[-1] and size + len(text) > 1 << 20:
            groups.append([])
            size = 0
        groups[-1].append(text)
        size += len(text)
    made = [line_features(g) for g in groups]
    lines, per_text = np.concatenate([m[0] for m in made]), np.concatenate([m[2] for m in made])
    x = node_features(lines, per_text)
    y = np.repeat(y_text, per_text).astype(np.float64)
    total = len(x)
    values = np.zeros(width + 4)
    m1, m2 = np.zeros_like(values), np.zeros_like(values)
    for t in range(1, rounds + 1):
        model = Crf(values[:width], values[width:].reshape(2, 2))
        good, joint, a = model.marginals(x, per_text, True)
        seen = np.zeros((2, 2))
        np.add.at(seen, (y[a].astype(int), y[a + 1].astype(int)), 1)
        grad = np.concatenate([x.T @ (good - y), (joint - seen).ravel()]) / total + penalty * values
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.99 * m2 + 0.01 * grad**2
        values = values - 0.15 * (m1 / (1 - 0.9**t)) / (np.sqrt(m2 / (1 - 0.99**t)) + 1e-8)
    model = Crf(values[:width], values[width:].reshape(2, 2))
    # The scores of the training texts, by label, set the scale: logistic regression on one value, both labels weighing the same.
    mean = np.concatenate([model.score(g) for g in groups])
    odds, a, b = np.log(mean / (1 - mean)), 1.0, 0.0
    each = np.where(y_text == 1, 0.5 / max(1, (y_text == 1).sum()), 0.5 / max(1, (y_text == 0).sum()))
    for _ in range(50):  # Newton's steps, held back by a small penalty
        p = 1 / (1 + np.exp(-np.clip(a * odds + b, -30, 30)))
        miss, curve = each * (p - y_text), each * p * (1 - p)
        grad = np.array([miss @ odds + 1e-3 * (a - 1), miss.sum() + 1e-3 * b])
        hess = np.array([[curve @ odds**2 + 1e-3, curve @ odds], [curve @ odds, curve.sum() + 1e-3]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return Crf(model.weights, model.pairs, (a, b))


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """(doc_id, score) of whole texts."""
    return with_score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model).select("doc_id", "score")


def with_score(docs: DataFrame, model: Crf, column: str = "score") -> DataFrame:
    """The rows with one more column; one of that name is replaced."""
    docs = docs.drop(column)
    schema = StructType([*docs.schema.fields, StructField(column, DoubleType())])
    columns = docs.columns
    at = columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            a = 0
            texts_all = whole.column(at).cast(pa.binary()).fill_null(b"").to_pylist()
            while a < len(texts_all):
                b, size = a, 0
                while b < len(texts_all) and (b == a or size + len(texts_all[b]) <= 1 << 20):
                    size += len(texts_all[b])
                    b += 1
                part = whole.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(model.score(texts_all[a:b]))], names=[*columns, column])
                a = b

    return docs.mapInArrow(run, schema)


def fitted(spark: SparkSession, sf_dir: str) -> Crf:
    """The model from the labelled rows of a data set that are not held out."""
    return train(*training_texts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "quality", SAMPLE_PER_LABEL))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = score(table(spark, sf_dir, "documents"), fitted(spark, sf_dir))
    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
