"""Language-model scoring: a hashed maximum-entropy model with a class-factored softmax.

The most frequent training words, the end of a document and one token for all rarer words are the model's units.  A softmax at the root decides between
classes of words, the end and the rare token, one in each class between subclasses, and one in each subclass between words.  Classes come from the company that units keep (counts of the most frequent words shortly before them), halved again and again along the
direction in which they differ most.  The features of a softmax are n-grams and skips (the word before, the two words before, the word two places before), hashed together with the node into tables of rows of ``WIDTH`` weights; the distribution that they change is that of the units'
counts.  A rare word's probability is that of the rare token times its add-one share among rare words.

Training is distributed: in each of ``ROUNDS`` rounds every task runs AdaGrad steps over its share of the training documents from the common weights, and the tasks'
changes are averaged, each row by how often a task has used it.  All training documents are learned from, one time each.  Counts of words are exact, by a shuffle; those of
the ``FREQUENT`` most frequent words go to all tasks, those of others are joined to the documents that hold them.  Scoring is a pass over the texts in sparse numpy batches.

What the driver and the tasks hold is bounded by the parameters: ``FREQUENT`` words of at most ``LONGEST`` bytes, and ``FIRST_ROW[-1]`` rows of weights.

Behaviour on unusual input: null texts are empty, and score their end; null ids are hashed as an empty text; rows that repeat are documents of their
own, in the counts as well as in the result; without training documents all counts are zero; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm._common import cleaned, discard, keep, partitions, table

#: Words whose counts all tasks know, and the longest of them in bytes.
FREQUENT, LONGEST = 1 << 16, 64
#: Children of a node; classes below the root, whose last two children are the end of a document and the rare token.
WIDTH, CLASSES = 16, 14
#: Units that are words, classes x subclasses x words; above them the end and the rare token.
WORDS = CLASSES * WIDTH * WIDTH
END, RARE = WORDS, WORDS + 1
#: First nodes of the levels: the root, the classes, the subclasses.
LEVEL = (0, 1, 1 + CLASSES, 1 + CLASSES + CLASSES * WIDTH)
#: Tables of weights (level, places before the word that are hashed together, rows): at most 2 ** 16 rows.
TABLES = ((0, (1,), 1 << 14), (0, (2,), 1 << 14), (1, (1,), 1 << 15), (2, (1,), 1 << 16), (2, (1, 2), 1 << 16))
FIRST_ROW = tuple(sum(t[2] for t in TABLES[:i]) for i in range(len(TABLES) + 1))
REACH = 2
#: Rows in a block of the shuffle.
BLOCK = 1 << 13
ROUNDS, STEP_TOKENS, RATE = 2, 32768, 0.4
#: Most frequent words whose company decides on classes.
ANCHORS = 256
#: Different words that a task holds before it gives them out.
HELD = 400_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words; ``split`` cuts at the same six bytes as the pattern."""
    return text.translate(_LOWER).split()


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _texts(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for whole in batches:
        for at in range(0, whole.num_rows, 256):
            batch = whole.slice(at, 256)
            yield batch, batch.column(column).cast(pa.binary()).fill_null(b"").to_pylist()


# --- counts -------------------------------------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, learned, held): occurrences in training and in held-out documents (held_out, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (Counter(), Counter())

        def out() -> Iterator[pa.RecordBatch]:
            for i, counts in enumerate(found):
                n, zero = pa.array(counts.values(), pa.int64()), pa.array(np.zeros(len(counts), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.binary()).cast(pa.string()), *((zero, n) if i else (n, zero))], names=["word", "learned", "held"])
                counts.clear()

        for batch, texts in _texts(batches, 1):
            for held, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                found[held].update(words_of(text))
            if len(found[0]) + len(found[1]) > HELD:
                yield from out()
        yield from out()

    return docs.mapInArrow(run, "word string, learned long, held long").groupBy("word").agg(F.sum("learned").alias("learned"), F.sum("held").alias("held"))


@dataclass
class Lexicon:
    """words: the most frequent ones, whose place is their id; counts: in training; unit: of each id, and of all other words (last)."""

    words: list[bytes]
    counts: np.ndarray
    unit: np.ndarray
    end_count: int
    tokens: int
    types: int

    def __post_init__(self):
        self.index = {w: i for i, w in enumerate(self.words)}

    @property
    def far(self) -> int:
        """The id of words that aren't among the frequent ones; above it, that of the places before a document's first word."""
        return len(self.words)

    def ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.index.get, words, repeat(self.far)), np.int64, len(words))

    def unit_counts(self) -> np.ndarray:
        out = np.bincount(self.unit[:-1], self.counts, WORDS + 2)
        out[END], out[RARE] = self.end_count, self.tokens - self.end_count - out[:WORDS].sum()
        return out

    def rare_mass(self) -> float:
        """The denominator of rare words' add-one shares."""
        n = int((self.unit[:-1] < WORDS).sum())
        return float(self.unit_counts()[RARE] + (self.types - (self.end_count > 0) - n) + 1)


def least_total(counts: DataFrame, most: int) -> int:
    """The least total for which no more than ``most`` words (word, total) have as many or more."""
    band = F.floor(F.log2("total") * 4)
    sizes = sorted(counts.groupBy(band.alias("band")).count().collect(), reverse=True)  # four rows to each doubling
    taken = 0
    for r in sizes:
        if taken + r["count"] > most:
            break
        taken += r["count"]
    else:
        return 1
    # Within the band that is cut, its largest totals.
    totals = counts.where(band == r["band"]).groupBy("total").count().orderBy(F.desc("total")).limit(1024)
    least = math.ceil(2 ** ((r["band"] + 1) / 4) - 1e-6)
    for r in totals.collect():
        taken += r["count"]
        if taken > most:
            break
        least = r["total"]
    return least


def lexicon(counts: DataFrame, train_docs: int, frequent: int = FREQUENT) -> Lexicon:
    """The words with the largest counts, ``frequent`` at most; where a count's words can't all be taken, none of them is."""
    sums = counts.agg(F.sum("learned").alias("n"), F.count_if(F.col("learned") > 0).alias("v")).first()
    short = counts.where(F.octet_length("word") <= LONGEST).withColumn("total", F.col("learned") + F.col("held"))
    top = short.where(F.col("total") >= least_total(short, frequent)).collect()  # ``frequent`` short words
    top.sort(key=lambda r: (-r["total"], r["word"]))
    learned = np.array([r["learned"] for r in top], np.int64)
    unit = np.full(len(top) + 1, RARE, np.int64)
    best = np.argsort(-learned, kind="stable")[:WORDS]
    best = best[learned[best] > 0]
    unit[best] = np.arange(len(best))
    return Lexicon([r["word"].encode() for r in top], learned, unit, train_docs, (sums["n"] or 0) + train_docs, sums["v"] + (train_docs > 0))


# --- the model ----------------------------------------------------------------------------------------------------------------


def events(lex: Lexicon, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, unit, REACH ids before it) of every token of documents given as ids; the last token of each is its end."""
    start = lex.far + 1
    sizes = np.array([len(t) + 1 for t in texts])
    flat = np.concatenate([np.concatenate([np.full(REACH, start), t, [start]]) for t in texts])
    ends = np.cumsum(sizes + REACH)
    at = np.ones(len(flat), bool)
    for i in range(REACH):
        at[ends - sizes - REACH + i] = False
    place = np.flatnonzero(at)
    units = np.append(lex.unit, END)[flat[place]]
    return np.repeat(np.arange(len(texts)), sizes), units, np.stack([flat[place - i] for i in range(1, REACH + 1)])


def _hash(ids: list[np.ndarray], node: np.ndarray, salt: int, rows: int) -> np.ndarray:
    h = node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    for x in ids:
        h = (h ^ x.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(48)).astype(np.uint16) & np.uint16(rows - 1)


@dataclass
class Decisions:
    """Of one level: which tokens get there, at which node, which child they take, and their row in each of the level's tables."""

    which: np.ndarray
    node: np.ndarray
    child: np.ndarray
    rows: list[tuple[int, np.ndarray]]


@dataclass
class Model:
    """place: of a word unit among the leaves.  bias: nodes x WIDTH.  weights: FIRST_ROW[-1] x WIDTH."""

    place: np.ndarray
    bias: np.ndarray
    weights: np.ndarray

    def decisions(self, units: np.ndarray, before: np.ndarray) -> list[Decisions]:
        words = np.flatnonzero(units < WORDS)
        leaf = self.place[units[words]]
        top = units - WORDS + CLASSES
        top[words] = leaf // WIDTH**2
        steps = [(np.arange(len(units)), np.zeros(len(units), np.int64), top), (words, LEVEL[1] + leaf // WIDTH**2, leaf // WIDTH % WIDTH), (words, LEVEL[2] + leaf // WIDTH, leaf % WIDTH)]
        near = [before, before[:, words]]
        rows = lambda level, node: [(t, _hash([near[level > 0][i - 1] for i in places], node, t, n)) for t, (at, places, n) in enumerate(TABLES) if at == level]
        return [Decisions(which, node, child, rows(level, node)) for level, (which, node, child) in enumerate(steps)]

    def chances(self, d: Decisions) -> np.ndarray:
        """Probabilities of all children (tokens x WIDTH)."""
        z = self.bias.take(d.node, axis=0)
        for t, r in d.rows:
            z += self.weights[FIRST_ROW[t] : FIRST_ROW[t + 1]].take(r, axis=0)
        # The bias is below zero and weights are small, so nothing overflows that isn't cut here.
        np.clip(z, -80, 60, out=z)
        np.exp(z, out=z)
        z *= (1 / (z @ np.ones(WIDTH, np.float32)))[:, None]
        return z

    def log10(self, units: np.ndarray, before: np.ndarray) -> np.ndarray:
        out = np.zeros(len(units))
        for d in self.decisions(units, before):
            p = self.chances(d)[np.arange(len(d.child)), d.child]
            out[d.which] += np.log10(np.maximum(p, 1e-30).astype(np.float64))
        return out


def tree_places(company: np.ndarray) -> np.ndarray:
    """The leaf of each word unit: halves, again and again, along the direction in which units' company (units x anchors) differs most."""
    x = np.sqrt(company / np.maximum(company.sum(axis=1, keepdims=True), 1))
    place = np.empty(len(x), np.int64)

    def halve(units: np.ndarray, at: int) -> None:
        if len(units) <= 1:
            place[units] = at
            return
        y = x[units] - x[units].mean(axis=0)
        v = np.linspace(1, 2, y.shape[1])
        for _ in range(12):
            v = y.T @ (y @ v)
            v /= np.linalg.norm(v) or 1.0
        order = units[np.argsort(y @ v, kind="stable")]
        half = len(order) // 2
        halve(order[:half], at)
        halve(order[half:], at + half)

    halve(np.arange(len(x)), 0)
    return place


def first_model(lex: Lexicon, company: np.ndarray) -> Model:
    place, counts = tree_places(company), lex.unit_counts()
    leaves = np.empty(WORDS)
    leaves[place] = counts[:WORDS]
    root = np.append(leaves.reshape(CLASSES, -1).sum(axis=1), counts[[END, RARE]])
    bias = np.concatenate([root[None, :], leaves.reshape(CLASSES, WIDTH, WIDTH).sum(axis=2), leaves.reshape(-1, WIDTH)])
    bias = np.log(np.maximum(bias, 1e-9))
    bias -= bias.max(axis=1, keepdims=True)
    return Model(place, bias.astype(np.float32), np.zeros((FIRST_ROW[-1], WIDTH), np.float32))


class Learner:
    """AdaGrad steps from a model; rows that are used change, and are counted."""

    def __init__(self, start: Model, rate: float = RATE):
        self.start, self.rate = start, rate
        self.model = Model(start.place, start.bias, start.weights.copy())
        self.squares = np.ones(FIRST_ROW[-1], np.float32)
        self.used = np.zeros(FIRST_ROW[-1], np.float32)

    def gradient(self, units: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(rows, their gradients, times used) of one table after the other."""
        for d in self.model.decisions(units, before):
            wrong = self.model.chances(d)
            wrong[np.arange(len(d.child)), d.child] -= 1
            for t, r in d.rows:
                if not len(r):
                    continue
                order = np.argsort(r, kind="stable")  # 16 bits: by counting
                r = r.take(order)
                first = np.flatnonzero(np.append(True, r[1:] != r[:-1]))
                n = np.diff(np.append(first, len(r)))
                g = wrong.take(order.take(first), axis=0)
                more = np.flatnonzero(n > 1)
                if len(more):  # most rows are used once in a step, and need no sum
                    many = n.take(more)
                    g[more] = np.add.reduceat(wrong.take(order[np.repeat(n > 1, n)], axis=0), np.append(0, np.cumsum(many)[:-1]), axis=0)
                yield FIRST_ROW[t] + r.take(first).astype(np.int64), g, n

    def step(self, units: np.ndarray, before: np.ndarray) -> None:
        for r, g, n in self.gradient(units, before):
            squares = self.squares.take(r) + np.einsum("ij,ij->i", g, g) / WIDTH
            self.squares[r] = squares
            self.used[r] += n
            g *= (self.rate / np.sqrt(squares))[:, None]
            self.model.weights[r] -= g

    def changes(self) -> np.ndarray:
        """All rows: their change, times how often they were used, and that number."""
        used = self.used[:, None]
        return np.concatenate([(self.model.weights - self.start.weights) * used, used], axis=1)


# --- sums of arrays over all tasks --------------------------------------------------------------------------------------------

PACKED = "block int, part int, data binary"
#: Tasks whose arrays are summed before those of all.
TOGETHER = 32


def _pack(sums: np.ndarray, weighted: bool) -> bytes:
    """Sums as bytes; weighted ones, whose last column is the weight, as means of 16 bits and weights."""
    if weighted:
        weight = sums[:, -1:]
        data = (sums[:, :-1] / np.maximum(weight, 1)).astype("<f2").tobytes() + weight.astype("<f4").tobytes()
    else:
        data = sums.astype("<f4").tobytes()
    return pa.compress(data, codec="zstd", asbytes=True)


def _unpack(data: bytes, rows: int, columns: int, weighted: bool) -> np.ndarray:
    if not weighted:
        return np.frombuffer(pa.decompress(data, 4 * rows * columns, codec="zstd", asbytes=True), "<f4").reshape(rows, columns)
    cut = 2 * rows * (columns - 1)
    raw = pa.decompress(data, cut + 4 * rows, codec="zstd", asbytes=True)
    weight = np.frombuffer(raw[cut:], "<f4")[:, None]
    return np.concatenate([np.frombuffer(raw[:cut], "<f2").reshape(rows, -1).astype(np.float32) * weight, weight], axis=1)


def packed(x: np.ndarray, weighted: bool = False) -> Iterator[pa.RecordBatch]:
    """A task's array in blocks of rows; those of zeros only are left out."""
    part = TaskContext.get().partitionId() // TOGETHER
    for b, at in enumerate(range(0, len(x), BLOCK)):
        piece = x[at : at + BLOCK]
        if piece.any():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([_pack(piece, weighted)], pa.binary())], names=["block", "part", "data"])


def summed(blocks: DataFrame, rows: int, columns: int, weighted: bool = False) -> np.ndarray:
    """The sum of all tasks' arrays (rows x columns): first in groups of TOGETHER tasks, then of these."""
    spark = blocks.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for b, part, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                sums[b, part] = sums.get((b, part), 0.0) + _unpack(data, min(BLOCK, rows - b * BLOCK), columns, weighted).astype(np.float64)
        for (b, part), x in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([part], pa.int32()), pa.array([_pack(x, weighted)], pa.binary())], names=["block", "part", "data"])

    n = partitions(spark)
    some = blocks.repartition(n, "block", "part").mapInArrow(run, PACKED).withColumn("part", F.lit(0))
    out = np.zeros((rows, columns), np.float32)
    with cleaned(spark):
        found = some.repartition(n, "block").mapInArrow(run, PACKED).collect()  # rows x columns
    for r in found:
        at = r["block"] * BLOCK
        out[at : at + BLOCK] = _unpack(r["data"], min(BLOCK, rows - at), columns, weighted)
    return out


def _batches_of_ids(lex: Lexicon, batches: Iterator[pa.RecordBatch], tokens: int) -> Iterator[list[np.ndarray]]:
    waiting, size = [], 0
    for _, texts in _texts(batches, 0):
        for text in texts:
            ids = lex.ids(words_of(text))
            # A long document is cut for training; its pieces keep their words, not the few before the cut.
            for at in range(0, max(1, len(ids)), tokens):
                waiting.append(ids[at : at + tokens])
                size += len(waiting[-1]) + 1
                if size >= tokens:
                    yield waiting
                    waiting, size = [], 0
    if waiting:
        yield waiting


def company(train: DataFrame, lex: Lexicon) -> np.ndarray:
    """Units x anchors: how often one of the most frequent words stands shortly before a unit."""
    sent = train.sparkSession.sparkContext.broadcast(lex)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(WORDS * ANCHORS)
        for texts in _batches_of_ids(sent.value, batches, 1 << 17):
            _, units, before = events(sent.value, texts)
            for x in before[:2]:
                near = (x < min(ANCHORS, sent.value.far)) & (units < WORDS)
                total += np.bincount(units[near] * ANCHORS + x[near], minlength=len(total))
        yield from packed(total.reshape(WORDS, ANCHORS))

    return summed(train.mapInArrow(run, PACKED), WORDS, ANCHORS)


def train_round(train: DataFrame, lex: Lexicon, model: Model) -> Model:
    sent = train.sparkSession.sparkContext.broadcast((lex, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = sent.value
        learner = Learner(model)
        for texts in _batches_of_ids(lex, batches, STEP_TOKENS):
            learner.step(*events(lex, texts)[1:])
        yield from packed(learner.changes(), weighted=True)

    change = summed(train.mapInArrow(run, PACKED), FIRST_ROW[-1], WIDTH + 1, weighted=True)
    return Model(model.place, model.bias, model.weights + change[:, :-1] / np.maximum(change[:, -1:], 1))


def fit(docs: DataFrame, lex: Lexicon, rounds: int = ROUNDS) -> Model:
    """docs: (doc_id, text, held_out); those held out are not learned from."""
    train = docs.where("not held_out")
    model = first_model(lex, company(train.select("text"), lex))
    share = F.pmod(F.shiftright(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 3), F.lit(rounds))
    for i in range(rounds):
        model = train_round(train.where(share == i).select("text"), lex, model)
    return model


# --- scores -------------------------------------------------------------------------------------------------------------------

LOCAL = "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, model double, far long, words array<string>, times array<long>"


def local_scores(docs: DataFrame, lex: Lexicon, model: Model) -> DataFrame:
    """A row for each document: sums over what the frequent words tell, and its other words with their numbers."""
    sent = docs.sparkSession.sparkContext.broadcast((lex, model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = sent.value
        counts = np.append(lex.counts, 0)
        base = np.log10(counts + 1.0) - math.log10(lex.tokens + lex.types + 1)
        base[-1] = 0
        inside = np.where(lex.unit == RARE, np.log10(counts + 1.0) - math.log10(lex.rare_mass()), 0.0)
        inside[-1] = 0
        known = np.append(lex.counts > 0, False)
        end_base = math.log10(lex.end_count + 1) - math.log10(lex.tokens + lex.types + 1)
        number = TaskContext.get().partitionId() << 40
        for batch, texts in _texts(batches, 2):
            n = len(texts)
            words = [words_of(t) for t in texts]
            ids = [lex.ids(w) for w in words]
            doc = np.repeat(np.arange(n), [len(i) for i in ids])
            flat = np.concatenate(ids)
            add = lambda x, doc=doc, flat=flat, n=n: np.bincount(doc, x[flat], n)
            learned = np.zeros(n)
            at = 0
            while at < n:  # so many whole documents as make up a batch, or a part of one long document
                end, size = at, 0
                while end < n and (end == at or size + len(ids[end]) < STEP_TOKENS):
                    size += len(ids[end])
                    end += 1
                where, units, before = events(lex, ids[at:end])
                for cut in range(0, len(units), STEP_TOKENS):
                    piece = slice(cut, cut + STEP_TOKENS)
                    learned[at:end] += np.bincount(where[piece], model.log10(units[piece], before[:, piece]), end - at)
                at = end
            rest = [Counter(w for w, i in zip(ws, x.tolist(), strict=True) if i == lex.far) for ws, x in zip(words, ids, strict=True)]
            sizes = np.array([len(w) for w in words])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(number + np.arange(n), pa.int64()), pa.array(sizes + 1, pa.int64()), pa.array((add(known.astype(float)) + (lex.end_count > 0)).astype(np.int64)),
                    pa.array(add(base) + end_base), pa.array(learned + add(inside)), pa.array([sum(c.values()) for c in rest], pa.int64()),
                    pa.array([[w.decode() for w in c] for c in rest], pa.list_(pa.string())), pa.array([list(c.values()) for c in rest], pa.list_(pa.int64())),
                ],
                names=["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "model", "far", "words", "times"],
            )
            number += n

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, LOCAL)


def score(docs: DataFrame, rounds: int = ROUNDS, frequent: int = FREQUENT) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of all documents (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    counts = keep(spark, word_counts(docs.select("held_out", "text")))
    lex = lexicon(counts, docs.where("not held_out").count(), frequent)
    model = fit(docs, lex, rounds)
    found = keep(spark, local_scores(docs, lex, model))
    # The rarer words of all documents meet their counts; none of them is frequent, so no key is hot.
    far = found.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    learned = F.coalesce("learned", F.lit(0))
    sums = far.join(counts.select("word", "learned"), "word", "left").groupBy("row").agg(F.sum(F.log10(learned + 1) * F.col("times")).alias("logs"), F.sum(F.when(learned > 0, F.col("times")).otherwise(0)).alias("known"))
    both = found.drop("words", "times").join(sums, "row", "left").na.fill(0, ["logs", "known"])
    less = lambda mass: F.col("logs") - F.col("far") * math.log10(mass)
    out = both.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.col("known")).alias("n_known"), F.lit(lex.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + less(lex.tokens + lex.types + 1)).alias("base_score"), (F.col("model") + less(lex.rare_mass())).alias("score"),
    )
    out = keep(spark, out)
    discard(counts, found)
    return out


def op12_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
