"""SimHash near-duplicates by a hierarchical index over fingerprints in Gray order.

Fingerprints within ``most`` differing bits agree in at least one of ``most + 1`` blocks of bits (pigeonhole), so each
distinct fingerprint is dealt to one group for each block.  A large group is dealt again by the blocks of the
remaining bits.  Inside a group the fingerprints are sorted by Gray rank, which puts those that share leading bits, and
differ little, side by side.  Runs of neighbours form the leaves of a tree; a node keeps the bits that all below it share,
less those that its ancestors keep already.  A search walks down from the top with the differences so far, and drops a
whole subtree once they exceed ``most``, or once all below it is known to be linked with the query.  Links are merged at
once into the group's components, of which only a spanning star leaves the task: no group emits all its pairs.

Behaviour on unusual input: a null text has no words; a text without words has fingerprint zero and is linked like any
other; one with fewer than three words is one shingle; equal texts have equal fingerprints; rows that repeat a
doc_id share the component; a null doc_id takes part in no link and is its own null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm._common import keep, partitions, table
from routeloom.llm.graph import components

LEAF, FAN = 16, 16
#: A group with more distinct fingerprints is dealt again by the blocks of its other bits.
HOT_GROUP = 4096


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of each run of ``width`` words, joined by single spaces; fewer words are one run."""
    import xxhash

    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -width].tolist()]
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist(), strict=True)), np.uint64, len(starts))


def simhash(text: str | None, width: int = 3) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    return simhash_of(shingle_hashes(words, width))


def simhash_of(hashes: np.ndarray) -> int:
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        block = hashes[at : at + 4096]
        counts += np.unpackbits(block.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint32)
    bits = np.flatnonzero(2 * counts > len(hashes))
    return sum(1 << int(b) for b in bits)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((simhash(x, width) for x in batch.column(1).to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    x = x.copy()
    for s in (1, 2, 4, 8, 16, 32):
        x ^= x >> np.uint64(s)
    return x


class GrayIndex:
    """Hierarchy of shared bit patterns over distinct fingerprints; see the module's text."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes[np.argsort(gray_rank(codes), kind="stable")]
        ones, any_ = self.codes, self.codes  # of each node: bits set in all, in any below it
        shared = [np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))]
        pattern = [self.codes]
        width = [1]
        while len(ones) > 1:
            step = LEAF if len(width) == 1 else FAN
            cuts = np.arange(0, len(ones), step)
            ones, any_ = np.bitwise_and.reduceat(ones, cuts), np.bitwise_or.reduceat(any_, cuts)
            shared.append(~(ones ^ any_))
            pattern.append(ones)
            width.append(step)
        self.width = width
        self.pattern = pattern
        # What a node adds to its parent's bits.
        self.mask = [s if i + 1 == len(shared) else s & ~np.repeat(shared[i + 1], width[i + 1])[: len(s)] for i, s in enumerate(shared)]
        self.visited = 0

    def near(self, queries: np.ndarray, most: int, skip=None) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position in queries, position in codes) within ``most`` bits.  skip(q, lo, hi): subtrees that need no search."""
        top = len(self.mask) - 1
        q = np.arange(len(queries))
        node = np.zeros(len(queries), np.int64)
        diff = np.bitwise_count((queries ^ self.pattern[top][0]) & self.mask[top][0]).astype(np.int64)
        span = int(np.prod(self.width[1:], dtype=np.int64)) if top else 1
        for level in range(top, 0, -1):
            ok = diff <= most
            q, node, diff = q[ok], node[ok], diff[ok]
            if skip is not None and len(q):
                go = ~skip(q, node * span, np.minimum((node + 1) * span, len(self.codes)))
                q, node, diff = q[go], node[go], diff[go]
            fan = self.width[level]
            span //= fan
            child = (node[:, None] * fan + np.arange(fan)).ravel()
            q, diff = np.repeat(q, fan), np.repeat(diff, fan)
            real = child < len(self.mask[level - 1])
            q, node, diff = q[real], child[real], diff[real]
            self.visited += len(q)
            diff = diff + np.bitwise_count((queries[q] ^ self.pattern[level - 1][node]) & self.mask[level - 1][node])
        ok = diff <= most
        return q[ok], node[ok]


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (smallest position) after linking a[i] with b[i]."""
    while True:
        la, lb = label[a], label[b]
        open_ = la != lb
        if not open_.any():
            return label
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt


def group_links(codes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning star links among distinct fingerprints: pairs (code, representative) for each component of more than one."""
    if len(codes) <= 64:
        d = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= most
        a, b = np.nonzero(np.triu(d, 1))
        sorted_codes, label = codes, np.arange(len(codes))
        label = _merge(label, a, b)
    else:
        index = GrayIndex(codes)
        sorted_codes, label = index.codes, np.arange(len(codes))
        n = len(codes)
        # Neighbours in Gray order first: in a dense group they link most of it, and searches then skip it.
        for step in (1, 2, 3, 4):
            near = np.flatnonzero(np.bitwise_count(sorted_codes[step:] ^ sorted_codes[:-step]) <= most)
            label = _merge(label, near, near + step)
        for at in range(0, n, 1024):
            here = np.arange(at, min(n, at + 1024))

            def known(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, here=here) -> np.ndarray:
                """Whether all of a subtree has the query's label already."""
                change = np.concatenate([[0], np.cumsum(label[1:] != label[:-1])])
                same = change[hi - 1] == change[lo]
                # Links are symmetric, so what lies wholly before the query has been searched from the other side.
                return (same & (label[lo] == label[here[q]])) | (hi <= here[q])

            q, c = index.near(sorted_codes[here], most, known)
            label = _merge(label, here[q], c)
    other = np.flatnonzero(label != np.arange(len(label)))
    return sorted_codes[other], sorted_codes[label[other]]


def _blocks(bits: list[int], n: int) -> list[list[int]]:
    return [list(x) for x in np.array_split(np.array(bits), n)]


def _extract(fp, bits: list[int]):
    """Column: the given adjacent-or-not bits of fp, packed."""
    out, at, i = F.lit(0).cast("long"), 0, 0
    while i < len(bits):
        j = i
        while j + 1 < len(bits) and bits[j + 1] == bits[j] + 1:
            j += 1
        k = j - i + 1
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, bits[i]).bitwiseAND(F.lit((1 << k) - 1).cast("long")), at))
        at, i = at + k, j + 1
    return out


def near_links(codes: DataFrame, most: int = 3, hot: int = HOT_GROUP) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column fp) that span the components of the relation "at most ``most`` bits apart"."""
    spark = codes.sparkSession
    fp = F.col("fp")
    first = _blocks(list(range(64)), most + 1)
    dealt = codes.select("fp", F.explode(F.array(*[F.struct(F.lit(i).alias("block"), _extract(fp, b).alias("value")) for i, b in enumerate(first)])).alias("k")).select("fp", "k.*")
    sizes = dealt.groupBy("block", "value").count()
    large = keep(spark, sizes.where(F.col("count") > hot).select("block", "value"))
    if large.isEmpty():
        keyed = dealt.select("fp", F.struct("block", "value", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subvalue")).alias("k"))
    else:
        marked = dealt.join(large.withColumn("large", F.lit(True)), ["block", "value"], "left")
        subs = F.lit(None)
        for i, b in enumerate(first):
            rest = _blocks([x for x in range(64) if x not in b], most + 1)
            subs = F.when(F.col("block") == i, F.array(*[F.struct("block", "value", F.lit(j).alias("sub"), _extract(fp, r).alias("subvalue")) for j, r in enumerate(rest)])).otherwise(subs)
        one = F.array(F.struct("block", "value", F.lit(-1).alias("sub"), F.lit(0).cast("long").alias("subvalue")))
        keyed = marked.select("fp", F.explode(F.when(F.col("large"), subs).otherwise(one)).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([rows.column(i).to_numpy().astype(np.int64) for i in range(1, 5)])
            codes_ = rows.column(0).to_numpy().view(np.uint64)
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), len(codes_)]
            found = [group_links(codes_[a:b], most) for a, b in zip(cuts, cuts[1:], strict=False) if b - a > 1]
            if found:
                a, b = (np.concatenate(x).view(np.int64) for x in zip(*found, strict=True))
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        def last_key(batch: pa.RecordBatch, i: int) -> tuple:
            return tuple(batch.column(c)[i].as_py() for c in range(1, 5))

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            if last_key(batch, 0) != last_key(batch, batch.num_rows - 1) or sum(b.num_rows for b in held) > 1 << 16:
                rows = pa.Table.from_batches(held).combine_chunks()
                keys = [rows.column(i).to_numpy() for i in range(1, 5)]
                same = np.logical_and.reduce([k == k[-1] for k in keys])
                cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
                if cut:
                    yield from flush(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
        if held:
            yield from flush(pa.Table.from_batches(held).combine_chunks())

    names = ["block", "value", "sub", "subvalue"]
    grouped = keyed.select("fp", "k.*").repartition(partitions(spark), *names).sortWithinPartitions(*names, "fp")
    return grouped.mapInArrow(run, "a long, b long").distinct()


def same_id(rows: DataFrame, name: str) -> DataFrame:
    """Links (a, b) between the different values of column ``name`` that one doc_id has: its rows are one document."""
    several = rows.where("doc_id is not null").groupBy("doc_id").agg(F.min(name).alias("a"), F.max(name).alias("b")).where("a <> b").select("doc_id", "a")
    return rows.join(several, "doc_id").select("a", F.col(name).alias("b")).where("a <> b").distinct()


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3) -> DataFrame:
    """(doc_id, fp, component_id): the smallest doc_id reachable over links of fingerprints at most ``most`` bits apart."""
    spark = docs.sparkSession
    prints = keep(spark, fingerprints(docs, width))
    classes = keep(spark, prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = near_links(classes.select("fp"), most).unionByName(same_id(prints, "fp"))
    linked = components(links).select(F.col("node").alias("fp"), "component")
    grouped = keep(spark, classes.join(linked, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component")))
    lowest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    # The smallest fingerprint of a component names it, the smallest doc_id of all its fingerprints is its id.
    ids = grouped.join(lowest, "component").select("fp", "component_id")
    out = prints.join(ids, "fp", "left")
    return out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
