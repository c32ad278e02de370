"""Lempel-Ziv phrase fingerprints of documents.

A text is parsed as in LZ78: each phrase is the shortest piece that isn't yet in the dictionary, and joins it.  The
set of phrases is what a compressor would have learned from the text, so two texts that share content share
phrases.  Phrases are hashed, and the smallest hashes are the fingerprint: a bottom-k minimum-hash signature, from
which the Jaccard likeness of two phrase sets is estimated.

Behaviour on unusual input: a null text counts as empty; an empty text has the empty fingerprint, which is wholly like
itself and not like any other; equal texts have equal fingerprints; very long texts are parsed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm._common import partitions, table

SIGNATURE = 64
_MULT = np.uint64(0x9E3779B97F4A7C15)


def phrases(text: str, known: set[str], starts: list[int], ends: list[int], at: int = 0, stop: int | None = None) -> int:
    """Parse ``text`` from ``at`` and append the bounds of new phrases; returns where the open phrase at ``stop`` begins.

    Only phrases that end before ``stop`` are taken, or, without it, all: the last one may then be one that is known.
    The dictionary holds every prefix of its phrases, so the length of the longest known piece can be found by steps
    from a first guess.
    """
    n = len(text)
    end = n if stop is None else stop
    size = 4
    while at < end:
        k = size if at + size <= end else end - at
        if text[at : at + k] in known:
            k += 1
            while at + k <= end and text[at : at + k] in known:
                k += 1
            if at + k > end:
                break
        else:
            while k > 1 and text[at : at + k - 1] not in known:
                k -= 1
        known.add(text[at : at + k])
        starts.append(at)
        at += k
        ends.append(at)
        size = k
    if stop is None and at < n:
        starts.append(at)
        ends.append(n)
        return n
    return at


def _prefix_hashes(codes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Running sums of mixed code points times powers of an odd base, modulo 2**64."""
    mixed = (codes.astype(np.uint64) + np.uint64(1)) * _MULT
    mixed ^= mixed >> np.uint64(29)
    out = np.zeros(len(codes) + 1, np.uint64)
    np.cumsum(mixed * powers[: len(codes)], out=out[1:])
    return out


class Fingerprinter:
    """Fingerprints of texts; keeps tables of powers for the longest text so far."""

    BASE = 0xD6E8FEB86659FD93

    def __init__(self, k: int = SIGNATURE):
        self.k, self.powers, self.inverse = k, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n > len(self.powers):
            m = 1 << (n - 1).bit_length()
            self.powers = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, self.BASE, np.uint64))])
            self.inverse = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m - 1, pow(self.BASE, -1, 1 << 64), np.uint64))])

    def hashes(self, text: str, starts: list[int], ends: list[int]) -> np.ndarray:
        """64-bit hashes of the pieces of ``text``, the same wherever a piece stands."""
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
        self._grow(len(codes) + 1)
        sums = _prefix_hashes(codes, self.powers)
        a, b = np.asarray(starts, np.int64), np.asarray(ends, np.int64)
        h = (sums[b] - sums[a]) * self.inverse[a] + (b - a).astype(np.uint64)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(32))

    def smallest(self, hashes: np.ndarray) -> np.ndarray:
        """The k smallest distinct hashes, cut to their upper 32 bits, in order."""
        some = hashes
        if len(some) > 4 * self.k:
            some = np.partition(some, 2 * self.k)[: 2 * self.k]
        some = np.unique((some >> np.uint64(32)).astype(np.uint32))
        if len(some) < self.k < len(hashes):
            some = np.unique((hashes >> np.uint64(32)).astype(np.uint32))
        return some[: self.k]

    def of(self, text: str) -> np.ndarray:
        starts, ends = [], []
        phrases(text, set(), starts, ends)
        return self.smallest(self.hashes(text, starts, ends)) if text else np.zeros(0, np.uint32)

    def of_both(self, text: str, other: str, cut: int) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints of ``text`` and of ``other``, which is equal to it up to ``cut``; the common part is parsed once."""
        if not text or not other:
            return self.of(text), self.of(other)
        known: set[str] = set()
        starts, ends = [], []
        at = phrases(text, known, starts, ends, 0, cut)
        starts2, ends2 = starts.copy(), ends.copy()
        known2 = known.copy()
        phrases(text, known, starts, ends, at)
        phrases(other, known2, starts2, ends2, at)
        return self.smallest(self.hashes(text, starts, ends)), self.smallest(self.hashes(other, starts2, ends2))


def likeness(a: np.ndarray, b: np.ndarray, k: int = SIGNATURE) -> float:
    """Jaccard estimate from two bottom-k signatures: the share of the k smallest of both together that each has."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:k]
    return float(np.isin(both, a, assume_unique=True) @ np.isin(both, b, assume_unique=True).astype(np.int64)) / len(both)


def fingerprint_text(signature: np.ndarray) -> str:
    return signature.astype(">u4").tobytes().hex()


def fingerprint(docs: DataFrame, id_col: str = "doc_id", text: str = "text", k: int = SIGNATURE) -> DataFrame:
    """(id, fingerprint) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(k)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fingerprint_text(maker.of(x or "")) for x in batch.column(1).to_pylist()], pa.string())], names=[id_col, "fingerprint"])

    return docs.select(F.col(id_col).cast("long").alias(id_col), text).mapInArrow(run, f"{id_col} long, fingerprint string")


def with_edits(docs: DataFrame, parts: int | None = None, k: int = SIGNATURE) -> DataFrame:
    """Each document (doc_id, text) beside its edited text and the next document, in descending doc_id (null last, then by text).

    The rows are dealt out once, by ranges of doc_id.  The first row of a range is also sent to the range above it, whose
    last row it follows, so each task has all it needs: what is driver-side is two ids for each range.
    """
    spark = docs.sparkSession
    key = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("key", key)
    n = parts or max(2, partitions(spark))
    cuts = sorted({int(x) for x in rows.approxQuantile("key", [i / n for i in range(1, n)], 0.2 / n)})
    # Part 0 has the largest ids.
    bounds = F.expr("cast(split('" + ",".join(map(str, cuts)) + "', ',') as array<bigint>)")
    part = (F.lit(len(cuts)) - F.size(F.filter(bounds, lambda x: x <= F.col("key")))).cast("int") if cuts else F.lit(0)
    tops = {r["part"]: r["top"] for r in rows.select(part.alias("part"), "key").groupBy("part").agg(F.max("key").alias("top")).collect()}
    if not tops:
        return spark.createDataFrame([], EDITED)
    used = sorted(tops)
    # The first row of a part follows the last row of the part above; that of the first part follows the last part.
    halo = F.create_map(*[F.lit(x) for i, p in enumerate(used) for x in (tops[p], used[i - 1])])
    here = rows.select("doc_id", "text", "key", part.alias("part"), F.lit(0).alias("guest"))
    guests = rows.where(F.col("key").isin(list(tops.values()))).select("doc_id", "text", "key", halo[F.col("key")].alias("part"), F.lit(1).alias("guest"))
    dealt = here.unionByName(guests).repartitionById(used[-1] + 1, F.col("part"))
    order = [F.col("guest"), F.col("key").desc(), F.col("text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker = Fingerprinter(k)
        out: list[tuple] = []
        mine: tuple | None = None  # the row that waits for the next one: id, text
        waits: tuple | None = None  # a finished row that waits for the next one's fingerprint

        def finish(next_text: str) -> None:
            nonlocal waits
            doc_id, text = mine
            m = len(text) // 3
            cut = len(text) - m
            edited = text[:cut] + next_text[:m]
            own, other = maker.of_both(text, edited, cut)
            settle(own)
            waits = (doc_id, len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own, other)

        def settle(next_own: np.ndarray) -> None:
            nonlocal waits
            if waits:
                doc_id, size, sha, own, other = waits
                out.append((doc_id, size, sha, fingerprint_text(own), fingerprint_text(other), likeness(own, other, k), likeness(own, next_own, k)))
                waits = None

        def batch_of() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[x.split(" ")[0] for x in EDITED.split(", ")])
            out.clear()
            return made

        ended = False
        for batch in batches:
            for doc_id, text, guest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if ended:
                    continue
                if mine:
                    finish(text)
                mine = (doc_id, text)
                if guest:
                    settle(maker.of(text))
                    ended = True
                if len(out) >= 512:
                    yield batch_of()
        if not ended and mine:
            raise ValueError("a range of documents has no row after it")
        if out:
            yield batch_of()

    return dealt.sortWithinPartitions(*order).select("doc_id", "text", "guest").mapInArrow(run, EDITED)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_edits(table(spark, sf_dir, "documents"))

