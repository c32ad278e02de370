"""Removal of repeated word windows with a log-structured index of window hashes.

Every window of ``window`` words has a 64-bit hash, which orders the index, and an independent tag, which verifies a match.
Each task turns its documents into sorted immutable runs, one for each range of hashes, in which a hash stands once, with
the smallest doc_id of the run; repeats inside a run are settled on the spot, so a passage that stands in a third of all
documents reaches a merge once for each run only.  Runs of a range meet in one task, are merged (a stable sort of sorted
runs) and joined with the historical run of that range, if there is one.  Matches go back to the documents of the new
batch, and the union of hashes is the compacted run for the next batch.

A match is two windows with equal hash and equal tag, 64 + 8 * tag_bytes bits in all, in the merge and in the document that
loses words; among N windows some pair is taken for equal by mistake with a chance of about N * N / 2 ** (65 + 8 * tag_bytes).

Behaviour on unusual input: a null text has no words, and texts with fewer words than a window are left alone; a null
doc_id comes after all others; rows that repeat a doc_id are not smaller than each other, so none of them makes the
others lose words; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm._common import cleaned, discard, keep, partitions, shared_dir, table

WINDOW = 13
#: Bytes of the tag, up to 8: a parameter of the index, one byte of shuffle for each window.
TAG_BYTES = 2
#: Windows in a run; and in a range of hashes, at most about so many.
RUN_WINDOWS, RANGE_WINDOWS = 1_000_000, 3_000_000
#: A range is merged in pieces of about so many windows, and its marks are passed on when there are so many: what a task holds besides the decoded runs.
PIECE_WINDOWS = 400_000
#: Bytes of text that are hashed at once (or one text).
HASH_BYTES = 1 << 19
NULL_ID = (1 << 63) - 1
ROWS = "part int, kind int, doc_id long, data binary"
RUN, SPANS, INDEX = 0, 1, 2

_U = np.uint64
_BASE, _BASE1, _BASE2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * _U(2) + _U(1)


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + _U(salt)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def grow(self, n: int) -> None:
        if n > len(self.up):
            m = 1 << n.bit_length()
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)])) for b in (self.base, pow(self.base, -1, 1 << 64)))


class WindowHasher:
    """Hashes and tags of all windows of a list of texts (UTF-8 bytes), without a loop over words."""

    def __init__(self, window: int = WINDOW, tag_bytes: int = TAG_BYTES):
        self.window, self.tag_bytes = window, tag_bytes
        self.byte, self.one, self.two = _Powers(_BASE), _Powers(_BASE1), _Powers(_BASE2)

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each window: hash, tag, position of its text in the list, its first word; texts in order."""
        buf = np.frombuffer(b"\n".join([*texts, b""]) if texts else b"\n", np.uint8)
        white = _WHITE[buf]
        edge = np.flatnonzero(white[1:] != white[:-1]) + 1
        if not white[0]:
            edge = np.concatenate([[0], edge])
        starts, ends = edge[0::2], edge[1::2]
        k = self.window
        sizes = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        text_at = np.concatenate([[0], np.cumsum(sizes)])
        if len(ends) < len(starts):
            ends = np.concatenate([ends, [len(buf)]])
        if len(starts) < k:
            return np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.byte.grow(len(buf) + 1)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(_BYTES[buf] * self.byte.up[: len(buf)], out=sums[1:])
        word = (sums[ends] - sums[starts]) * self.byte.down[starts] + (ends - starts).astype(np.uint64)
        of = np.searchsorted(text_at, starts, side="right") - 1
        whole = np.flatnonzero(of[k - 1 :] == of[: len(of) - k + 1])
        found = []
        for salt, powers in ((1, self.one), (2, self.two)):
            powers.grow(len(word) + 1)
            sums = np.zeros(len(word) + 1, np.uint64)
            np.cumsum(_mix(word, salt) * powers.up[: len(word)], out=sums[1:])
            found.append(_mix((sums[whole + k] - sums[whole]) * powers.down[whole], salt))
        first = np.searchsorted(of, np.arange(len(texts)))  # each text's first word
        return found[0], found[1] >> _U(64 - 8 * self.tag_bytes), of[whole], whole - first[of[whole]]


def _low_bytes(x: np.ndarray, n: int) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def _from_low(data: bytes, count: int, n: int, at: int) -> np.ndarray:
    out = np.zeros((count, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8, n * count, at).reshape(count, n)
    return out.view("<u8").ravel()


def _tag_type(n: int) -> np.dtype:
    """The smallest type that holds tags of so many bytes, as tasks hold one for each window."""
    return np.dtype(f"<u{1 << (n - 1).bit_length()}")


def encode_run(h: np.ndarray, tag: np.ndarray, owner: np.ndarray | None, ids: np.ndarray | None, tag_bytes: int = TAG_BYTES) -> bytes:
    """A run in hash order: its steps between upper 24 bits (compressed), lower 40 bits, tags, owners (positions in ids; the ids' steps are compressed too)."""
    upper = (h >> _U(40)).astype(np.int64)
    steps = np.diff(upper, prepend=0).astype("<u4")
    packed = pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)
    low = _low_bytes(h, 5)
    tail = b""
    if owner is not None:
        names, own = np.unique(ids[owner], return_inverse=True)
        kind = "<u2" if len(names) <= 1 << 16 else "<u4"
        # Steps from name to name, their bytes by place: most are zero.
        gaps = np.diff(names.astype("<i8"), prepend=np.int64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()
        gaps = pa.compress(gaps, codec="zstd", asbytes=True)
        tail = np.array([len(names), len(gaps)], "<u8").tobytes() + gaps + own.astype(kind).tobytes()
    return np.array([len(h), len(packed), tag_bytes], "<u8").tobytes() + packed + low + _low_bytes(tag, tag_bytes) + tail


def decode_run(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """hash, tag, doc_id (None in a historical run)."""
    n, k, tag_bytes = (int(x) for x in np.frombuffer(data, "<u8", 3))
    at = 24
    steps = np.frombuffer(pa.decompress(data[at : at + k], 4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel()
    at += k
    h = _from_low(data, n, 5, at) | (np.cumsum(steps.astype(np.uint64)) << _U(40))
    at += 5 * n
    tag = _from_low(data, n, tag_bytes, at)
    at += tag_bytes * n
    if at == len(data):
        return h, tag, None
    m, k = (int(x) for x in np.frombuffer(data, "<u8", 2, at))
    at += 16
    gaps = np.frombuffer(pa.decompress(data[at : at + k], 8 * m, codec="zstd", asbytes=True), np.uint8).reshape(8, m).T.copy().view("<i8").ravel()
    own = np.frombuffer(data, "<u2" if m <= 1 << 16 else "<u4", n, at + k)
    return h, tag, np.cumsum(gaps)[own]


def _order(h: np.ndarray, tag: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash (stable: it merges sorted runs), where a new (hash, tag) begins, and the rows whose (hash, tag) a smaller doc has too.

    Ties of a hash are put in order too."""
    order = np.argsort(h, kind="stable")
    hs = h[order]
    new = np.ones(len(h), bool)
    new[1:] = hs[1:] != hs[:-1]
    del hs
    same = np.flatnonzero(~new)
    if not len(same):
        return order, new, same
    rows = np.unique(np.concatenate([same - 1, same]))  # only rows of repeated hashes are ordered further
    sub = order[rows]
    sub = sub[np.lexsort((doc[sub], tag[sub], h[sub]))]
    order[rows] = sub
    starts = np.ones(len(sub), bool)
    starts[1:] = (h[sub[1:]] != h[sub[:-1]]) | (tag[sub[1:]] != tag[sub[:-1]])
    new[rows] = starts
    docs = doc[sub]
    lowest = docs[np.maximum.accumulate(np.where(starts, np.arange(len(starts)), 0))]
    return order, new, sub[docs > lowest]


def _ranges(values: np.ndarray) -> np.ndarray:
    """Sorted positions as (first, length) pairs."""
    cut = np.flatnonzero(np.diff(values) != 1) + 1
    first = values[np.concatenate([[0], cut])]
    last = values[np.concatenate([cut - 1, [len(values) - 1]])]
    return np.stack([first, last - first + 1], axis=1)


def place_of(ids: np.ndarray, parts: int) -> np.ndarray:
    """The part in which a document meets its marks; remove_marked() has the same rule as an expression."""
    u = ids.astype(np.int64).view(np.uint64)
    return (u ^ (u >> _U(17)) ^ (u >> _U(37))).view(np.int64) % parts


def _text_key(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=8).digest()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["part", "kind", "doc_id", "data"])


def build_runs(docs: DataFrame, parts: int, window: int = WINDOW, tag_bytes: int = TAG_BYTES) -> DataFrame:
    """ROWS of new documents (doc_id, text): a run for each range of hashes, and the spans that repeat inside a run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHasher(window, tag_bytes)
        held: list[tuple] = []  # hash, tag, row, word
        ids: list[int] = []
        keys: list[bytes] = []
        total = 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [list(x) for x in zip(*held, strict=True)]
            held.clear()
            h, tag, row, word = (np.concatenate(columns.pop(0)) for _ in range(4))
            names = np.array(ids, np.int64)
            order, new, again = _order(h, tag, names[row])
            again = np.sort(again)
            first = order[new]
            del order, new
            bounds = np.searchsorted(h[first], np.array([-(-(i << 64) // parts) for i in range(1, parts)], np.uint64))
            out, size = [], 0
            for p, (a, b) in enumerate(zip([0, *bounds], [*bounds, len(first)], strict=True)):
                if b > a:
                    some = first[a:b]
                    out.append((p, RUN, None, encode_run(h[some], tag[some], row[some], names, tag_bytes)))
                    size += len(out[-1][3])
                    if len(out) == 1000 or size > 1 << 22:
                        yield _batch(out)
                        out, size = [], 0
            del h, tag, first
            if len(again):
                r, w = row[again], word[again]
                cuts = [0, *(np.flatnonzero(r[1:] != r[:-1]) + 1).tolist(), len(r)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    i = int(r[a])
                    out.append((int(place_of(names[i : i + 1], parts)[0]), SPANS, ids[i], keys[i] + _ranges(w[a:b].astype(np.int64)).astype("<u4").tobytes()))
            for at in range(0, len(out), 1000):
                yield _batch(out[at : at + 1000])
            ids.clear()
            keys.clear()

        for batch in batches:
            names = batch.column(0).fill_null(NULL_ID).to_pylist()
            texts = batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= HASH_BYTES):
                    size += len(texts[end])
                    end += 1
                h, tag, row, word = hasher(texts[at:end])
                held.append((h, tag.astype(_tag_type(tag_bytes)), (row + len(ids)).astype(np.int32), word.astype(np.int32)))
                ids += names[at:end]
                keys += [_text_key(t) for t in texts[at:end]]
                total += len(h)
                at = end
                if total >= RUN_WINDOWS:
                    yield from flush()
                    total = 0
        if total:
            yield from flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ROWS)


def _pieces(runs: list[bytes], tag_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """hash, tag, doc_id (the least number, for historical runs) of some runs, a stretch of hashes after the other; equal hashes are in one."""
    decoded = []
    while runs:
        h, tag, doc = decode_run(runs.pop())
        decoded.append((h, tag.astype(_tag_type(tag_bytes)), doc))
    pieces = -(-sum(len(x[0]) for x in decoded) // PIECE_WINDOWS)
    low, high = min(int(x[0][0]) for x in decoded), max(int(x[0][-1]) for x in decoded)
    bounds = np.array([low + (high - low) * i // pieces for i in range(1, pieces)], np.uint64)  # hashes are even
    cuts = [[0, *np.searchsorted(x[0], bounds).tolist(), len(x[0])] for x in decoded]
    for i in range(len(bounds) + 1):
        some = [(h[c[i] : c[i + 1]], tag[c[i] : c[i + 1]], None if doc is None else doc[c[i] : c[i + 1]]) for (h, tag, doc), c in zip(decoded, cuts, strict=True)]
        yield tuple(np.concatenate(x) for x in zip(*((h, tag, np.full(len(h), -NULL_ID - 1, np.int64) if doc is None else doc) for h, tag, doc in some), strict=True))


def _marks(held: list[tuple], parts: int, tag_bytes: int) -> Iterator[pa.RecordBatch]:
    """Rows of marks (hash, tag, doc_id), one for all documents of a place."""
    hs, tags, d = (np.concatenate(x) for x in zip(*held, strict=True))
    place = place_of(d, parts)
    order = np.lexsort((d, place))
    hs, tags, d, place = hs[order], tags[order], d[order], place[order]
    out = []
    cuts = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(d)] if len(d) else [0]
    for a, b in zip(cuts, cuts[1:], strict=False):
        names, counts = np.unique(d[a:b], return_counts=True)
        out.append((int(place[a]), RUN, None, np.array([len(names)], "<u8").tobytes() + names.astype("<i8").tobytes() + counts.astype("<u4").tobytes() + hs[a:b].astype("<u8").tobytes() + _low_bytes(tags[a:b], tag_bytes)))
    for at in range(0, len(out), 1000):
        yield _batch(out[at : at + 1000])


def merge_runs(rows: DataFrame, parts: int, index: bool = False, tag_bytes: int = TAG_BYTES) -> DataFrame:
    """Merge the runs of each range of hashes.

    Gives, for the documents of runs with ids, the hashes that a smaller doc_id or a historical run has too, with their tags
    (kind RUN, a row for all documents of a place, further ones where there are more than PIECE_WINDOWS) and passes spans on; or, with ``index``,
    the compacted runs of each range (kind INDEX), one for each piece of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[bytes]] = {}
        for batch in batches:
            if not index:
                spans = batch.filter(pa.compute.equal(batch.column(1), SPANS))
                if spans.num_rows:
                    yield spans
            for part, kind, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if kind != SPANS:
                    by_part.setdefault(part, []).append(data)
        batch = spans = data = None  # the last ones would stay
        for part in sorted(by_part):
            held: list[tuple] = []
            for h, tag, doc in _pieces(by_part.pop(part), tag_bytes):
                order, new, later = _order(h, tag, doc)
                if index:
                    first = order[new]
                    yield _batch([(part, INDEX, None, encode_run(h[first], tag[first], None, None, tag_bytes))])
                    continue
                held.append((h[later], tag[later], doc[later]))
                del h, tag, doc, order, new, later
                if sum(len(x[0]) for x in held) >= PIECE_WINDOWS:
                    yield from _marks(held, parts, tag_bytes)
                    held = []
            if held:
                yield from _marks(held, parts, tag_bytes)

    import pyarrow.compute  # noqa: F401  the workers use pa.compute

    return rows.repartitionById(parts, F.col("part")).mapInArrow(run, ROWS)


def _in_both(h: np.ndarray, tag: np.ndarray, marked: np.ndarray, tags: np.ndarray) -> np.ndarray:
    """Whether each (h, tag) is one of the (marked, tags)."""
    order = np.lexsort((tags, marked))
    marked, tags = marked[order], tags[order]
    low, high = np.searchsorted(marked, h, "left"), np.searchsorted(marked, h, "right")
    found = np.zeros(len(h), bool)
    for step in range(int((high - low).max(initial=0))):  # equal hashes: rows that repeat a doc_id, or other tags
        some = np.flatnonzero(low + step < high)
        found[some] |= tags[low[some] + step] == tag[some]
    return found


def _by_doc(held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All marks (doc_id, hash, tag) in order of doc_id; empties the list."""
    if not held:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    columns = [list(x) for x in zip(*held, strict=True)]
    held.clear()
    doc, h, tag = (np.concatenate(columns.pop(0)) for _ in range(3))
    order = np.argsort(doc, kind="stable")
    return doc[order], h[order], tag[order]


KEPT = "doc_id long, n_words long, n_removed long, kept_text string"
KEPT_DIGEST = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def remove_marked(docs: DataFrame, marks: DataFrame, parts: int, window: int = WINDOW, digest: bool = False, tag_bytes: int = TAG_BYTES) -> DataFrame:
    """The documents without the words that a marked window covers: KEPT, or KEPT_DIGEST."""
    name = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))
    texts = docs.select(name.alias("doc_id"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    mixed = F.col("doc_id").bitwiseXOR(F.shiftrightunsigned("doc_id", 17)).bitwiseXOR(F.shiftrightunsigned("doc_id", 37))
    texts = texts.select(F.pmod(mixed, F.lit(parts)).cast("int").alias("part"), F.lit(INDEX).alias("kind"), "doc_id", "data")
    dealt = texts.unionByName(marks).repartitionById(parts, F.col("part")).sortWithinPartitions("kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WindowHasher(window, tag_bytes)
        held: list[tuple] = []  # doc_ids, hashes and tags of marks
        flags: tuple | None = None  # all of them by doc_id; marks come before texts
        spans: dict[tuple[int, bytes], list[bytes]] = {}
        for batch in batches:
            out: list[tuple] = []
            for doc_id, kind, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == RUN:
                    n = int(np.frombuffer(data, "<u8", 1)[0])
                    names = np.frombuffer(data, "<i8", n, 8)
                    counts = np.frombuffer(data, "<u4", n, 8 + 8 * n)
                    total = int(counts.sum())
                    hashes = np.frombuffer(data, "<u8", total, 8 + 12 * n)
                    tags = _from_low(data, total, tag_bytes, 8 + 12 * n + 8 * total)
                    held.append((np.repeat(names, counts), hashes, tags.astype(_tag_type(tag_bytes))))
                    continue
                if kind == SPANS:
                    spans.setdefault((doc_id, data[:8]), []).append(data[8:])
                    continue
                if flags is None:
                    flags = _by_doc(held)
                words = data.split()
                n = len(words)
                mask = np.zeros(n + 1, np.int64)
                for x in spans.get((doc_id, _text_key(data)), ()) if spans else ():
                    for first, length in np.frombuffer(x, "<u4").reshape(-1, 2).astype(np.int64).tolist():
                        mask[first] += 1
                        mask[first + length - 1 + window] -= 1
                a, b = np.searchsorted(flags[0], [doc_id, doc_id + 1]).tolist() if doc_id < NULL_ID else (int(np.searchsorted(flags[0], doc_id)), len(flags[0]))
                if b > a and n >= window:
                    h, tag, _, word = hasher([data])
                    hit = word[_in_both(h, tag, flags[1][a:b], flags[2][a:b])]
                    mask[hit] += 1
                    mask[hit + window] -= 1
                gone = np.cumsum(mask[:-1]) > 0
                removed = int(gone.sum())
                if removed:
                    words = [words[i] for i in np.flatnonzero(~gone).tolist()]
                kept = b" ".join(words)
                out.append((None if doc_id == NULL_ID else doc_id, n, removed, hashlib.sha256(kept).hexdigest() if digest else kept.decode("utf-8", "replace")))
            if out:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256" if digest else "kept_text"])

    return dealt.select("doc_id", "kind", "data").mapInArrow(run, KEPT_DIGEST if digest else KEPT)


def ranges_for(docs: DataFrame) -> int:
    """So many ranges of hashes that each holds about RANGE_WINDOWS windows at most (a word has some six bytes)."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return max(partitions(docs.sparkSession), size // 6 // RANGE_WINDOWS + 1)


def dedup(docs: DataFrame, window: int = WINDOW, digest: bool = False, tag_bytes: int = TAG_BYTES) -> DataFrame:
    """One batch without history: of equal windows, those of the smallest doc_id stay."""
    parts = ranges_for(docs)
    # The marks are written, so that the runs' shuffle files are gone before the texts are dealt.
    marks = keep(docs.sparkSession, merge_runs(build_runs(docs, parts, window, tag_bytes), parts, tag_bytes=tag_bytes))
    return remove_marked(docs, marks, parts, window, digest, tag_bytes)


class FingerprintIndex:
    """The historical runs of a corpus in a folder, for batch after batch.

    ``add`` removes from a batch what earlier batches, or smaller doc_ids of its own, hold already, and appends the batch's
    run as a new level; when there are more than ``levels``, all are compacted into one.  ``parts`` stays the same for
    the life of an index, and so does ``tag_bytes``.
    """

    def __init__(self, spark: SparkSession, folder: str, parts: int, window: int = WINDOW, levels: int = 4, tag_bytes: int = TAG_BYTES):
        self.spark, self.folder, self.parts, self.window, self.levels, self.tag_bytes = spark, folder, parts, window, levels, tag_bytes

    def _generations(self) -> list[str]:
        try:
            rows = self.spark.read.parquet(f"{self.folder}/log").collect()  # one short row for each level ever written
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise  # a log that can't be read is no empty one
            return []
        gone = {x for r in rows for x in r["replaces"]}
        return [r["level"] for r in sorted(rows, key=lambda r: r["level"]) if r["level"] not in gone]

    def _append(self, rows: DataFrame, replaces: list[str]) -> None:
        import time

        level = f"level-{time.time_ns():020d}"
        with cleaned(self.spark):
            rows.write.option("compression", "zstd").parquet(f"{self.folder}/{level}")
        self.spark.createDataFrame([(level, replaces)], "level string, replaces array<string>").write.mode("append").parquet(f"{self.folder}/log")

    def history(self) -> DataFrame:
        levels = self._generations()
        if not levels:
            return self.spark.createDataFrame([], ROWS)
        return self.spark.read.schema(ROWS).parquet(*[f"{self.folder}/{x}" for x in levels])

    def add(self, docs: DataFrame, digest: bool = False, last: bool = False) -> DataFrame:
        """The batch without repeated windows (KEPT, or KEPT_DIGEST).  The result is written before the index grows; after the ``last`` batch it doesn't."""
        runs = build_runs(docs, self.parts, self.window, self.tag_bytes)
        runs = runs if last else keep(self.spark, runs)
        # The marks are written, so that the runs' shuffle files are gone before the texts are dealt.
        marks = keep(self.spark, merge_runs(self.history().unionByName(runs), self.parts, tag_bytes=self.tag_bytes))
        out = keep(self.spark, remove_marked(docs, marks, self.parts, self.window, digest, self.tag_bytes))
        discard(marks)
        if not last:
            self._append(merge_runs(runs, self.parts, index=True, tag_bytes=self.tag_bytes), [])
            discard(runs)
            if len(self._generations()) > self.levels:
                self.compact()
        return out

    def compact(self) -> None:
        """All levels as one; those that it replaces are deleted."""
        levels = self._generations()
        self._append(merge_runs(self.history(), self.parts, index=True, tag_bytes=self.tag_bytes), levels)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        for x in levels:
            files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{x}"), True)

    def delete(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


#: Batches of the registered query.
BATCHES = 3


def dedup_in_batches(docs: DataFrame, batches: int = BATCHES, window: int = WINDOW, digest: bool = False, tag_bytes: int = TAG_BYTES) -> DataFrame:
    """``dedup`` through the index: documents come in batches by doc_id, null ids in the last one, and levels are compacted on the way.

    A window in the history stands in a batch before, so in a document with a smaller doc_id.  Rows of one doc_id are in one batch; where doc_ids repeat a lot batches may be empty.
    """
    spark = docs.sparkSession
    cuts = sorted({int(x) for x in docs.select(F.col("doc_id").cast("long").alias("doc_id")).approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)})
    batch = sum((F.when(F.col("doc_id").cast("long") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    batch = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(batch)
    index = FingerprintIndex(spark, shared_dir(spark), ranges_for(docs), window, levels=1, tag_bytes=tag_bytes)
    out = None
    for i in range(len(cuts) + 1):
        part = index.add(docs.where(batch == i), digest, last=i == len(cuts))
        out = part if out is None else out.unionByName(part)
    index.delete()
    return out


def op1_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_in_batches(table(spark, sf_dir, "documents"), digest=True)
