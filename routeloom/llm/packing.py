"""Best-fit packing of token pieces into fixed-length sequences by hierarchical residual packing.

Each partition packs its own items with best-fit decreasing.  Bins that are full, or nearly so, are final.  The
others become items of the next round, in which several partitions are merged into one: a tree of rounds, ended when
one task can hold what is left.  An item carries its members, so a bin of bins is still a list of pieces.

Behaviour on unusual input: a null or empty text has just the end id and is one piece; only documents longer than a
sequence are cut, and then the first piece is the shorter one; rows that repeat are packed like any other; an empty
table gives no rows.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm._common import keep, table

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
BIN = f"size long, final boolean, members array<struct<{PIECE.replace(' long', ':long').replace(' int', ':int')}>>"
#: Items that one task of the last rounds may hold.
TASK_ITEMS = 200_000
FAN_IN = 8


#: Different chunks of text whose ids a Python worker remembers.
MOST_CHUNKS = 1_200_000


class ChunkEncoder:
    """Token ids of texts as little-endian unsigned 32-bit bytes, with a bounded memory of chunks already encoded.

    The tokenizer's pre-tokens never reach over a single space or line feed between two other characters, and one that
    starts there doesn't depend on what came before.  So a text may be cut there, and each distinct chunk encoded once.
    """

    _TWO = re.compile(r"\s\s")
    _CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")

    def __init__(self, tokenizer_path: str, most_chunks: int = MOST_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.most_chunks = most_chunks
        self.known: dict[str, bytes] = {}
        self.inner: dict[str, bytes] = {}

    def _learn(self, chunks: list[str]) -> list[bytes]:
        return [np.asarray(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[bytes]:
        heads, rests = [], []
        for text in texts:
            if self._TWO.search(text) or text[:1].isspace() or text[-1:].isspace():
                heads.append(self._CUT.split(text))
                rests.append([])
            else:
                first, *rest = text.replace("\n", " \n").split(" ")
                heads.append([first])
                rests.append(rest)
        if len(self.known) + len(self.inner) > self.most_chunks:
            # What was learned first is mostly what is frequent.
            self.known, self.inner = (dict(islice(x.items(), self.most_chunks // 4)) for x in (self.known, self.inner))
        new = list(set().union(*heads).difference(self.known))
        self.known.update(zip(new, self._learn(new), strict=True))
        new = list(set().union(*rests).difference(self.inner))
        self.inner.update(zip(new, self._learn([x if x[:1] == "\n" else " " + x for x in new]), strict=True))
        known, inner = self.known.__getitem__, self.inner.__getitem__
        return [b"".join([*map(known, head), *map(inner, rest)]) for head, rest in zip(heads, rests, strict=True)]


@lru_cache(maxsize=2)
def encoder_for(tokenizer_path: str, most_chunks: int = MOST_CHUNKS) -> ChunkEncoder:
    """One for each Python worker, so that what a task has learned serves the next one."""
    return ChunkEncoder(tokenizer_path, most_chunks)


def _default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def token_pieces(docs: DataFrame, tokenizer_path: str | None = None, seq_len: int = 1024, end_id: int = 2, most_chunks: int = MOST_CHUNKS) -> DataFrame:
    """The pieces of each document (doc_id, text): doc_id, piece, start, length, ids_crc32.  most_chunks: that a worker remembers, some 200 bytes each."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = encoder_for(tokenizer_path or _default_tokenizer(), most_chunks)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                out: list[tuple] = []
                texts = [x or "" for x in batch.column(1).to_pylist()]
                for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(texts), strict=True):
                    ids += end
                    n = len(ids) // 4
                    cuts = [0, *range(n % seq_len or seq_len, n + 1, seq_len)]
                    out += [(doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                columns = list(zip(*out, strict=True)) if out else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECE)


def best_fit(sizes: np.ndarray, room: int) -> list[list[int]]:
    """Best-fit decreasing: lists of item positions, one for each bin.  sizes must be in descending order."""
    bins: list[list[int]] = []
    free: dict[int, list[int]] = {}
    levels: list[int] = []  # residuals that some bin has, ascending
    for i, size in enumerate(sizes.tolist()):
        k = bisect_left(levels, size)
        if k == len(levels):
            at, left = len(bins), room - size
            bins.append([i])
        else:
            level = levels[k]
            at = free[level].pop()
            if not free[level]:
                del free[level], levels[k]
            bins[at].append(i)
            left = level - size
        if left > 0:
            if left not in free:
                free[left] = []
                insort(levels, left)
            free[left].append(at)
    return bins


def _pack_round(items: DataFrame, seq_len: int, nearly: int, last: bool) -> DataFrame:
    """Bins of each partition's items (size, members); final ones are full to ``nearly``, or all of them in the last round."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [b for b in batches if b.num_rows]
        if not some:
            return  # a partition without items
        data = pa.Table.from_batches(some)
        members = data.column("members").combine_chunks()
        offsets, flat = members.offsets.to_numpy(), members.flatten()
        first = flat.take(pa.array(offsets[:-1] - offsets[0]))
        # Ordered by size, then by the first member: the same bins whatever order the rows come in.
        order = pa.compute.sort_indices(
            pa.table({"size": data.column("size").combine_chunks(), "doc_id": first.field("doc_id"), "piece": first.field("piece")}),
            sort_keys=[("size", "descending"), ("doc_id", "ascending"), ("piece", "ascending")],
        ).to_numpy()
        sizes = data.column("size").to_numpy()[order]
        bins = best_fit(sizes, seq_len)
        starts, ends = offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
        for at in range(0, len(bins), 4096):
            some = bins[at : at + 4096]
            rows = [[int(order[i]) for i in b] for b in some]
            picks = [np.concatenate([np.arange(starts[i], ends[i]) for i in b]) for b in rows]
            filled = [int(sizes[b].sum()) for b in some]
            values = flat.take(pa.array(np.concatenate(picks)))
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, picks)]), pa.int32()), values)
            yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int64()), pa.array([last or x >= nearly for x in filled]), lists], names=["size", "final", "members"])

    import pyarrow.compute  # noqa: F401  the workers use pa.compute

    return items.select("size", "members").mapInArrow(run, BIN)


def pack(pieces: DataFrame, seq_len: int = 1024, slack: int = 4, task_items: int = TASK_ITEMS) -> DataFrame:
    """``pieces`` with sequence_id and offset.  slack: a bin that is full but for so many tokens is final at once."""
    spark = pieces.sparkSession
    items = pieces.select(F.col("length").alias("size"), F.array(F.struct("doc_id", "piece", "start", "length", "ids_crc32")).alias("members"))
    whole, items = items.where(F.col("size") >= seq_len), items.where(F.col("size") < seq_len)
    done = [whole.select("members")]
    n = max(1, items.rdd.getNumPartitions())
    while True:
        bins = keep(spark, _pack_round(items, seq_len, seq_len - slack, n == 1))
        done.append(bins.where("final").select("members"))
        if n == 1:
            break
        items = bins.where("not final")
        # One task where it can hold all that is left; else a level of the tree that merges FAN_IN partitions into one.
        left = items.count()
        smaller = max(1, -(-n // FAN_IN)) if left > task_items else 1
        if smaller > 1 and left > task_items * smaller:
            # No two bins over half a sequence fit together, and best fit leaves at most one other a partition: those go on.
            large = 2 * F.col("size") > seq_len
            done.append(items.where(large).select("members"))
            items = items.where(~large)
        n = smaller
        items = items.repartition(n)
    placed = done[0]
    for x in done[1:]:
        placed = placed.union(x)
    placed = placed.select(F.monotonically_increasing_id().alias("sequence_id"), "members")
    before = F.expr("transform(sequence(1, size(members)), i -> aggregate(slice(members, 1, i - 1), 0L, (a, m) -> a + m.length))")
    out = placed.select("sequence_id", F.explode(F.arrays_zip(F.col("members"), before.alias("offset"))).alias("m"))
    return out.select("m.members.*", "sequence_id", F.col("m.offset").alias("offset"))


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = keep(spark, token_pieces(table(spark, sf_dir, "documents")))
    return pack(pieces)
