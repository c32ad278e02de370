"""WARC archives packaged in ZIP files: a writer with payload deduplication, and a range reader.

An archive is a ZIP file whose members are stored, not compressed: ``archive/data.warc.gz`` (one gzip member for each
WARC record) and ``indexes/index.cdxj`` (a line for each record, with its offset and length inside the first).  The
reader parses the end record, the ZIP64 locator and end record, the central directory with its ZIP64 extra fields, and
the local headers, and so learns where a stored member lies in the file.  Index lines then give byte ranges that are
read and parsed record by record; nothing is extracted.

Behaviour on unusual input: a null payload is an empty one; payloads of at least ``least_bytes`` that are equal are
written once, by the row with the smallest id (rows that repeat that id are responses too), and the others refer to it, those
with a null id included; where all ids are null, and for smaller payloads, all are responses; rows that repeat an id with other
payloads are records of their own; a null id goes into the archive as an empty one and comes back null; a null url is
empty; an empty table gives no archive and no rows.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routeloom.llm._common import keep, shared_dir, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORD = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"

# ZIP structures: signatures and fixed layouts of the format (fixed values).
LOCAL, CENTRAL, END, END64, LOCATOR64 = 0x04034B50, 0x02014B50, 0x06054B50, 0x06064B50, 0x07064B50
LOCAL_FMT, CENTRAL_FMT, END_FMT, END64_FMT, LOCATOR64_FMT = "<IHHHHHIIIHH", "<IHHHHHHIIIHHHHHII", "<IHHHHIIH", "<IQHHIIQQQQ", "<IIQI"
FULL16, FULL32, EXTRA64 = 0xFFFF, 0xFFFFFFFF, 1


def open_fs(uri: str):
    """The pyarrow file system of a URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


class ZipWriter:
    """Writes stored members one after another to a stream that cannot seek.  zip64: use ZIP64 records even where not needed."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.zip64, self.at, self.entries = out, zip64, 0, []

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: str, parts: list[bytes]) -> None:
        size, crc = sum(map(len, parts)), 0
        for part in parts:
            crc = zlib.crc32(part, crc)
        big = self.zip64 or size >= FULL32
        extra = struct.pack("<HHQQ", EXTRA64, 16, size, size) if big else b""
        known, label, start = FULL32 if big else size, name.encode(), self.at
        self._put(struct.pack(LOCAL_FMT, LOCAL, 45 if big else 20, 0x800, 0, 0, 0x21, crc, known, known, len(label), len(extra)) + label + extra)
        for part in parts:
            self._put(part)
        self.entries.append((label, crc, size, start))

    def close(self) -> None:
        start = self.at
        for label, crc, size, at in self.entries:
            far, big = self.zip64 or at >= FULL32, self.zip64 or size >= FULL32
            values = [size, size] * big + [at] * far
            extra = struct.pack(f"<HH{len(values)}Q", EXTRA64, 8 * len(values), *values) if values else b""
            known = FULL32 if big else size
            self._put(struct.pack(CENTRAL_FMT, CENTRAL, 45, 45, 0x800, 0, 0, 0x21, crc, known, known, len(label), len(extra), 0, 0, 0, 0, FULL32 if far else at) + label + extra)
        end, n = self.at, len(self.entries)
        big = self.zip64 or n >= FULL16 or end >= FULL32
        if big:
            self._put(struct.pack(END64_FMT, END64, 44, 45, 45, 0, 0, n, n, end - start, start) + struct.pack(LOCATOR64_FMT, LOCATOR64, 0, end, 1))
        self._put(struct.pack(END_FMT, END, 0, 0, FULL16 if big else n, FULL16 if big else n, FULL32 if big else end - start, FULL32 if big else start, 0))


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    size: int
    header_at: int


def read_at(file, start: int, length: int) -> bytes:
    file.seek(start)
    data = file.read(length)
    if len(data) != length:
        raise ValueError(f"archive ends early: {len(data)} of {length} bytes at {start}")
    return data


def zip_members(file, size: int) -> list[Member]:
    """The central directory of an open file, ZIP64 included; reads just the tail and the directory."""
    tail_at = max(0, size - 65_557)
    tail = read_at(file, tail_at, size - tail_at)
    found = tail.rfind(struct.pack("<I", END))
    while found >= 0:  # the signature may also stand in a comment
        if found + 22 <= len(tail) and found + 22 + struct.unpack_from("<H", tail, found + 20)[0] == len(tail):
            break
        found = tail.rfind(struct.pack("<I", END), 0, found)
    if found < 0:
        raise ValueError("no end of central directory: not a ZIP file")
    *_, n, length, start, _ = struct.unpack_from(END_FMT, tail, found)
    place = tail_at + found
    if FULL16 == n or FULL32 in (length, start):
        mark, _, end64, _ = struct.unpack(LOCATOR64_FMT, read_at(file, place - 20, 20))
        if mark == LOCATOR64:
            mark, *_, n, length, start = struct.unpack(END64_FMT, read_at(file, end64, 56))
            if mark != END64:
                raise ValueError("the ZIP64 locator leads nowhere")
    data, at, out = read_at(file, start, length), 0, []
    for _ in range(n):
        mark, _, _, _, method, _, _, _, packed, full, n_name, n_extra, n_comment, _, _, _, header = struct.unpack_from(CENTRAL_FMT, data, at)
        if mark != CENTRAL:
            raise ValueError("the central directory is damaged")
        at += 46
        name, extra = data[at : at + n_name], data[at + n_name : at + n_name + n_extra]
        at += n_name + n_extra + n_comment
        while len(extra) >= 4:
            kind, k = struct.unpack_from("<HH", extra)
            if kind == EXTRA64:
                values = iter(struct.unpack_from(f"<{k // 8}Q", extra, 4))
                full = next(values) if full == FULL32 else full
                packed = next(values) if packed == FULL32 else packed
                header = next(values) if header == FULL32 else header
            extra = extra[4 + k :]
        out.append(Member(name.decode(), method, packed, header))
    return out


def stored_range(file, member: Member) -> tuple[int, int]:
    """Where the bytes of a stored member lie: start, length."""
    if member.method:
        raise ValueError(f"{member.name} is compressed; only stored members can be read by range")
    header = struct.unpack(LOCAL_FMT, read_at(file, member.header_at, 30))
    if header[0] != LOCAL:
        raise ValueError(f"no local header for {member.name}")
    return member.header_at + 30 + header[-2] + header[-1], member.size


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(row_id, url: str | None, payload: bytes, refers_to, revisit: bool) -> bytes:
    """A response with its payload, or a revisit whose HTTP header still tells the payload's length."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:row:{'' if row_id is None else row_id}>",
        f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~' + chr(39))}",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:row:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "replace").split("\r\n")[1:])}


def parse_record(raw: bytes) -> tuple:
    """One WARC record as a row of RECORD."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    block = rest[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = fields["warc-type"] == "revisit"
    size = int(_fields(http).get("content-length", len(payload))) if revisit else len(payload)
    bare = lambda x: x.removeprefix("<urn:row:").removesuffix(">") or None
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if not revisit and digest != sha1_base32(payload):
        raise ValueError(f"payload of {fields['warc-record-id']} doesn't have its digest")
    return bare(fields["warc-record-id"]), fields["warc-type"], fields.get("warc-target-uri"), digest, size, bare(fields.get("warc-refers-to", "")), None if revisit else payload


def write_archives(rows: DataFrame, folder: str, records: int = 4096, most_bytes: int = 64 << 20, zip64: bool = False) -> DataFrame:
    """Write (id string, url, payload binary, refers_to string; null: a response) to archives in ``folder``; one row (path, records) for each.

    A task that runs again writes files with other names, and only those of the run that counts are returned.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        parts: list[bytes] = []
        lines: list[str] = []
        at = 0

        def flush() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.zip"
            with fs.open_output_stream(f"{base}/{name}") as out:
                archive = ZipWriter(out, zip64)
                archive.add(DATA, parts)
                archive.add(INDEX, ["".join(lines).encode()])
                archive.close()
            return pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "records": len(lines)}], pa.schema([("path", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for row_id, url, payload, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = gzip.compress(warc_record(row_id, url, payload or b"", refers_to, refers_to is not None), 5, mtime=0)
                lines.append(json.dumps({"id": row_id, "offset": at, "length": len(raw)}) + "\n")
                parts.append(raw)
                at += len(raw)
                if len(parts) >= records or at >= most_bytes:
                    yield flush()
                    parts, lines, at = [], [], 0
        if parts:
            yield flush()

    return rows.select("id", "url", "payload", "refers_to").mapInArrow(run, "path string, records long")


def archive_ranges(archives: DataFrame, most_bytes: int = 4 << 20) -> DataFrame:
    """(path, start, lengths) from the directories and indexes of the archives: adjoining records, up to ``most_bytes`` together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = open_fs(path)
                with fs.open_input_file(at) as file:
                    members = {m.name: m for m in zip_members(file, file.size())}
                    base, _ = stored_range(file, members[DATA])
                    index = [json.loads(x) for x in read_at(file, *stored_range(file, members[INDEX])).splitlines()]
                out: list[dict] = []
                for x in sorted(index, key=lambda x: x["offset"]):
                    last = out[-1] if out else None
                    if last and last["start"] + sum(last["lengths"]) == base + x["offset"] and sum(last["lengths"]) + x["length"] <= most_bytes and len(last["lengths"]) < 1024:
                        last["lengths"].append(x["length"])
                    else:
                        out.append({"path": path, "start": base + x["offset"], "lengths": [x["length"]]})
                yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("start", pa.int64()), ("lengths", pa.list_(pa.int64()))]))

    return archives.select("path").mapInArrow(run, "path string, start long, lengths array<long>")


def read_ranges(ranges: DataFrame, payloads: bool = True) -> DataFrame:
    """The records in the ranges, as rows of RECORD."""
    names = [x.split(" ")[0] for x in RECORD.split(", ")]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, lengths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as file:
                    data = memoryview(read_at(file, start, sum(lengths)))
                rows, k = [], 0
                for n in lengths:
                    row = parse_record(gzip.decompress(data[k : k + n]))
                    rows.append(row if payloads else (*row[:-1], None))
                    k += n
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return ranges.select("path", "start", "lengths").mapInArrow(run, RECORD)


def revisits(rows: DataFrame, id_col: str, payload: str, least_bytes: int = 0) -> DataFrame:
    """(id, digest, refers_to) of the rows whose payload a row with a smaller id has; only ids and digests are shuffled.

    A null id comes after all others.  Rows that share the smallest id of a payload, and null ids alone, revisit nothing.
    """
    data = F.coalesce(F.col(payload), F.lit(""))
    digests = rows.where(F.octet_length(data) >= least_bytes).select(F.col(id_col).alias("id"), payload_digest(payload))
    first = digests.groupBy("digest").agg(F.min("id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    return digests.join(first, "digest").where("not (id <=> refers_to)").select("id", "digest", "refers_to").distinct()


def payload_digest(payload: str) -> Column:
    return F.unhex(F.sha1(F.coalesce(F.col(payload), F.lit("")))).alias("digest")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    later = revisits(pages, "page_id", "html").select("id", F.col("digest").alias("of"), F.col("refers_to").cast("string"))
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"), payload_digest("html"))
    # By id and payload: rows that repeat an id may have different ones.
    rows = rows.join(later, F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left").drop("id")
    archives = keep(spark, write_archives(rows.select(F.col("page_id").cast("string").alias("id"), "url", "payload", "refers_to"), shared_dir(spark)))
    records = read_ranges(archive_ranges(archives.repartition(spark.sparkContext.defaultParallelism)), payloads=False)
    return records.select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("long").alias("refers_to"),
    )
