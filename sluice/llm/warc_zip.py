"""Web archives packaged in ZIP files, written by tasks and read by ranges.

A package holds ``archive/data.warc.gz``, a WARC file of one gzip member per record, and
``indexes/index.cdxj`` with a line per record that gives its place. Both are stored, not
compressed again, so a reader needs three ranges to get to any record: the end of the file,
the central directory there, and the record. Directories are parsed here, ZIP64 included.

Equal payloads (by SHA-1 and length) are stored once: the page with the least id has a
``response`` record, the others a ``revisit`` that names it. The least id is found by a
combining aggregation, so a payload of a third of all pages is no single task's work.

A package appears under its name only when complete and is named by its task attempt; the
manifest, a table written by Spark, names one per task.

Null html is an empty payload. A null page id is written as such; among equal payloads it is a
``response`` only if no page of them has an id. Rows that repeat the least id are all ``response``.
Null urls are empty. An empty table gives no package. Other columns are not read.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import storage
from sluice.session import new_scratch, pin
from sluice.sources import files

ARCHIVE, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_DATE = "2024-01-01T00:00:00Z"
_CHUNK = 4 << 20
#: Ranges that a task reads where there are more of them than cores.
_RANGES = 16

#: Fixed values of the ZIP format: signatures and the shapes of its records.
_END, _END64, _LOCATOR64, _ENTRY, _LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"
_END_SHAPE = struct.Struct("<4s4H2LH")
_END64_SHAPE = struct.Struct("<4sQ2H2L4Q")
_LOCATOR64_SHAPE = struct.Struct("<4sLQL")
_ENTRY_SHAPE = struct.Struct("<4s6H3L5H2L")
_LOCAL_SHAPE = struct.Struct("<4s5H3L2H")


@dataclass(frozen=True)
class Member:
    name: str
    method: int
    start: int
    size: int


class ZipPackage:
    """The directory of a ZIP file through ``read_at(size, offset)``."""

    def __init__(self, read_at: Callable[[int, int], bytes], size: int):
        self.read_at = read_at
        tail_at = max(0, size - 65557 - _LOCATOR64_SHAPE.size)
        tail = read_at(size - tail_at, tail_at)
        at = tail.rfind(_END, 0, max(0, len(tail) - _END_SHAPE.size) + len(_END))
        while at >= 0 and at + _END_SHAPE.size + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(_END, 0, at + len(_END) - 1)
        if at < 0:
            raise ValueError("no end of central directory")
        *_, count, length, offset, _ = _END_SHAPE.unpack_from(tail, at)
        near = at - _LOCATOR64_SHAPE.size
        if near >= 0 and tail[near : near + 4] == _LOCATOR64:
            end64_at = _LOCATOR64_SHAPE.unpack_from(tail, near)[2]
            end64 = _END64_SHAPE.unpack(read_at(_END64_SHAPE.size, end64_at))
            if end64[0] != _END64:
                raise ValueError("no ZIP64 end of central directory")
            count, length, offset = end64[7:10]
        self.members = self._entries(read_at(length, offset), count)

    def _entries(self, data: bytes, count: int) -> dict[str, tuple[int, int, int]]:
        found, at = {}, 0
        for _ in range(count):
            entry = _ENTRY_SHAPE.unpack_from(data, at)
            if entry[0] != _ENTRY:
                raise ValueError("broken central directory")
            method, packed, unpacked = entry[4], entry[8], entry[9]
            name_size, extra_size, note_size, offset = entry[10], entry[11], entry[12], entry[16]
            at += _ENTRY_SHAPE.size
            name = data[at : at + name_size].decode("utf-8")
            extra = data[at + name_size : at + name_size + extra_size]
            while len(extra) >= 4:
                kind, wide = struct.unpack_from("<HH", extra)
                if kind == 1:  # ZIP64: the fields that did not fit, in this order
                    rest = iter(struct.unpack_from(f"<{wide // 8}Q", extra, 4))
                    unpacked = next(rest) if unpacked == 0xFFFFFFFF else unpacked
                    packed = next(rest) if packed == 0xFFFFFFFF else packed
                    offset = next(rest) if offset == 0xFFFFFFFF else offset
                extra = extra[4 + wide :]
            found[name] = (method, packed, offset)
            at += name_size + extra_size + note_size
        return found

    def member(self, name: str) -> Member:
        """Where a member's bytes lie; it must be stored as it is."""
        method, size, offset = self.members[name]
        if method != 0:
            raise ValueError(f"{name} is compressed, so it has no ranges to read")
        local = _LOCAL_SHAPE.unpack(self.read_at(_LOCAL_SHAPE.size, offset))
        if local[0] != _LOCAL:
            raise ValueError(f"{name} is not where the directory says")
        return Member(name, method, offset + _LOCAL_SHAPE.size + local[9] + local[10], size)

    def read(self, member: Member, size: int | None = None, offset: int = 0) -> bytes:
        size = member.size - offset if size is None else size
        if offset < 0 or offset + size > member.size:
            raise ValueError(f"range outside {member.name}")
        return self.read_at(size, member.start + offset)


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _record_id(page: int | None) -> str:
    return f"<urn:x-page:{'none' if page is None else page}>"


def _page_of(record_id: str | None) -> int | None:
    found = re.fullmatch(r"<urn:x-page:(-?\d+)>", record_id or "")
    return int(found[1]) if found else None


def warc_record(page: int | None, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record as a gzip member."""
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _record_id(page)),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", quote(url, safe="".join(map(chr, range(33, 127))))),
        ("WARC-Payload-Digest", "sha1:" + payload_digest(payload)),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        head += [
            ("WARC-Refers-To", _record_id(refers_to)),
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    block = _HTTP if revisit else _HTTP + payload
    head.append(("Content-Length", str(len(block))))
    lines = "".join(f"{k}: {v}\r\n" for k, v in head)
    return gzip.compress(f"WARC/1.1\r\n{lines}\r\n".encode() + block + b"\r\n\r\n", compresslevel=1, mtime=0)


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    payload: bytes


def parse_record(packed: bytes) -> Record:
    unpacker = zlib.decompressobj(wbits=31)
    data = unpacker.decompress(packed) + unpacker.flush()
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/") or not unpacker.eof:
        raise ValueError("no whole WARC record")
    headers = {k.strip().lower(): v.strip() for k, v in (line.split(":", 1) for line in lines)}
    block = rest[: int(headers["content-length"])]
    return Record(headers, block.partition(b"\r\n\r\n")[2])


def mark_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``page_id, url, payload, refers_to, revisit``; equal payloads refer to the least id."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"),
        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"),
    )
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    least = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.min("page_id").alias("least"))
    least = pin(least, "first-pages")
    joined = rows.join(least, ["digest", "size"], "left")
    revisit = F.coalesce(~F.col("page_id").eqNullSafe(F.col("least")) & F.col("least").isNotNull(), F.lit(False))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("least")).alias("refers_to"), revisit.alias("revisit"))


def write_packages(marked: DataFrame, folder: str) -> DataFrame:
    """One package per task below ``folder``; returns their manifest ``path, records``."""
    open_uri = files.uri_opener()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zipfile

        package = stream = member = None
        index, at = [], 0
        target = f"{folder}/pages-{uuid.uuid4().hex}.wacz"
        fs, path = open_uri(target)
        try:
            for batch in batches:
                for low in range(0, batch.num_rows, 64):
                    for row in batch.slice(low, 64).to_pylist():
                        if package is None:
                            fs.create_dir(path.rpartition("/")[0], recursive=True)
                            stream = fs.open_output_stream(path + ".part")
                            package = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED, allowZip64=True)
                            member = package.open(ARCHIVE, "w", force_zip64=True)
                        packed = warc_record(row["page_id"], row["url"], row["payload"], row["refers_to"], row["revisit"])
                        member.write(packed)
                        index.append(f'{quote(row["url"])} {json.dumps({"offset": at, "length": len(packed)})}\n')
                        at += len(packed)
            if package is None:
                return
            member.close()
            with package.open(INDEX, "w", force_zip64=True) as out:
                for line in index:
                    out.write(line.encode())
            package.close()
            stream.close()
            fs.move(path + ".part", path)
        except BaseException:
            if stream is not None:
                stream.close()
                fs.delete_file(path + ".part")
            raise
        yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([len(index)], pa.int64())], ["path", "records"])

    return pin(marked.mapInArrow(run, "path string, records long"), "package-manifest")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_packages(packages: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the packages ``path``; with ``payloads`` their payload as ``payload`` too.

    The indexes are read first and give ranges of a few megabytes, which are written down and
    dealt out to as many tasks as their number asks for, so one large package is read by many.
    """
    open_uri = files.uri_opener()

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, name = open_uri(path)
                with fs.open_input_file(name) as source:
                    package = ZipPackage(source.read_at, source.size())
                    archive = package.member(ARCHIVE)
                    lines = package.read(package.member(INDEX)).decode().splitlines()
                found, sizes, begin = [], [], 0
                for line in lines:
                    place = json.loads(line.partition(" ")[2])
                    sizes.append(place["length"])
                    if sum_over(sizes, _CHUNK):
                        found.append((begin, sizes))
                        begin, sizes = place["offset"] + place["length"], []
                if sizes:
                    found.append((begin, sizes))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * len(found), pa.string()),
                        pa.array([archive.start + b for b, _ in found], pa.int64()),
                        pa.array([s for _, s in found], pa.list_(pa.int64())),
                    ],
                    ["path", "begin", "sizes"],
                )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, begin, sizes in zip(*(batch.column(i).to_pylist() for i in range(3))):
                fs, name = open_uri(path)
                with fs.open_input_file(name) as source:
                    data = source.read_at(sum(sizes), begin)
                rows, at = [], 0
                for size in sizes:
                    rows.append(_row(parse_record(data[at : at + size])))
                    at += size
                columns = list(zip(*rows))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
                wide = len(names) if payloads else len(names) - 1
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns[:wide], kinds)], names[:wide])

    found = pin(packages.select("path").mapInArrow(ranges, "path string, begin long, sizes array<long>"), "package-ranges")
    schema = RECORDS + (", payload binary" if payloads else "")
    # Rows of ranges are tiny, so their number must tell how many tasks read what they stand for.
    count, cores = found.count(), packages.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(count, max(cores, -(-count // _RANGES))))
    return found.repartition(tasks).mapInArrow(records, schema)


def sum_over(sizes: list[int], limit: int) -> bool:
    return len(sizes) >= 4096 or sum(sizes[-4096:]) >= limit


def _row(record: Record) -> tuple:
    head = record.headers
    kind, digest, size = head["warc-type"], head["warc-payload-digest"].removeprefix("sha1:"), int(head["warc-payload-length"])
    if kind == "response" and (payload_digest(record.payload), len(record.payload)) != (digest, size):
        raise ValueError(f"payload of {head['warc-record-id']} is damaged")
    page, refers = _page_of(head["warc-record-id"]), _page_of(head.get("warc-refers-to"))
    return page, head["warc-target-uri"], size, digest, kind, refers, record.payload if kind == "response" else None


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write all pages into packages (fresh below the shared folder if none is named), then read them back."""
    folder = storage.qualify(spark, folder or new_scratch(spark, "packages"))
    return read_packages(write_packages(mark_revisits(pages), folder))
