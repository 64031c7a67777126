import base64
import hashlib
import io
import random
import struct
import zipfile

import pytest

from sluice import storage
from sluice.llm import warc_zip
from sluice.session import new_scratch

SCHEMA = "page_id long, url string, html string"


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS payload", "'x' AS digest")


def expected(rows):
    first = {}
    for page, _, text in rows:
        if page is not None:
            first[text or ""] = min(first.get(text or "", page), page)
    out = []
    for page, _, text in rows:
        data = (text or "").encode()
        head = first.get(text or "")
        revisit = head is not None and page != head
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((page, len(data), digest, "revisit" if revisit else "response", head if revisit else None))
    return sorted(out, key=repr)


ROWS = [
    (5, "http://a/", "<p>é</p>"), (3, "http://b/ x\r\nEvil: 1", "<p>é</p>"), (9, None, "<p>é</p>"), (4, "u", None), (8, "u", ""),
    (None, "u", "only"), (None, "u", "<p>é</p>"), (20, "u", "x" * 300_000), (21, "u", "WARC/1.0\r\n\r\nnot a record"), (3, "again", "<p>é</p>"),
]


def test_pages_come_back(spark):
    draw = random.Random(2)
    rows = ROWS + [(100 + n, f"http://h/{n}", "page %d" % draw.randrange(40)) for n in range(300)]
    frame = warc_zip.archive_pages(spark, table(spark, rows))
    got = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in frame.collect()]
    assert sorted(got, key=repr) == expected(rows)
    assert warc_zip.archive_pages(spark, table(spark, rows).limit(0)).count() == 0


def test_packages_are_read_by_many_tasks(spark):
    """Their ranges are few small rows, which must not end up in one task."""
    folder = storage.qualify(spark, new_scratch(spark, "packages"))
    marked = warc_zip.mark_revisits(table(spark, [(n, "u", f"page {n}") for n in range(64)]))
    manifest = warc_zip.write_packages(marked.repartition(8, "page_id"), folder)
    count = manifest.where("records > 0").count()
    assert count >= 6
    found = warc_zip.read_packages(manifest)
    assert found.rdd.getNumPartitions() == min(count, spark.sparkContext.defaultParallelism)
    assert found.count() == 64


def test_payloads_and_urls(spark):
    folder = storage.qualify(spark, new_scratch(spark, "packages"))
    manifest = warc_zip.write_packages(warc_zip.mark_revisits(table(spark, ROWS)), folder)
    rows = warc_zip.read_packages(manifest, payloads=True).collect()
    by_page = {(r["page_id"], r["record_type"], r["url"]): r for r in rows}
    assert by_page[(20, "response", "u")]["payload"] == b"x" * 300_000
    assert by_page[(21, "response", "u")]["payload"] == b"WARC/1.0\r\n\r\nnot a record"
    assert (3, "response", "http://b/%20x%0D%0AEvil:%201") in by_page


def package(names, **options):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for name, data in names.items():
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=options.get("wide", False)) as member:
                member.write(data)
        z.comment = options.get("note", b"")
    return out.getvalue()


def opened(data, asked=None):
    def read_at(size, offset):
        if asked is not None:
            asked.append(size)
        return data[offset : offset + size]

    return warc_zip.ZipPackage(read_at, len(data))


@pytest.mark.parametrize("wide", [False, True])
def test_members_are_found(wide):
    data = package({"a/b": b"123456789", "empty": b"", "ü": b"PK\x05\x06"}, wide=wide, note=b"PK\x05\x06 in a note")
    found = opened(data)
    assert found.read(found.member("a/b"), 3, 2) == b"345"
    assert found.read(found.member("empty")) == b"" and found.read(found.member("ü")) == b"PK\x05\x06"
    with pytest.raises(ValueError):
        found.read(found.member("empty"), 1)


def zip64(data):
    """The same package with a ZIP64 directory, as writers of packages over 4 GB make it."""
    end = data.rfind(b"PK\x05\x06")
    count, _, size, offset = struct.unpack_from("<2H2L", data, end + 8)
    directory, at = b"", offset
    for _ in range(count):
        entry = bytearray(data[at : at + 46])
        name_size, extra_size, note_size = struct.unpack_from("<3H", entry, 28)
        packed, unpacked, = struct.unpack_from("<2L", entry, 20)
        local = struct.unpack_from("<L", entry, 42)[0]
        struct.pack_into("<2L", entry, 20, 0xFFFFFFFF, 0xFFFFFFFF)
        struct.pack_into("<L", entry, 42, 0xFFFFFFFF)
        struct.pack_into("<H", entry, 30, 4 + 32)
        extra = struct.pack("<HHL", 0x9999, 4, 7) + struct.pack("<HH3Q", 1, 24, unpacked, packed, local)
        directory += bytes(entry) + data[at + 46 : at + 46 + name_size] + extra
        at += 46 + name_size + extra_size + note_size
    end64_at = offset + len(directory)
    end64 = struct.pack("<4sQ2H2L4Q", b"PK\x06\x06", 44, 45, 45, 0, 0, count, count, len(directory), offset)
    locator = struct.pack("<4sLQL", b"PK\x06\x07", 0, end64_at, 1)
    last = struct.pack("<4s4H2LH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    return data[:offset] + directory + end64 + locator + last


def test_zip64_directories():
    found = opened(zip64(package({"a": b"first", "b": b"second one"})))
    assert found.read(found.member("a")) == b"first" and found.read(found.member("b"), 3, 7) == b"one"


def test_only_ranges_are_read():
    asked = []
    found = opened(package({"big": b"x" * 5_000_000, "small": b"hello"}), asked)
    assert found.read(found.member("small")) == b"hello"
    assert sum(asked) < 100_000


def test_broken_packages_are_errors():
    good = package({"a": b"first"})
    for bad in (b"", b"no zip at all", good[:-10], good.replace(b"PK\x01\x02", b"PK\x01\x00")):
        with pytest.raises(Exception):
            opened(bad).member("a")
    squeezed = io.BytesIO()
    with zipfile.ZipFile(squeezed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "text " * 100)
    with pytest.raises(ValueError):
        opened(squeezed.getvalue()).member("a")
    record = warc_zip.warc_record(1, "u", b"payload", None, False)
    with pytest.raises(Exception):
        warc_zip.parse_record(record[:-9])
