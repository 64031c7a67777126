import os
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.operators import copy, transfer
from sluice.sources import files


@given(st.lists(st.binary(max_size=200), max_size=12))
@settings(max_examples=60, deadline=None)
def test_checksums_combine(parts):
    assert transfer.combined_crc([(zlib.crc32(p), len(p)) for p in parts]) == zlib.crc32(b"".join(parts))
    carry, total = transfer._carrier(), 0
    after = sum(map(len, parts))
    for part in parts:  # in any order, as the aggregate does
        after -= len(part)
        total ^= carry(zlib.crc32(part), after)
    assert total == zlib.crc32(b"".join(parts))


def test_long_gaps():
    zeros = 1 << 20
    assert transfer.combined_crc([(zlib.crc32(b"a"), 1), (zlib.crc32(bytes(zeros)), zeros)]) == zlib.crc32(b"a" + bytes(zeros))


def made(tmp_path):
    source, target = tmp_path / "src", tmp_path / "dst"
    (source / "d").mkdir(parents=True)
    draw = random.Random(1)
    for name, size in (("big", 1_000_003), ("exact", 4096 * 8), ("d/small", 17), ("d/empty", 0), ("d/one more", 4097)):
        (source / name).write_bytes(draw.randbytes(size))
    return source, target


def test_ranges_of_a_file_are_copied_by_many_tasks(spark, tmp_path):
    source, target = made(tmp_path)
    listing = files.walk_files(spark, f"file:{source}")
    report = transfer.copy_listed(spark, listing, f"file:{target}", range_bytes=4096)
    assert transfer.whole(report, "t").count() == 5
    for row in report.collect():
        data = open(row["target"].removeprefix("file:"), "rb").read()
        assert data == open(row["source"].removeprefix("file:"), "rb").read()
        assert row["copied"] == len(data) and row["sent"] == row["stored"] == zlib.crc32(data)
    assert not [p for p in target.rglob(".*") if not p.name.endswith(".crc")]
    again = transfer.copy_listed(spark, listing, f"file:{target}", overwrite=False, range_bytes=4096)
    assert again.count() == 0


def test_ranges_are_spread_evenly(spark, tmp_path, monkeypatch):
    """A file with all the bytes is work for all tasks."""
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "only").write_bytes(os.urandom(1 << 20))
    pinned = []
    monkeypatch.setattr(transfer, "pin", lambda df, label: pinned.append((label, df)) or copy.pin(df, label))
    transfer.copy_listed(spark, files.walk_files(spark, f"file:{tmp_path}/src"), f"file:{tmp_path}/dst", range_bytes=1 << 16)
    moved = dict(pinned)["moved-ranges"]
    from pyspark.sql import functions as F

    counts = [r["count"] for r in moved.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(counts) == 16 and len(counts) >= 8 and max(counts) <= 3


def test_a_flipped_byte_of_equal_length_is_found(spark, tmp_path):
    source, target = made(tmp_path)
    copy.copy_files(spark, f"file:{source}", f"file:{target}")
    assert transfer.differing_files(spark, f"file:{source}", f"file:{target}").isEmpty()
    for name in ("big", "d/small"):
        data = bytearray((target / name).read_bytes())
        data[len(data) // 2] ^= 1
        (target / name).write_bytes(data)
    (target / "extra").write_bytes(b"x")
    found = transfer.differing_files(spark, f"file:{source}", f"file:{target}")
    assert sorted(r["relative"] for r in found.collect()) == ["big", "d/small", "extra"]


@pytest.mark.parametrize("range_bytes", [4096, 1 << 30])
def test_a_target_that_gives_back_other_bytes_is_not_published(spark, tmp_path, monkeypatch, range_bytes):
    """The read-back is made to see a wrong byte: no file of a wrong sum gets its name."""
    source, target = made(tmp_path)
    reader = transfer._reader

    def spoiled(chunk):
        summed = reader(chunk)

        def other(system, path, start, size, put=None):
            crc, total = summed(system, path, start, size, put)
            return (crc ^ 1 if put is None and "/.big." in path and not start else crc), total

        return other

    monkeypatch.setattr(transfer, "_reader", spoiled)
    listing = files.walk_files(spark, f"file:{source}")
    report = transfer.copy_listed(spark, listing, f"file:{target}", range_bytes=range_bytes)
    assert [r["target"].rpartition("/")[2] for r in transfer.incomplete(report).collect()] == ["big"]
    with pytest.raises(OSError, match="1 files of t"):
        transfer.whole(report, "t")
    assert not (target / "big").exists() and (target / "exact").exists()
    assert not [p for p in target.rglob(".big*")]


def test_a_source_that_grew_is_incomplete(spark, tmp_path):
    source, target = made(tmp_path)
    listing = files.pin(files.walk_files(spark, f"file:{source}"), "listing")
    with open(source / "d" / "small", "ab") as stream:
        stream.write(b"more")
    report = transfer.copy_listed(spark, listing, f"file:{target}")
    assert transfer.incomplete(report).count() == 1 and not (target / "d" / "small").exists()
