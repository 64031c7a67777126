"""Moving files byte for byte: ranges of large files side by side, with checksums that combine.

A file longer than ``RANGE_BYTES`` is copied as ranges by as many tasks, if the target's files
can be written at an offset (local and mounted file systems); elsewhere a file is one task's
stream. Each range is read back and both sides are summed up as CRC-32. CRCs are linear, so the one
of a whole file is the exclusive or of its ranges' CRCs, each first carried over the bytes that
follow it: a combining aggregate, in any order. A file appears under its name only when its length and
both CRCs agree.

Functions that run in tasks are nested, so they travel with the task and executors need no copy of
this package.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import storage
from sluice.session import new_scratch, pin
from sluice.sources import files

RANGE_BYTES = 128 << 20
_CHUNK = 8 << 20

#: ``sent`` is the CRC-32 of what was read from the source, ``stored`` of what the target gives back.
REPORT = "source string, target string, expected long, copied long, sent long, stored long"
_RANGES = "source string, target string, part string, expected long, start long, size long"
_MOVED = "source string, target string, part string, expected long, copied long, sent long, stored long"


def _carrier() -> Callable[[int, int], int]:
    """``carry(crc, count)``: the CRC's share in that of a text with ``count`` more bytes behind.

    Multiplies by x to the power ``8 * count`` modulo the CRC's polynomial, bits reflected.
    """
    polynomial = 0xEDB88320  # fixed value of CRC-32

    def times(a: int, b: int) -> int:
        product, bit = 0, 1 << 31
        while bit:
            if a & bit:
                product ^= b
            b = (b >> 1) ^ (polynomial if b & 1 else 0)
            bit >>= 1
        return product

    def carry(crc: int, count: int) -> int:
        factor, power = 1 << 31, 1 << 23  # one, and x to the eighth
        while count:
            if count & 1:
                factor = times(factor, power)
            power = times(power, power)
            count >>= 1
        return times(factor, crc)

    return carry


def combined_crc(parts: list[tuple[int, int]]) -> int:
    """The CRC-32 of texts one after the other, from each one's CRC and length."""
    carry, total = _carrier(), 0
    for crc, size in parts:
        total = carry(total, size) ^ crc
    return total


def _reader(chunk: int) -> Callable:
    """``summed(system, path, start, size, put)``: CRC and count of a range, which goes to ``put`` too."""
    import zlib

    def summed(system, path: str, start: int, size: int, put: Callable | None = None) -> tuple[int, int]:
        crc = total = 0
        with system.open_input_file(path) as stream:
            stream.seek(start)
            while total < size and (data := stream.read(min(chunk, size - total))):
                crc = zlib.crc32(data, crc)
                total += len(data)
                if put is not None:
                    put(data)
        return crc, total

    return summed


def _mover(chunk: int = _CHUNK) -> Callable:
    """The executor side: copies ranges, reads them back, and puts files of one range in place."""
    open_uri, summed, carry = files.uri_opener(), _reader(chunk), _carrier()

    def move(source: str, target: str, part: str, expected: int, start: int, size: int) -> tuple[int, int, int]:
        import os

        source_fs, source_path = open_uri(source)
        target_fs, target_path = open_uri(target)
        folder, _, name = target_path.rpartition("/")
        whole = size == expected
        # A task's own name for a whole file, one name for the ranges of a file: a range that is
        # copied again writes the same bytes to the same place.
        at = f"{folder}/.{name}.{part}"
        target_fs.create_dir(folder, recursive=True)
        try:
            if whole:
                with target_fs.open_output_stream(at) as writer:
                    sent, copied = summed(source_fs, source_path, start, size, writer.write)
                # What has come on top since the file was listed shows as a wrong length.
                more = source_fs.get_file_info(source_path).size
                copied = more if more != size else copied
            else:
                handle = os.open(at, os.O_CREAT | os.O_WRONLY, 0o644)
                try:
                    os.lseek(handle, start, os.SEEK_SET)

                    def put(data):
                        left = memoryview(data)
                        while left:
                            left = left[os.write(handle, left) :]

                    sent, copied = summed(source_fs, source_path, start, size, put)
                finally:
                    os.close(handle)
            stored, _ = summed(target_fs, at, start, size)
            if whole and copied == size and sent == stored:
                if target_fs.type_name == "local":
                    # A checksum of a file that was here before would no longer hold.
                    stale = f"{folder}/.{name}.crc"
                    if target_fs.get_file_info(stale).is_file:
                        target_fs.delete_file(stale)
                target_fs.move(at, target_path)
            elif whole:
                target_fs.delete_file(at)
        except BaseException:
            if whole and target_fs.get_file_info(at).is_file:
                target_fs.delete_file(at)
            raise
        after = expected - start - size
        return copied, carry(sent, after), carry(stored, after)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        for frame in frames:
            rows = []
            for source, target, part, expected, start, size in frame.itertuples(index=False):
                moved = move(source, target, part or uuid.uuid4().hex, int(expected), int(start), int(size))
                rows.append((source, target, part, expected, *moved))
            names = ["source", "target", "part", "expected", "copied", "sent", "stored"]
            yield pd.DataFrame(rows, columns=names)

    return batches


def _publisher() -> Callable:
    """The executor side: files of many ranges get their name if they are whole, or go."""
    open_uri = files.uri_opener()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for target, part, good in zip(frame["target"], frame["part"], frame["good"]):
                system, path = open_uri(target)
                folder, _, name = path.rpartition("/")
                at, stale = f"{folder}/.{name}.{part}", f"{folder}/.{name}.crc"
                if not system.get_file_info(at).is_file:
                    continue  # an earlier attempt of this task did it
                if not good:
                    system.delete_file(at)
                    continue
                if system.get_file_info(stale).is_file:
                    system.delete_file(stale)
                system.move(at, path)
            yield frame[["target"]]

    return batches


def writes_at_offsets(uri: str) -> bool:
    return uri.startswith(("file:", "/"))


def copy_listed(
    spark: SparkSession,
    listing: DataFrame,
    target_base: str,
    overwrite: bool = True,
    bytes_per_task: int = 1 << 30,
    files_per_task: int = 1_000,
    range_bytes: int = RANGE_BYTES,
) -> DataFrame:
    """Copy listed files (``path, relative, length``) below a base.

    Bytes go from storage to storage on executors; only names, lengths and checksums travel
    through Spark. Tasks are many and small, so that a folder or a file with most of the bytes is
    shared by all executors and a lost one repeats little. Without ``overwrite`` files
    that exist stay as they are. Returns the report, one row per file, kept in the
    scratch folder so that reading it twice does not copy twice.
    """
    target = storage.qualify(spark, target_base)
    plan = listing.select(
        F.col("path").alias("source"),
        F.concat(F.lit(target + "/"), F.col("relative")).alias("target"),
        F.col("length").alias("expected"),
    )
    if not overwrite and storage.exists(spark, target_base):
        present = files.walk_files(spark, target_base).select(F.col("path").alias("target"))
        plan = plan.join(present, "target", "left_anti").select("source", "target", "expected")
    size = range_bytes if writes_at_offsets(target) else None
    ranges = pin(_ranges(plan, size, uuid.uuid4().hex), "file-ranges")
    total = ranges.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("size")).first()
    tasks = max(
        min(spark.sparkContext.defaultParallelism, total["n"]),
        total["size"] // bytes_per_task + 1,
        total["n"] // files_per_task + 1,
    )
    # Dealt out in turn: a hash of the name would put all ranges of a file into one task.
    moved = pin(ranges.repartition(tasks).mapInPandas(_mover(), _MOVED), "moved-ranges")
    report = pin(
        moved.groupBy("source", "target", "part", "expected").agg(
            F.sum("copied").alias("copied"), F.bit_xor("sent").alias("sent"), F.bit_xor("stored").alias("stored")
        ),
        "file-report",
    )
    parted = report.where("part IS NOT NULL").select("target", "part", (~_odd()).alias("good"))
    if parted.head() is not None:
        done = parted.repartition("target").mapInPandas(_publisher(), "target string")
        done.write.parquet(new_scratch(spark, "published"))
    return report.drop("part")


def _ranges(plan: DataFrame, size: int | None, part: str) -> DataFrame:
    """One row per range; a file of one range has no ``part`` name."""
    if size is None:
        return plan.select(
            "source", "target", F.lit(None).cast("string").alias("part"), "expected",
            F.lit(0).cast("long").alias("start"), F.col("expected").alias("size"),
        )
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("expected") - 1, F.lit(0).cast("long")), F.lit(size).cast("long"))
    cut = plan.select("*", F.explode(starts).alias("start"))
    return cut.select(
        "source",
        "target",
        F.when(F.col("expected") > size, F.lit(part)).alias("part"),
        "expected",
        "start",
        F.least(F.lit(size).cast("long"), F.col("expected") - F.col("start")).alias("size"),
    )


def _odd():
    return (F.col("copied") != F.col("expected")) | (F.col("sent") != F.col("stored"))


def incomplete(report: DataFrame) -> DataFrame:
    """Files whose copied size differs from the expected one, or whose bytes from those that were read."""
    return report.where(_odd())


def whole(report: DataFrame, name: str) -> DataFrame:
    """The report of a copy, or an error if a file did not arrive whole."""
    bad = incomplete(report).count()
    if bad:
        raise OSError(f"{bad} files of {name} are incomplete")
    return report


def file_checksums(spark: SparkSession, listing: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``path, relative, length, checksum`` of listed files, read in ranges by many tasks."""

    def summer() -> Callable:
        open_uri, summed, carry = files.uri_opener(), _reader(_CHUNK), _carrier()

        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for path, relative, length, start, size in frame.itertuples(index=False):
                    system, place = open_uri(path)
                    crc, count = summed(system, place, int(start), int(size))
                    if count != size:
                        raise OSError(f"{path} got shorter")
                    rows.append((path, relative, length, carry(crc, int(length - start - size))))
                yield pd.DataFrame(rows, columns=["path", "relative", "length", "checksum"])

        return batches

    plan = listing.select(F.col("path").alias("source"), F.col("relative").alias("target"), F.col("length").alias("expected"))
    ranges = pin(_ranges(plan, range_bytes, "").drop("part").toDF("path", "relative", "length", "start", "size"), "sum-ranges")
    tasks = max(1, min(4 * spark.sparkContext.defaultParallelism, ranges.count()))
    summed = ranges.repartition(tasks).mapInPandas(summer(), "path string, relative string, length long, checksum long")
    return pin(summed.groupBy("path", "relative", "length").agg(F.bit_xor("checksum").alias("checksum")), "checksums")


def differing_files(spark: SparkSession, source_base: str, target_base: str) -> DataFrame:
    """``relative`` of files that are not the same below two bases, or only below one of them."""
    here, there = (
        file_checksums(spark, files.walk_files(spark, base)).select("relative", "length", "checksum")
        for base in (source_base, target_base)
    )
    return here.exceptAll(there).union(there.exceptAll(here)).select("relative").distinct()
