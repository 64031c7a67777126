"""File listings as frames. File contents are never read here."""

from __future__ import annotations

import fnmatch
import functools
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import storage
from sluice.functions import paths
from sluice.session import local_rows, pin


def list_files(spark: SparkSession, path: str, pattern: str | None = None, times: bool = False) -> DataFrame:
    """``path, relative, length`` of the data files below a folder (or of one file).

    With ``times`` also ``modified``. As for any scan, empty files and names that start with
    ``_`` or ``.`` do not count. Only these columns of the scan are read. Spark packs listing tasks by file size
    although no bytes are read, so tasks are merged to a few per core.
    """
    base = storage.qualify(spark, path)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    stamp = [F.col("modificationTime").alias("modified")] if times else []
    listing = reader.load(path).select("path", "length", *stamp)
    return listing.select(
        "path",
        F.when(F.col("path") == base, F.regexp_extract("path", "[^/]*$", 0))
        .otherwise(paths.path_below(F.col("path"), base))
        .alias("relative"),
        "length",
        *(["modified"] if times else []),
    ).coalesce(4 * spark.sparkContext.defaultParallelism)


def list_folders(spark: SparkSession, folders: list[str]) -> DataFrame:
    """``path, length, modified`` of the data files below some folders that exist."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    listing = reader.load(folders).select("path", "length", F.col("modificationTime").alias("modified"))
    return listing.coalesce(4 * spark.sparkContext.defaultParallelism)


def uri_opener() -> Callable:
    """A function from URI to Arrow file system and path, for use on executors.

    Nested functions travel with the task, so executors need no copy of this package.
    """

    def open_uri(uri: str):
        from pyarrow import fs

        if uri.startswith("file:"):
            return fs.LocalFileSystem(), "/" + uri[len("file:") :].lstrip("/")
        scheme, _, rest = uri.partition("://")
        return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")

    return open_uri


_WALK_SCHEMA = "path string, relative string, folder boolean, length long"


def _lister(pattern: str | None, budget: int = 10_000, batch: int = 10_000, missing_ok: bool = False) -> Callable:
    """Lists folders, and folders below them until ``budget`` names are found.

    What is left then is handed back as folders, to be spread over tasks.
    """
    open_uri = uri_opener()

    def list_below(path: str, relative: str) -> Iterator[tuple]:
        from pyarrow import fs

        system, place = open_uri(path)
        info = system.get_file_info(place)
        if info.type == fs.FileType.NotFound:
            if missing_ok:
                return
            raise FileNotFoundError(path)
        if info.is_file:
            yield path, relative or info.base_name, False, info.size
            return
        waiting, seen = [(path, place, relative)], 0
        while waiting and seen < budget:
            at, inner, below = waiting.pop()
            for item in system.get_file_info(fs.FileSelector(inner)):
                seen += 1
                name = item.base_name
                here = (f"{at}/{name}", f"{below}/{name}".lstrip("/"))
                # Checksum side files belong to the local file system, not to the data.
                checksum = name.startswith(".") and name.endswith(".crc")
                if item.type == fs.FileType.Directory:
                    waiting.append((here[0], f"{inner}/{name}", here[1]))
                elif not checksum and (pattern is None or fnmatch.fnmatchcase(name, pattern)):
                    yield *here, False, item.size or 0
        for at, _, below in waiting:
            yield at, below, True, 0

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["path", "relative", "folder", "length"]
        rows: list[tuple] = []
        for frame in frames:
            for path, relative in zip(frame["path"], frame["relative"]):
                for row in list_below(path, relative):
                    rows.append(row)
                    if len(rows) >= batch:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return batches


def walk_files(spark: SparkSession, base: str, pattern: str | None = None) -> DataFrame:
    """``path, relative, length`` of every file below a base, empty and hidden ones too."""
    start = local_rows(spark, [(storage.qualify(spark, base), "")], "path string, relative string")
    return walk_folders(start, pattern)


def walk_folders(
    level: DataFrame, pattern: str | None = None, budget: int = 10_000, missing_ok: bool = False
) -> DataFrame:
    """The same below many folders, each given as ``path`` and its ``relative`` place.

    A folder that is not there is an error, or empty with ``missing_ok``.

    Executors list, so the driver never holds the names. A small tree takes one job; of
    a large one each task hands back the folders it did not get to, for the next job.
    """
    spark = level.sparkSession
    nothing = spark.createDataFrame([], "path string, relative string, length long")
    found, folders = [nothing], level.count()
    while folders:
        tasks = min(folders, 4 * spark.sparkContext.defaultParallelism)
        lister = _lister(pattern, budget, missing_ok=missing_ok)
        listed = pin(level.repartition(tasks, "path").mapInPandas(lister, _WALK_SCHEMA), "walk")
        found.append(listed.where(~F.col("folder")).select("path", "relative", "length"))
        level = listed.where("folder").select("path", "relative")
        folders = level.count()
    return functools.reduce(DataFrame.unionByName, found)


def partition_folders(listing: DataFrame) -> DataFrame:
    """``name, location, files, bytes`` per folder of a listing; the root's name is ``''``."""
    return (
        listing.select(
            F.when(F.contains("relative", F.lit("/")), paths.parent(F.col("relative")))
            .otherwise(F.lit(""))
            .alias("name"),
            paths.parent(F.col("path")).alias("location"),
            "length",
        )
        .groupBy("name", "location")
        .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    )


def first_level_folders(listing: DataFrame, base: str, excluded: tuple[str, ...] = ("copy-log",)) -> DataFrame:
    """Distinct first path elements below a base, without the log folder."""
    return (
        listing.select(paths.first_level_dir(F.col("path"), base).alias("folder"))
        .where(~F.col("folder").isin([f"{base}/{name}" for name in excluded]))
        .distinct()
    )


def names_with_prefix(folders: DataFrame, prefix: str, column: str = "folder") -> DataFrame:
    return folders.where(F.startswith(F.col(column), F.lit(prefix)))
