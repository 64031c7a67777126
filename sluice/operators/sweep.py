"""Finding and removing what killed runs left behind.

A run cleans up after itself unless its process dies. Then there may be staging folders of
half-written copies, old copies and partitions that were moved aside, unpublished files of byte
copies, and scratch folders. They are known by their names, found by the distributed walk, and
left alone while any of their files is younger than a given age, as a run may still write there,
and where the catalog refers to something inside them. A folder without any file is not seen.

What was moved aside is put back if nothing has taken its place, so a run that died between the two
moves loses no copy and no partition; the next run makes the change again.
"""

from __future__ import annotations

import functools
import itertools
import time
from collections.abc import Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import storage
from sluice.operators.copy import ASIDE, STAGING_HINT, SWAPPED
from sluice.session import handed_out, local_rows, pin
from sluice.sources import files
from sluice.sources.tables import catalog_pages, open_catalog

DAY_SECONDS = 24 * 3600

_STAGED = f"^(.*?{STAGING_HINT}(?:{ASIDE}|{SWAPPED})?[0-9a-f]{{12}})/"
_PART = r"^((?:.*/)?\.[^/]+\.[0-9a-f]{32})$"
_SCRATCH = "^(sluice-[^/]*-[0-9a-f]{32})/"

_BATCH = 200
_THREADS = 16


def catalog_places(spark: SparkSession, databases: Sequence[str] | None = None) -> DataFrame:
    """``place``: folders of registered tables, and of their partitions, read in pages."""
    found = [local_rows(spark, [], "place string")]
    names = databases if databases is not None else [d.name for d in spark.catalog.listDatabases()]
    for database in names:
        for entry in spark.catalog.listTables(database):
            if entry.isTemporary or entry.tableType == "VIEW":
                continue
            name = f"{database}.{entry.name}"
            table = open_catalog(spark, name)
            if table.location:
                found.append(local_rows(spark, [(storage.qualify(spark, table.location),)], "place string"))
            if table.partition_columns:
                for page in catalog_pages(spark, name):
                    rows = [(location,) for _, location in page]
                    found.append(pin(local_rows(spark, rows, "place string"), "places"))
    return functools.reduce(DataFrame.unionByName, found)


def _with_times(suspects: DataFrame) -> DataFrame:
    """``modified`` (seconds) of each file, looked up where the rows are; files that are gone go."""
    open_uri = files.uri_opener()

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            times = []
            for path in frame["path"]:
                system, place = open_uri(path)
                times.append(system.get_file_info(place).mtime_ns)
            known = [t is not None for t in times]
            found = frame[known].copy()
            found["modified"] = [t / 1e9 for t in times if t is not None]
            yield found

    schema = "root string, kind string, place string, path string, length long, modified double"
    return suspects.mapInPandas(look, schema)


def _kind(relative: Column, scratch: bool) -> tuple[Column, Column]:
    """What a file is a leftover of, and the outermost folder (or the file) that goes."""
    staged, part = F.regexp_extract(relative, _STAGED, 1), F.regexp_extract(relative, _PART, 1)
    folder = F.regexp_extract("relative", _SCRATCH, 1) if scratch else F.lit("")
    place = F.when(folder != "", folder).when(staged != "", staged).when(part != "", part)
    kind = (
        F.when(folder != "", "scratch")
        .when(F.rlike(staged, F.lit(f"{STAGING_HINT}{ASIDE}[0-9a-f]*$")), "aside")
        .when(F.rlike(staged, F.lit(f"{STAGING_HINT}{SWAPPED}[0-9a-f]*$")), "swapped")
        .when(staged != "", "staging")
        .when(part != "", "part")
    )
    return kind, place


def leftovers(
    spark: SparkSession,
    roots: Sequence[str],
    older_than: float = DAY_SECONDS,
    databases: Sequence[str] | None = None,
    scratch: bool = False,
) -> DataFrame:
    """``kind, path, files, bytes, age`` of what may go below some folders (pinned).

    ``older_than`` is the age in seconds of the youngest file inside. ``scratch`` takes scratch
    folders of other processes too; those of this process never count.
    """
    now = time.time()
    listed = [local_rows(spark, [], "root string, path string, relative string, length long")]
    for root in roots:
        if storage.exists(spark, root):
            base = storage.qualify(spark, root)
            listed.append(files.walk_files(spark, base).select(F.lit(base).alias("root"), "path", "relative", "length"))
    kind, place = _kind(F.col("relative"), scratch)
    suspects = functools.reduce(DataFrame.unionByName, listed).withColumns({"kind": kind, "place": place})
    suspects = suspects.where("kind IS NOT NULL").select("root", "kind", "place", "path", "length")
    own = local_rows(spark, [(f.rpartition("/")[2],) for f in handed_out()], "place string")
    mine = F.col("kind") == "scratch"
    suspects = suspects.where(~mine).unionByName(suspects.where(mine).join(own, "place", "left_anti"))
    whole = (
        _with_times(suspects)
        .groupBy("kind", F.concat_ws("/", "root", "place").alias("path"))
        .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"), (F.lit(now) - F.max("modified")).alias("age"))
        .where(F.col("age") >= older_than)
    )
    # A place refers to itself and to all folders above it.
    steps = F.split("place", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/"))
    referred = catalog_places(spark, databases).select(F.explode(above).alias("path")).distinct()
    return pin(whole.join(referred, "path", "left_anti").select("kind", "path", "files", "bytes", "age"), "leftovers")


def _put_back(spark: SparkSession, kind: str, path: str) -> int:
    """Moves what has no successor to its old place; returns how many folders."""
    target = path[: path.rindex(STAGING_HINT)]
    if kind == "aside":
        if storage.exists(spark, target):
            return 0
        storage.rename(spark, path, target)
        return 1
    if kind != "swapped" or not storage.exists(spark, target):
        return 0
    names = files.partition_folders(files.walk_files(spark, path)).where("name != ''").select("name")

    def restore(name: str) -> int:
        if storage.exists(spark, f"{target}/{name}"):
            return 0
        storage.rename(spark, f"{path}/{name}", f"{target}/{name}")
        return 1

    rows, count = (row["name"] for row in names.toLocalIterator()), 0
    with ThreadPoolExecutor(_THREADS) as pool:
        while batch := list(itertools.islice(rows, _BATCH)):
            count += sum(pool.map(restore, batch))
    return count


def sweep(spark: SparkSession, found: DataFrame) -> dict[str, int]:
    """Put back or delete ``leftovers``, those moved aside first; counts of what was done.

    Paths come to the driver in batches, as moves and deletions are metadata calls. A sweep
    that breaks off is simply made again.
    """
    done = {"restored": 0, "removed": 0}
    for moved in (True, False):
        chosen = found.where(F.col("kind").isin("aside", "swapped") == F.lit(moved)).select("kind", "path")
        rows = chosen.toLocalIterator()
        while batch := list(itertools.islice(rows, _BATCH)):
            if moved:
                done["restored"] += sum(_put_back(spark, row["kind"], row["path"]) for row in batch)
            done["removed"] += storage.remove_all(spark, [row["path"] for row in batch])
    return done
