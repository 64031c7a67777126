"""Writing copies: whole, sampled, incremental, staged, or byte for byte."""

from __future__ import annotations

import itertools
import time
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import storage as folders
from sluice.functions import paths
from sluice.operators import sample, select
from sluice.operators.transfer import copy_listed, incomplete, whole
from sluice.session import pin
from sluice.sources import files
from sluice.sources.formats import PARQUET, StorageFormat
from sluice.sources.tables import SourceTable, folder_partitions, open_folder

STAGING_HINT = "__staging_"
# Marks of staging folders that hold an old copy, or old partitions, moved aside.
ASIDE = "old-"
SWAPPED = "swap-"


# Tasks that share one partition's rows when AQE is off and cannot split by size.
_SPLITS = 16


def _clustered(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    if df.sparkSession.conf.get("spark.sql.adaptive.enabled") == "true":
        return df.hint("rebalance", *[F.col(f"`{c}`") for c in columns])
    data = [
        f.name
        for f in df.schema
        if f.name not in columns and not isinstance(f.dataType, (T.MapType, T.ArrayType, T.StructType))
    ]
    salt = F.pmod(F.xxhash64(*data), F.lit(_SPLITS)) if data else F.lit(0)
    return df.repartition(*[F.col(f"`{c}`") for c in columns], salt)


def write_partitioned(
    df: DataFrame,
    path: str,
    columns: Sequence[str],
    mode: str = "errorifexists",
    cluster: bool = True,
    storage: StorageFormat = PARQUET,
    options: dict[str, str] | None = None,
) -> None:
    """Write a ``col=value`` tree.

    ``cluster`` brings a partition's rows together with a rebalance, so that not every
    task writes a small file to every partition. AQE splits a hot partition into several
    tasks and merges small ones; without AQE a salt of the row splits it. A source that is already laid out this way needs no
    shuffle: each of its files belongs to one partition.
    """
    if cluster and columns:
        df = _clustered(df, columns)
    writer = df.write.format(storage.source).mode(mode).options(**storage.options, **(options or {}))
    if columns:
        writer = writer.partitionBy(*columns)
    writer.save(path)


def _result(spark, table: SourceTable, path: str, storage: StorageFormat) -> SourceTable:
    return open_folder(spark, table.name, path, table.frame.schema, table.partition_columns, storage)


def full_copy(
    spark: SparkSession,
    table: SourceTable,
    path: str,
    chosen: DataFrame | None = None,
    storage: StorageFormat | None = None,
) -> SourceTable:
    """All rows of the chosen partitions (pinned), or of the whole table."""
    rows = table.frame
    if chosen is not None and table.partition_columns:
        rows = select.rows_of(rows, chosen, table.partition_columns, table.layout)
    storage = storage or table.storage
    write_partitioned(rows, path, table.partition_columns, cluster=table.location is None, storage=storage)
    return _result(spark, table, path, storage)


def sample_copy(
    spark: SparkSession,
    table: SourceTable,
    path: str,
    p: float,
    keys: Sequence[str] = (),
    chosen: DataFrame | None = None,
    method: str = "md5",
    seed: int = 0,
    before_sample: Sequence[Callable[[DataFrame], DataFrame]] = (),
    storage: StorageFormat | None = None,
) -> SourceTable:
    """One Bernoulli sample over all chosen partitions, in the source's storage format.

    Only the sampled share is shuffled. A partition whose sample is empty does not exist
    in the copy.
    """
    storage = storage or table.storage
    rows = copied_rows(table, p, keys, method, chosen, before_sample, seed)
    write_partitioned(rows, path, table.partition_columns, storage=storage)
    return _result(spark, table, path, storage)


def copied_rows(
    table: SourceTable,
    p: float = 1.0,
    keys: Sequence[str] = (),
    method: str = "md5",
    chosen: DataFrame | None = None,
    before_sample: Sequence[Callable[[DataFrame], DataFrame]] = (),
    seed: int = 0,
) -> DataFrame:
    """The rows that a copy of the chosen partitions holds."""
    rows = table.frame
    if chosen is not None and table.partition_columns:
        rows = select.rows_of(rows, chosen, table.partition_columns, table.layout)
    if p < 1:
        rows = sample.bernoulli_sample(rows, p, keys, method or "md5", seed)
    for hook in before_sample:
        rows = hook(rows)
    return rows.select(*table.frame.columns)


def new_partitions(
    source_partitions: DataFrame, target_partitions: DataFrame, columns: Sequence[str]
) -> DataFrame:
    """Partitions that the target lacks, by their values; a null value equals a null value."""
    present = target_partitions.select(*[F.col(c).alias(f"__at_{c}") for c in columns])
    on = [source_partitions[c].eqNullSafe(present[f"__at_{c}"]) for c in columns]
    return source_partitions.join(present, on, "left_anti")


# Names of the partitions that a copy has taken in, also those without a sampled row. Scans
# skip names that start with an underscore.
RECORD = "_partitions"
_RECORDED = "name string, fingerprint string, taken long"


def record_partitions(spark: SparkSession, path: str, partitions: DataFrame) -> None:
    """Note partitions (``name``, and their ``fingerprint`` if known) as taken into the copy at ``path``."""
    known = F.col("fingerprint") if "fingerprint" in partitions.columns else F.lit(None)
    rows = partitions.select("name", known.cast("string").alias("fingerprint"), F.lit(time.time_ns()).alias("taken"))
    rows.write.parquet(f"{path}/{RECORD}/entry-{uuid.uuid4().hex}")


def recorded_partitions(spark: SparkSession, path: str) -> DataFrame:
    """``name, fingerprint`` of the partitions that the copy at ``path`` has taken in, as noted last."""
    if not folders.exists(spark, f"{path}/{RECORD}"):
        return spark.createDataFrame([], "name string, fingerprint string")
    entries = [f"{path}/{RECORD}/{name}" for name in folders.child_names(spark, f"{path}/{RECORD}")]
    noted = spark.read.schema(_RECORDED).parquet(*entries)
    last = F.max(F.struct(F.coalesce("taken", F.lit(0).cast("long")).alias("taken"), "fingerprint")).alias("last")
    return noted.groupBy("name").agg(last).select("name", "last.fingerprint")


def incremental_copy(
    spark: SparkSession,
    table: SourceTable,
    path: str,
    source_partitions: DataFrame,
    p: float = 1.0,
    keys: Sequence[str] = (),
    method: str = "md5",
    before_sample: Sequence[Callable[[DataFrame], DataFrame]] = (),
) -> DataFrame:
    """Copy the partitions (with ``name``) that the target has not taken in yet; returns them (pinned).

    A partition counts as taken in when it is recorded, so one whose sample is empty is not
    scanned again, or when its folder is there. Existing partitions are not touched. New ones are written with dynamic partition
    overwrite, which moves each one into place whole. Object stores cannot move folders
    and their committers refuse that mode; there the new partitions are appended, and
    appear when the store's committer commits the job.
    """
    columns = list(table.partition_columns)
    target = SourceTable(table.name, table.frame, table.partition_columns, location=path)
    missing = source_partitions
    if folders.exists(spark, path):
        missing = missing.join(recorded_partitions(spark, path).select("name"), "name", "left_anti")
        missing = new_partitions(missing, folder_partitions(spark, target), columns)
    missing = pin(missing.select(*source_partitions.columns), "missing")
    if missing.isEmpty():
        return missing
    rows = copied_rows(table, p, keys, method, missing, before_sample)
    moves = folders.renames_in_place(spark, path)
    write_partitioned(
        rows,
        path,
        columns,
        mode="overwrite" if moves else "append",
        cluster=table.location is None or p < 1,
        storage=table.storage,
        options={"partitionOverwriteMode": "dynamic"} if moves else None,
    )
    record_partitions(spark, path, missing)
    return missing


_SWAPPED = 1_000
_SWAP_THREADS = 16


def replace_partitions(
    spark: SparkSession, path: str, partitions: DataFrame, write: Callable[[DataFrame, str], object]
) -> None:
    """Put new contents in place of some partitions (``name``) of a copy; no other one is touched.

    ``write(partitions, folder)`` lays them out in a staging folder first. Each old folder is then
    moved aside and its new one into its place; one that has no rows any more only goes. Names come
    to the driver in batches, as moves are metadata calls. On object stores, which cannot move
    folders, the old ones are deleted and the new ones written in place; as a partition is
    recorded only after that, a run that broke off does it again.
    """
    names = (row["name"] for row in partitions.select("name").toLocalIterator())
    if not folders.renames_in_place(spark, path):
        while batch := list(itertools.islice(names, _SWAPPED)):
            folders.remove_all(spark, [f"{path}/{name}" for name in batch])
        write(partitions, path)
        return
    staging, aside = staging_path(path), staging_path(path, SWAPPED)

    def swap(name: str) -> None:
        old, new = f"{path}/{name}", f"{staging}/{name}"
        had = folders.exists(spark, old)
        if had:
            folders.rename(spark, old, f"{aside}/{name}")
        if folders.exists(spark, new):
            try:
                folders.rename(spark, new, old)
            except BaseException:
                if had:
                    folders.rename(spark, f"{aside}/{name}", old)
                raise

    try:
        write(partitions, staging)
        with ThreadPoolExecutor(_SWAP_THREADS) as pool:
            while batch := list(itertools.islice(names, _SWAPPED)):
                list(pool.map(swap, batch))
    finally:
        drop_staging(spark, staging)
        drop_staging(spark, aside)


def staging_path(target: str, mark: str = "") -> str:
    """A staging folder next to the target, recognisable by its name."""
    head, _, tail = target.rstrip("/").rpartition("/")
    return f"{head}/{tail}{STAGING_HINT}{mark}{uuid.uuid4().hex[:12]}"


def drop_staging(spark: SparkSession, path: str) -> None:
    """Delete a staging folder; refuses any path that is not one."""
    if STAGING_HINT not in path.rstrip("/").rpartition("/")[2]:
        raise ValueError(f"not a staging folder: {path}")
    folders.remove(spark, path)


def staged_publish(
    spark: SparkSession, write: Callable[[str], object], target: str, overwrite: bool = False
) -> None:
    """Write to a staging folder, then move it to the target; readers never see half a copy.

    An old copy is moved aside and deleted only when the new one is in place; if that
    fails, it is put back.
    """
    staging, aside = staging_path(target), staging_path(target, ASIDE)
    try:
        write(staging)
        if not folders.exists(spark, target):
            folders.rename(spark, staging, target)
            return
        if not overwrite:
            raise FileExistsError(target)
        folders.rename(spark, target, aside)
        try:
            folders.rename(spark, staging, target)
        except BaseException:
            folders.rename(spark, aside, target)
            raise
        drop_staging(spark, aside)
    finally:
        drop_staging(spark, staging)


# --- byte copy --------------------------------------------------------------------------

def copy_files(
    spark: SparkSession,
    source_base: str,
    target_base: str,
    pattern: str | None = None,
    overwrite: bool = True,
) -> DataFrame:
    """Copy every file below ``source_base`` to the same place below ``target_base``."""
    return copy_listed(spark, files.walk_files(spark, source_base, pattern), target_base, overwrite)


def full_copy_bytes(
    spark: SparkSession, table: SourceTable, path: str, chosen: DataFrame | None = None
) -> SourceTable:
    """A full copy that moves files as they are and keeps the folder layout.

    ``chosen`` needs ``name`` and ``location``. No row is decoded, nothing is shuffled but
    file names; files that do not arrive whole are an error.
    """
    if table.location is None:
        raise ValueError(f"{table.name} has no files of its own")
    if chosen is None or not table.partition_columns:
        report = copy_files(spark, table.location, path)
    else:
        # A registered partition without a folder is an empty one: nothing is listed there.
        starts = chosen.select(F.col("location").alias("path"), F.col("name").alias("relative"))
        report = copy_listed(spark, files.walk_folders(starts, missing_ok=True), path)
    whole(report, table.name)
    folders.make_dir(spark, path)
    return _result(spark, table, path, table.storage)


def copy_through(spark: SparkSession, source_base: str, via: str, target_base: str) -> DataFrame:
    """Two hops over a temporary place that both sides can reach; it is removed after."""
    staging = staging_path(f"{via.rstrip('/')}/hop")
    try:
        whole(copy_files(spark, source_base, staging), source_base)
        return whole(copy_files(spark, staging, target_base), source_base)
    finally:
        drop_staging(spark, staging)


def common_location(listing: DataFrame, base: str) -> DataFrame:
    """Guard: every listed path must lie below the base, else an error."""
    return listing.where(
        F.when(paths.is_below(F.col("path"), base), F.lit(True)).otherwise(
            F.raise_error(F.concat(F.lit(f"not below {base}: "), F.col("path"))).cast("boolean")
        )
    )
