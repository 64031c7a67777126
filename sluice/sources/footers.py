"""Rows and bytes of a flat parquet table by partition, from file footers.

Executors read footers only. A row group whose statistics put its first and last time into one
partition counts there whole, without any of its pages being read. Of the others, and only of their
files, the time column is scanned; a group's bytes are dealt to its partitions by their rows,
so that they add up to the group's.

Footers are read with Arrow, as byte copies are done: executors need access to the files outside
of Spark's own readers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sluice.functions import paths
from sluice.session import pin
from sluice.sources import files
from sluice.sources.tables import SourceTable

GROUPS = "path string, row_group int, first_row long, rows long, bytes long, low timestamp_ntz, high timestamp_ntz"


def _footer_reader(column: str | None) -> Callable:
    """The executor side; nested, so that it travels with the task."""
    open_uri = files.uri_opener()

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import datetime

        import pyarrow.parquet as pq

        def moment(value):
            if isinstance(value, datetime.datetime):
                return value.astimezone(datetime.timezone.utc).replace(tzinfo=None) if value.tzinfo else value
            return datetime.datetime(value.year, value.month, value.day) if isinstance(value, datetime.date) else None

        for frame in frames:
            rows = []
            for path in frame["path"]:
                system, place = open_uri(path)
                with system.open_input_file(place) as stream:
                    footer = pq.ParquetFile(stream).metadata
                first = 0
                for g in range(footer.num_row_groups):
                    group = footer.row_group(g)
                    parts = [group.column(i) for i in range(group.num_columns)]
                    size = sum(p.total_compressed_size for p in parts)
                    own = next((p.statistics for p in parts if p.path_in_schema == column), None)
                    # Nulls have no place between the least and the greatest value.
                    told = own is not None and own.has_min_max and own.has_null_count and not own.null_count
                    low, high = (moment(own.min), moment(own.max)) if told else (None, None)
                    rows.append((path, g, first, group.num_rows, size, low, high))
                    first += group.num_rows
            names = ["path", "row_group", "first_row", "rows", "bytes", "low", "high"]
            found = pd.DataFrame(rows, columns=names)
            for name in ("low", "high"):
                found[name] = pd.to_datetime(found[name])
            yield found

    return batches


def scanned_files(frame: DataFrame) -> DataFrame:
    """``path`` of each file that a frame reads; no column of them is read for it."""
    path = F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):///", "$1:/")
    # Paths come as URIs, in which a plus sign is one.
    return frame.select(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("path")).distinct()


def row_groups(spark: SparkSession, listing: DataFrame, column: str | None = None) -> DataFrame:
    """Every row group of listed parquet files (``path``), with the bounds of a time column."""
    plan = pin(listing.select("path"), "footer-files")
    tasks = max(1, min(plan.count(), 4 * spark.sparkContext.defaultParallelism))
    return pin(plan.repartition(tasks).mapInPandas(_footer_reader(column), GROUPS), "row-groups")


def _named(rows: DataFrame, table: SourceTable, at: Column, prefix: str) -> DataFrame:
    """Partition columns of a moment, under prefixed names."""
    kind = table.frame.schema[table.layout.time_column].dataType
    moments = rows.withColumn(table.layout.time_column, at.cast(kind))
    named = table.layout.apply(moments).drop(table.layout.time_column)
    return named.withColumnsRenamed({c: f"{prefix}{c}" for c in table.partition_columns})


def partition_sizes(spark: SparkSession, table: SourceTable) -> DataFrame:
    """Partition columns, ``name``, ``row_count`` and ``bytes`` of a flat parquet table with a layout (pinned)."""
    columns = list(table.partition_columns)
    groups = row_groups(spark, scanned_files(table.frame), table.layout.time_column)
    named = _named(_named(groups, table, F.col("low"), "low_"), table, F.col("high"), "high_")
    alike = [F.coalesce(F.col(f"low_{c}") == F.col(f"high_{c}"), F.lit(False)) for c in columns]
    named = pin(named.withColumn("whole", F.forall(F.array(*alike), lambda same: same)), "named-groups")
    whole = named.where("whole").select(*[F.col(f"low_{c}").alias(c) for c in columns], "rows", "bytes")
    mixed = pin(named.where("NOT whole").select("path", "row_group", "first_row", "rows", "bytes"), "mixed-groups")
    found = whole if mixed.isEmpty() else whole.unionByName(_dealt(table, mixed))
    sums = found.groupBy(*columns).agg(F.sum("rows").alias("row_count"), F.sum("bytes").alias("bytes"))
    return pin(sums.select(*columns, paths.partition_name(columns).alias("name"), "row_count", "bytes"), "footer-sizes")


def _dealt(table: SourceTable, mixed: DataFrame) -> DataFrame:
    """Rows and bytes by partition within the groups of several; reads their files' time column."""
    columns = list(table.partition_columns)
    path = F.regexp_replace(F.col("_metadata.file_path"), "^([a-z0-9]+):///", "$1:/")
    placed = table.frame.select(
        *columns,
        F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))).alias("at"),
        F.col("_metadata.row_index").alias("row_index"),
    )
    inside = (F.col("at") == F.col("path")) & (F.col("row_index") >= F.col("first_row"))
    inside &= F.col("row_index") < F.col("first_row") + F.col("rows")
    counts = (
        placed.join(mixed, inside)
        .groupBy("path", "row_group", "rows", "bytes", *columns)
        .agg(F.count("*").alias("own"))
    )
    # A group's bytes up to and with a partition, less those before it: they add up exactly.
    order = Window.partitionBy("path", "row_group").orderBy(*columns)
    upto = F.sum("own").over(order)

    def share(rows: Column) -> Column:
        return F.floor(F.col("bytes").cast("decimal(38,0)") * rows / F.col("rows")).cast("long")

    dealt = counts.withColumn("upto", upto)
    return dealt.select(
        *columns, F.col("own").alias("rows"), (share(F.col("upto")) - share(F.col("upto") - F.col("own"))).alias("bytes")
    )


def table_size(spark: SparkSession, table: SourceTable) -> DataFrame:
    """``name, files, rows, bytes`` of a flat parquet table, from its footers alone."""
    groups = row_groups(spark, scanned_files(table.frame))
    return groups.agg(
        F.lit(table.name).alias("name"),
        F.count_distinct("path").alias("files"),
        F.coalesce(F.sum("rows"), F.lit(0)).cast("long").alias("rows"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
    )
