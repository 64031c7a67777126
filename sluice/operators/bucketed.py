"""Copies that keep the bucketing of their source.

Rows are hashed to the source's buckets and sorted as there, in one shuffle on the bucket columns, and
the copy is registered with the same clustering. Joins and groupings on these columns then
need no exchange, and equality on them reads one bucket. A sample is a filter before that shuffle, so it
moves its own share only.

The files are written through a passing table in a staging folder, as bucket numbers are put into file
names by table writes alone. The folder is then moved into place as any whole copy.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sluice.functions.ddl import quoted_name
from sluice.operators import copy, register
from sluice.sources.tables import SourceTable, open_catalog


@dataclass(frozen=True)
class Buckets:
    count: int
    columns: tuple[str, ...]
    sorted_by: tuple[str, ...] = ()

    def clause(self) -> str:
        def names(columns: Sequence[str]) -> str:
            return ", ".join(f"`{c}`" for c in columns)

        order = f" SORTED BY ({names(self.sorted_by)})" if self.sorted_by else ""
        return f" CLUSTERED BY ({names(self.columns)}){order} INTO {self.count} BUCKETS"


def buckets_of(spark: SparkSession, name: str) -> Buckets | None:
    """The bucketing of a registered table; None if it has none."""
    details = json.loads(spark.sql(f"DESCRIBE EXTENDED {quoted_name(name)} AS JSON").first()[0])
    count = int(details.get("num_buckets") or 0)
    if count <= 0:
        return None
    return Buckets(count, tuple(details["bucket_columns"]), tuple(details.get("sort_columns") or ()))


def write_bucketed(
    rows: DataFrame, path: str, buckets: Buckets, columns: Sequence[str] = (), source: str = "parquet", database: str = "default"
) -> None:
    """Write rows into bucket files, one per bucket (and partition).

    The shuffle deals rows as buckets do, so every task writes one bucket. Such a task holds all of a hot
    bucket, as bucketing itself does; it streams through a sort that spills.
    """
    spark = rows.sparkSession
    passing = f"{quoted_name(database)}.passing_{uuid.uuid4().hex}"
    dealt = rows.repartition(buckets.count, *buckets.columns)
    writer = dealt.write.format(source).bucketBy(buckets.count, *buckets.columns).option("path", path)
    if buckets.sorted_by:
        writer = writer.sortBy(*buckets.sorted_by)
    if columns:
        writer = writer.partitionBy(*columns)
    try:
        writer.saveAsTable(passing)
    finally:
        # Its place is given, so the files stay.
        spark.sql(f"DROP TABLE IF EXISTS {passing}")


def bucketed_copy(
    spark: SparkSession,
    table: SourceTable,
    name: str,
    path: str,
    p: float = 1.0,
    keys: Sequence[str] = (),
    method: str = "md5",
    chosen: DataFrame | None = None,
    overwrite: bool = False,
    buckets: Buckets | None = None,
) -> SourceTable:
    """Copy or sample ``table`` to ``path`` and register it as ``name`` with its source's bucketing.

    ``buckets`` gives a bucketing to a table without one, or another one. ``chosen`` are partitions as
    for other copies. With ``overwrite`` a copy at ``path`` is replaced, its definition too.
    """
    buckets = buckets or (buckets_of(spark, table.name) if table.registered else None)
    if buckets is None:
        raise ValueError(f"{table.name} is not bucketed")
    columns = list(table.partition_columns)
    schema = table.frame.schema
    if set(buckets.columns) & set(columns):
        raise ValueError("a partition column cannot be a bucket column")
    rows = copy.copied_rows(table, p, keys, method, chosen)
    database = name.rpartition(".")[0] or spark.catalog.currentDatabase()

    def write(to: str) -> None:
        write_bucketed(rows, to, buckets, columns, table.storage.source, database)

    copy.staged_publish(spark, write, path, overwrite)
    if overwrite:
        spark.sql(f"DROP TABLE IF EXISTS {quoted_name(name)}")
    definition = (name, schema, columns, path, table.storage, table.comment, table.properties, buckets.clause())
    spark.sql(register.create_table_statement(*definition))
    if columns:
        spark.sql(f"MSCK REPAIR TABLE {quoted_name(name)}")
    return open_catalog(spark, name)
