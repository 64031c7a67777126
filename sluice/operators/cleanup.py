"""Removing what a run brought in, by the same selection rules."""

from __future__ import annotations

import itertools
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from sluice import storage
from sluice.functions.ddl import partition_clause, quoted_name
from sluice.model import CopyPolicy, TableSpec, UnresolvedRequest
from sluice.operators import select
from sluice.session import pin
from sluice.sources.tables import catalog_partitions, located_partitions, open_catalog

_BATCH = 200


def drop_partitions(
    spark: SparkSession, name: str, partitions: DataFrame, columns: Sequence[str]
) -> int:
    """Drop listed partitions from the catalog and delete the folders at their ``location``.

    The catalog keeps the files of a table with a location of its own, so folders go in
    a second step, concurrently, per batch.
    """
    rows = partitions.select(*columns, "location").toLocalIterator()
    dropped = 0
    while batch := list(itertools.islice(rows, _BATCH)):
        clauses = [partition_clause({c: row[c] for c in columns}) for row in batch]
        spark.sql(f"ALTER TABLE {quoted_name(name)} DROP IF EXISTS {', '.join(clauses)}")
        storage.remove_all(spark, [row["location"] for row in batch])
        dropped += len(batch)
    return dropped


def cleanup(
    spark: SparkSession,
    specs: Sequence[TableSpec],
    policy: CopyPolicy,
    allow_drop_table: bool = False,
) -> dict[str, str]:
    """Clean the registered copies of all requests that are not marked to be kept.

    Selection runs against the copy's own partitions, so a cap of N drops its last N.
    A plain table is dropped whole; a partitioned one without any selected partition
    only with ``allow_drop_table``. Partitions go where the catalog says they lie. Returns
    what happened per table; a failure is told there and does not stop the others.
    """
    outcome: dict[str, str] = {}
    for spec in specs:
        if spec.skip_cleanup:
            outcome[spec.name] = "kept"
            continue
        try:
            table = open_catalog(spark, spec.name)
            columns = list(table.partition_columns)
            dropped = 0
            if columns:
                chosen = pin(
                    select.resolve(
                        catalog_partitions(spark, spec.name),
                        spec.partitions,
                        policy.partition_count(spec),
                        spec.top_level_count or -1,
                    ),
                    "cleanup",
                )
                chosen = located_partitions(spark, table, chosen)
                dropped = drop_partitions(spark, spec.name, chosen, columns)
                outcome[spec.name] = f"dropped {dropped} partitions"
            if dropped == 0 and (not columns or allow_drop_table):
                spark.sql(f"DROP TABLE IF EXISTS {quoted_name(spec.name)}")
                if table.location:
                    storage.remove(spark, table.location)
                outcome[spec.name] = "dropped table"
        except UnresolvedRequest as error:
            outcome[spec.name] = f"invalid: {error}"
        except Exception as error:  # one table's failure does not keep the others
            outcome[spec.name] = f"failed: {type(error).__name__}: {error}"
    return outcome
