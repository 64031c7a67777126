"""Registering copies in the catalog, and the log that lets others attach to them."""

from __future__ import annotations

import getpass
import itertools
import time
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import storage as folders
from sluice.functions import clock, paths
from sluice.functions.ddl import literal, partition_clause, quoted_name
from sluice.model import LOG_SCHEMA
from sluice.operators import compaction
from sluice.session import local_rows
from sluice.sources.formats import PARQUET, StorageFormat

HIVE, FILES = "hive", "hdfs"

# Order of a table's statements in the log.
DATABASE, USE, TABLE, PARTITION = range(4)

_BATCH = 200
_LOG_FILES = 8


def _columns_ddl(schema: T.StructType) -> str:
    def column(f: T.StructField) -> str:
        comment = f.metadata.get("comment")
        note = f" COMMENT {literal(comment)}" if comment else ""
        return f"`{f.name}` {f.dataType.simpleString()}{note}"

    return ", ".join(column(f) for f in schema)


def create_database(spark: SparkSession, database: str, location: str | None = None) -> None:
    where = f" LOCATION {literal(location)}" if location else ""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted_name(database)}{where}")


def create_table_statement(
    name: str,
    schema: T.StructType,
    columns: Sequence[str],
    location: str,
    storage: StorageFormat = PARQUET,
    comment: str | None = None,
    properties: Mapping[str, str] | None = None,
    clustered: str = "",
) -> str:
    options = ", ".join(f"{literal(k)} = {literal(v)}" for k, v in sorted(storage.options.items()))
    with_options = f" OPTIONS ({options})" if options else ""
    note = f" COMMENT {literal(comment)}" if comment else ""
    kept = ", ".join(f"{literal(k)} = {literal(v)}" for k, v in sorted((properties or {}).items()))
    with_properties = f" TBLPROPERTIES ({kept})" if kept else ""
    partitioned = f" PARTITIONED BY ({', '.join(f'`{c}`' for c in columns)})" if columns else ""
    return (
        f"CREATE TABLE IF NOT EXISTS {quoted_name(name)} ({_columns_ddl(schema)})"
        f" USING {storage.source}{with_options}{partitioned}{clustered} LOCATION {literal(location)}{note}{with_properties}"
    )


def register_copy(
    spark: SparkSession,
    name: str,
    schema: T.StructType,
    columns: Sequence[str],
    location: str,
    storage: StorageFormat = PARQUET,
    discover: bool = True,
    comment: str | None = None,
    properties: Mapping[str, str] | None = None,
) -> None:
    """Make a copy queryable. Safe to repeat; what exists is not overridden.

    With ``discover`` partitions are found by a distributed listing and added in batches.
    """
    folders.make_dir(spark, location)
    spark.sql(create_table_statement(name, schema, columns, location, storage, comment, properties))
    if columns and discover:
        spark.sql(f"MSCK REPAIR TABLE {quoted_name(name)}")


# --- definitions that changed -------------------------------------------------------------

# Each type reads what was written as one before it in its row.
_WIDER = ("tinyint", "smallint", "int", "bigint"), ("float", "double")


class DefinitionDrift(ValueError):
    """A source whose columns changed in a way that its copy cannot follow."""


def _widens(old: T.DataType, new: T.DataType) -> bool:
    if isinstance(old, T.DecimalType) and isinstance(new, T.DecimalType):
        return new.scale == old.scale and new.precision > old.precision
    names = old.simpleString(), new.simpleString()
    return any(row.index(names[0]) < row.index(names[1]) for row in _WIDER if names[0] in row and names[1] in row)


def definition_changes(
    old: T.StructType, new: T.StructType, columns: Sequence[str]
) -> tuple[list[T.StructField], list[T.StructField]]:
    """Columns that came new, and those whose type got wider; any other change is an error.

    The order of columns and their being nullable do not matter.
    """
    before = {f.name.lower(): f for f in old}
    after = {f.name.lower(): f for f in new}
    parts = {c.lower() for c in columns}
    gone = [f.name for f in old if f.name.lower() not in after]
    if gone:
        raise DefinitionDrift(f"columns are gone from the source: {', '.join(gone)}")
    added = [f for f in new if f.name.lower() not in before]
    if any(f.name.lower() in parts for f in added):
        raise DefinitionDrift("the source is partitioned by other columns")
    widened = []
    for f in new:
        kept = before.get(f.name.lower())
        if kept is None or kept.dataType.simpleString() == f.dataType.simpleString():
            continue
        if f.name.lower() in parts or not _widens(kept.dataType, f.dataType):
            raise DefinitionDrift(
                f"{f.name} was {kept.dataType.simpleString()} and is {f.dataType.simpleString()} at the source"
            )
        widened.append(f)
    return added, widened


def check_definition(spark: SparkSession, name: str, schema: T.StructType, columns: Sequence[str]) -> None:
    """An error if the registered table cannot take on the schema."""
    if spark.catalog.tableExists(quoted_name(name)):
        definition_changes(spark.table(quoted_name(name)).schema, schema, columns)


def adapt_definition(
    spark: SparkSession, name: str, schema: T.StructType, columns: Sequence[str], anew: bool = False
) -> list[str]:
    """Let a registered copy take on a changed schema; returns the clauses for the log.

    New columns are added. A wider type needs the table to be defined again, by the caller: it is
    dropped here, its files stay and its partitions are found again. ``anew`` does so for any
    change, for a copy that was replaced as a whole.
    """
    if not spark.catalog.tableExists(quoted_name(name)):
        return []
    try:
        added, widened = definition_changes(spark.table(quoted_name(name)).schema, schema, columns)
    except DefinitionDrift:
        if not anew:
            raise
        added, widened = [], list(schema)
    if widened:
        spark.sql(f"DROP TABLE {quoted_name(name)}")
        return [DROPPED]
    if not added:
        return []
    clause = f"add columns ({_columns_ddl(T.StructType(added))})"
    spark.sql(f"ALTER TABLE {quoted_name(name)} {clause}")
    return [clause]


DROPPED = "drop"


def add_partitions(
    spark: SparkSession, name: str, partitions: DataFrame, columns: Sequence[str], location: str
) -> int:
    """Register listed partitions, also those without any file.

    Names come to the driver in batches, since the catalog is called from there.
    """
    rows = partitions.select(*columns, "name").toLocalIterator()
    added = 0
    while batch := list(itertools.islice(rows, _BATCH)):
        clauses = [
            f"{partition_clause({c: row[c] for c in columns})} LOCATION {literal(location + '/' + row['name'])}"
            for row in batch
        ]
        spark.sql(f"ALTER TABLE {quoted_name(name)} ADD IF NOT EXISTS {' '.join(clauses)}")
        added += len(batch)
    return added


def create_like(spark: SparkSession, target: str, source: str, location: str) -> None:
    """An empty table with the columns and partitioning of another, in a place of its own."""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quoted_name(target)} LIKE {quoted_name(source)} LOCATION {literal(location)}"
    )


# --- copy log ---------------------------------------------------------------------------


def _entries(frame: DataFrame, ordinal: int, item: Column, statement: Column) -> DataFrame:
    return frame.select(
        F.lit(ordinal).alias("ordinal"), item.cast("string").alias("item"), statement.alias("statement")
    )


def table_statements(
    partitions: DataFrame,
    database: str,
    table: str,
    schema: T.StructType,
    columns: Sequence[str],
    location: Column,
    storage: StorageFormat = PARQUET,
    comment: str | None = None,
    properties: Mapping[str, str] | None = None,
    adapted: Sequence[str] = (),
) -> DataFrame:
    """Replayable statements of a copied table: database, use, table, one per partition.

    ``adapted`` are the clauses by which an older definition of it was brought up to date.

    ``location`` is a partition's folder. Folders appear below ``$LOCATION``, so that the
    statements hold wherever the data is attached from.
    """
    spark = partitions.sparkSession
    types = {f.name: f.dataType.simpleString() for f in schema if f.name in columns}
    root = f"{paths.LOCATION_VARIABLE}/{database}/{table}"
    created = create_table_statement(f"`{table}`", schema, columns, root, storage, comment, properties)
    head = local_rows(
        spark,
        [
            (DATABASE, "", f"create database if not exists `{database}`;"),
            (USE, "", f"use `{database}`;"),
            (TABLE, "", f"{created};"),
            *[(USE, c, f"drop table if exists `{table}`;") for c in adapted if c == DROPPED],
            *[(TABLE, c, f"alter table `{table}` {c};") for c in adapted if c != DROPPED],
        ],
        "ordinal int, item string, statement string",
    )
    statement = F.concat(
        F.lit(f"alter table `{table}` add if not exists partition ("),
        paths.spec_text(paths.partition_pairs(F.col("name")), types, quoted=True),
        F.lit(") location '"),
        paths.to_location_variable(location),
        F.lit("';"),
    )
    return head.unionByName(_entries(partitions, PARTITION, F.col("name"), statement))


def file_statements(listing: DataFrame, target_uri: str) -> DataFrame:
    """The full target URI of each loose file that was copied."""
    return _entries(
        listing, 0, F.col("relative"), F.concat(F.lit(target_uri.rstrip("/") + "/"), F.col("relative"))
    )


def append_log(
    statements: DataFrame,
    log_path: str,
    data_type: str = HIVE,
    written_at: Column | None = None,
    writer: str | None = None,
) -> None:
    """Append one block to the log, stamped with UTC time, writer and data type.

    A block is a folder of its own, so tables that finish at the same time do not meet.
    Its few small parts are merged before the write.
    """
    block = f"{time.time_ns() // 1_000_000:015d}-{uuid.uuid4().hex}"
    stamp = clock.sortable_text(clock.utc_now() if written_at is None else written_at)
    (
        statements.coalesce(_LOG_FILES).select(
            stamp.alias("written_at"),
            F.lit(block).alias("block"),
            F.lit(writer or getpass.getuser()).alias("writer"),
            "ordinal",
            "item",
            "statement",
            F.lit(data_type).alias("data_type"),
        )
        .write.json(f"{log_path}/block-{block}")
    )


def read_log(spark: SparkSession, log_path: str) -> DataFrame:
    return _read_blocks(spark, compaction.places(spark, log_path))


def _read_blocks(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).option("recursiveFileLookup", "true").json(folders)


def compact_log(spark: SparkSession, log_path: str, grace: float = compaction.GRACE_SECONDS) -> int:
    """Put all blocks into a few files, each statement as it is; returns how many blocks."""
    return compaction.compact(
        spark, log_path, lambda folders: _read_blocks(spark, folders), lambda log: log, lambda log, to: log.write.json(to), grace
    )


def _in_log_order(log: DataFrame) -> DataFrame:
    """By true time (month names do not sort as text), block by block."""
    return log.orderBy(clock.parse_sortable(F.col("written_at")), "block", "ordinal", "item")


def describe_log(log: DataFrame) -> DataFrame:
    """The readable listing: no database lines, statements cut before their location."""
    lower = F.lower("statement")
    where = F.locate("location", lower)
    shown = F.when(where > 0, F.substr("statement", F.lit(1), where - 1)).otherwise(F.col("statement"))
    listed = log.where(~F.startswith(lower, F.lit("use")) & ~F.startswith(lower, F.lit("create database")))
    return _in_log_order(listed).select(
        "writer",
        clock.readable_text(clock.parse_sortable(F.col("written_at"))).alias("written"),
        "data_type",
        "item",
        shown.alias("line"),
    )


def replayable(log: DataFrame, base: str) -> DataFrame:
    """Table statements in order, with the location variable replaced by a base URI."""
    return _in_log_order(log.where(F.col("data_type") == HIVE)).select(
        "block",
        "ordinal",
        "item",
        paths.from_location_variable(F.col("statement"), base).alias("statement"),
    )


def _batched(rows: Iterable) -> Iterator[tuple[int, str]]:
    """Statements with their ordinal; neighbouring partitions of a table share one call."""

    def target(row):
        head, marker, rest = row["statement"].rstrip("; ").partition(" partition (")
        return (row["block"], row["ordinal"], head if row["ordinal"] == PARTITION else row["statement"])

    for (_, ordinal, head), group in itertools.groupby(rows, key=target):
        if ordinal != PARTITION:
            for row in group:
                yield ordinal, row["statement"].rstrip("; ")
            continue
        while batch := list(itertools.islice(group, _BATCH)):
            yield ordinal, head + "".join(row["statement"].rstrip("; ")[len(head) :] for row in batch)


_THERE = ("COLUMN_ALREADY_EXISTS", "FIELD_ALREADY_EXISTS", "FIELDS_ALREADY_EXISTS")


def attach(spark: SparkSession, log: DataFrame, base: str, database: str | None = None) -> int:
    """Run a log's table statements here; the data stays where it is.

    The log streams through the driver in order, as it is a list of catalog calls.
    ``database`` attaches under another name. Existing tables and partitions stay.
    """
    current = spark.catalog.currentDatabase()
    done = 0
    try:
        for ordinal, text in _batched(replayable(log, base).toLocalIterator()):
            if database is not None:
                if ordinal == DATABASE:
                    create_database(spark, database)
                    continue
                if ordinal == USE and text.lower().startswith("use "):
                    text = f"use {quoted_name(database)}"
            try:
                spark.sql(text)
            except AnalysisException as error:
                # A table that was created by a later definition has the columns already.
                if error.getCondition() not in _THERE or " add columns (" not in text:
                    raise
            done += 1
    finally:
        spark.catalog.setCurrentDatabase(current)
    return done


def run_statements(spark: SparkSession, statements: Sequence[str]) -> DataFrame | None:
    """Run statements in order and return the last one's result."""
    result = None
    for text in statements:
        result = spark.sql(text)
    return result
