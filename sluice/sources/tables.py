"""Source tables and their partitions."""

from __future__ import annotations

import functools
import itertools
import json
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice import storage
from sluice.functions import fingerprints, paths
from sluice.functions.ddl import partition_clause, quoted_name
from sluice.model import SUMMARY_SCHEMA, PartitionSpec, UnresolvedRequest
from sluice.session import local_rows, new_scratch, pin
from sluice.sources import files
from sluice.sources.formats import PARQUET, StorageFormat
from sluice.sources.layouts import Layout


@dataclass(frozen=True)
class SourceTable:
    """A frame, its partition columns, and where its files lie (None: not laid out)."""

    name: str
    frame: DataFrame
    partition_columns: tuple[str, ...] = ()
    location: str | None = None
    layout: Layout | None = None
    storage: StorageFormat = PARQUET
    registered: bool = False
    comment: str | None = None
    properties: Mapping[str, str] = field(default_factory=dict)

    @property
    def types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.frame.schema if f.name in self.partition_columns}

    @property
    def type_names(self) -> dict[str, str]:
        return {name: kind.simpleString() for name, kind in self.types.items()}


def open_flat(spark: SparkSession, folder: str, name: str, layout: Layout | None = None) -> SourceTable:
    """A single parquet file or folder, with partition columns derived by a layout."""
    try:
        frame = spark.read.parquet(f"{folder}/{name}.parquet")
    except AnalysisException as error:
        raise UnresolvedRequest(f"table not found: {name}") from error
    if layout is None:
        return SourceTable(name, frame)
    return SourceTable(name, layout.apply(frame), tuple(layout.columns), layout=layout)


def open_folder(
    spark: SparkSession,
    name: str,
    path: str,
    schema: T.StructType,
    partition_columns: tuple[str, ...] = (),
    storage: StorageFormat = PARQUET,
) -> SourceTable:
    """A ``col=value`` folder tree.

    The schema is declared, so partition values stay as they are spelled (``hour=00``)
    and no file is opened to infer anything.
    """
    reader = spark.read.format(storage.source).options(**storage.options).option("basePath", path)
    frame = reader.schema(schema).load(path)
    return SourceTable(name, frame, tuple(partition_columns), location=path, storage=storage)


def open_catalog(spark: SparkSession, name: str) -> SourceTable:
    """A registered table."""
    if not spark.catalog.tableExists(name):
        raise UnresolvedRequest(f"table not found: {name}")
    details = json.loads(spark.sql(f"DESCRIBE EXTENDED {quoted_name(name)} AS JSON").first()[0])
    return SourceTable(
        name,
        spark.table(name),
        tuple(details.get("partition_columns", ())),
        location=details.get("location"),
        storage=StorageFormat(
            details.get("provider", "parquet").lower(), details.get("storage_properties", {})
        ),
        registered=True,
        comment=details.get("comment"),
        properties={
            k: v
            for k, v in details.get("table_properties", {}).items()
            if not k.startswith(("spark.sql.", "transient_"))
        },
    )


def column_definitions(schema: T.StructType) -> list[tuple[int, str, str, bool]]:
    """``(position, name, type, nullable)`` of a declared schema."""
    return [(i, f.name, f.dataType.simpleString(), f.nullable) for i, f in enumerate(schema)]


def _partition_text(column: str, kind: T.DataType) -> Column:
    """A partition value as a folder keeps it: empty text is null."""
    value = F.col(f"`{column}`")
    return F.when(value != "", value).alias(column) if isinstance(kind, T.StringType) else value


def list_partitions(table: SourceTable) -> DataFrame:
    """Partition columns, ``name`` and ``row_count`` of every partition that has rows.

    Reads the partition columns (or the layout's time column) only, and combines
    before the shuffle, so a hot partition costs one row per task. Pin the result before
    filtering on ``name``: the optimizer would move that filter down to the table's rows.
    """
    columns = list(table.partition_columns)
    values = [_partition_text(c, table.types[c]) for c in columns]
    return (
        table.frame.groupBy(*values)
        .agg(F.count("*").alias("row_count"))
        .select(*columns, paths.partition_name(columns).alias("name"), "row_count")
    )


def catalog_partitions(spark: SparkSession, name: str, spec: PartitionSpec | None = None) -> DataFrame:
    """Registered partitions, optionally those below a partial spec.

    A spec that matches nothing is an error; registered partitions without rows count.
    """
    table = open_catalog(spark, name)
    clause = ""
    if spec:
        clause = " " + partition_clause(spec)
    listed = spark.sql(f"SHOW PARTITIONS {quoted_name(name)}{clause}").withColumnRenamed("partition", "name")
    if spec and listed.isEmpty():
        raise UnresolvedRequest(f"no partition of {name} matches {dict(spec)}")
    return listed.select(
        *[
            paths.partition_value(F.col("name"), c).cast(table.types[c]).alias(c)
            for c in table.partition_columns
        ],
        "name",
    )


def folder_partitions(spark: SparkSession, table: SourceTable) -> DataFrame:
    """Partition columns, ``name``, ``location``, ``files``, ``bytes`` and ``fingerprint`` from the listing.

    Folders are found without opening a data file. Columns below the partition level
    (nested folders) count to their partition.
    """
    listing = files.list_files(spark, table.location, times=True)
    columns = list(table.partition_columns)
    depth = len(columns)
    name = F.array_join(F.slice(F.split("relative", "/"), 1, depth), "/") if depth else F.lit("")
    location = F.regexp_extract("path", "^(.*/)" + "/".join(f"{c}=[^/]*" for c in columns), 0)
    folders = (
        listing.select(
            name.alias("name"),
            (location if depth else F.lit(table.location)).alias("location"),
            F.array_join(F.slice(F.split("relative", "/"), depth + 1, 99), "/").alias("file"),
            "length",
            "modified",
        )
        .groupBy("name", "location")
        .agg(
            F.count("*").alias("files"),
            F.sum("length").alias("bytes"),
            fingerprints.of_files().alias("fingerprint"),
        )
    )
    return folders.select(
        *[paths.partition_value(F.col("name"), c).cast(table.types[c]).alias(c) for c in columns],
        "name",
        "location",
        "files",
        "bytes",
        "fingerprint",
    )


def partition_location(spark: SparkSession, name: str, spec: PartitionSpec) -> str:
    """Where the catalog says one partition lies."""
    rows = spark.sql(f"DESCRIBE EXTENDED {quoted_name(name)} {partition_clause(spec)}").collect()
    return next(r["data_type"] for r in rows if r["col_name"] == "Location")


_PAGE = 10_000
# Up to so many partitions their own folders are listed; for more the whole table's folder is.
_FOLDERS = 2_000


def catalog_pages(
    spark: SparkSession, name: str, spec: PartitionSpec | None = None, page: int = _PAGE
) -> Iterator[list[tuple]]:
    """``(name, location)`` of all registered partitions, in pages.

    The catalog is asked once for all of them, or for those below a partial spec, and each page
    comes over as one text, so that the cost does not lie in single calls.
    """
    jvm, state = spark._jvm, spark._jsparkSession.sessionState()
    identifier = state.sqlParser().parseTableIdentifier(quoted_name(name))
    wanted = jvm.scala.Option.apply(
        jvm.org.apache.spark.api.python.PythonUtils.toScalaMap(dict(spec)) if spec else None
    )
    found = state.catalog().listPartitions(identifier, wanted)
    mapper = jvm.com.fasterxml.jackson.databind.ObjectMapper()
    mapper.registerModule(getattr(getattr(jvm.com.fasterxml.jackson.module.scala, "DefaultScalaModule$"), "MODULE$"))
    columns = open_catalog(spark, name).partition_columns
    here = storage.qualify(spark, "/")
    for low in range(0, found.size(), page):
        rows = json.loads(mapper.writeValueAsString(found.slice(low, low + page)))
        yield [(_name_of(columns, row["spec"]), _as_listed(row["storage"]["locationUri"], here)) for row in rows]


def _as_listed(uri: str, here: str) -> str:
    """A place as listings show it: decoded, without an empty authority, with a scheme."""
    text = unquote(uri).replace(":///", ":/", 1).rstrip("/")
    return here + text if text.startswith("/") else text


def _name_of(columns: Sequence[str], values: Mapping[str, str | None]) -> str:
    """A partition's name as the catalog lists it."""

    def escaped(text: str) -> str:
        return "".join(f"%{ord(c):02X}" if c in paths.ESCAPED_CHARACTERS or ord(c) < 32 or ord(c) == 127 else c for c in text)

    folded = {k.lower(): v for k, v in values.items()}
    return "/".join(f"{escaped(c)}={escaped(folded[c.lower()] or paths.NULL_PARTITION)}" for c in columns)


def partition_places(spark: SparkSession, name: str) -> DataFrame:
    """``name, location`` of all registered partitions, written page by page."""
    schema = "name string, location string"
    path = new_scratch(spark, "partition-places")
    spark.createDataFrame([], schema).write.parquet(path)
    for rows in catalog_pages(spark, name):
        local_rows(spark, rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def located_partitions(
    spark: SparkSession, table: SourceTable, chosen: DataFrame | None = None
) -> DataFrame:
    """Partitions of a laid-out table, or the chosen ones, with ``location``, ``bytes`` and ``fingerprint``.

    For a registered table the places are the catalog's, wherever they lie, so partitions
    without files count. The catalog is read in pages; sizes come from a distributed listing,
    joined on the place. For a folder tree all come from the listing.
    """
    if not (table.registered and table.partition_columns):
        folders = folder_partitions(spark, table).drop("files")
        return folders if chosen is None else folders.join(chosen.select("name"), "name", "left_semi")
    columns = list(table.partition_columns)
    places = partition_places(spark, table.name)
    if chosen is None:
        values = [paths.partition_value(F.col("name"), c).cast(table.types[c]).alias(c) for c in columns]
        listed = places.select(*values, "name", "location")
    else:
        listed = chosen.select(*columns, "name").join(places, "name", "left")
    listed = pin(listed, "partition-places")
    sizes = _sizes_below(spark, table, listed)
    return listed.join(sizes, "location", "left").select(
        *columns,
        "name",
        "location",
        F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"),
        F.coalesce("fingerprint", F.lit("")).alias("fingerprint"),
    )


def _sizes_below(spark: SparkSession, table: SourceTable, listed: DataFrame) -> DataFrame:
    """``location, bytes, fingerprint`` of the listed places that hold files.

    Spark lists folders in tasks of its own. Few places are listed each, many by the table's
    folder and those outside of it each.
    """
    own = listed.select("location")
    base = storage.qualify(spark, table.location)
    parts = []
    if own.count() > _FOLDERS:
        outside = own.where(~paths.is_below(F.col("location"), base))
        if storage.exists(spark, base):
            parts.append(files.list_files(spark, base, times=True))
    else:
        outside = own
    rows = outside.toLocalIterator()
    while page := [r["location"] for r in itertools.islice(rows, _FOLDERS)]:
        there = storage.existing(spark, page)
        parts.append(files.list_folders(spark, there)) if there else None
    if not parts:
        return spark.createDataFrame([], "location string, bytes long, fingerprint string")
    depth = F.size(F.split("location", "/"))
    deep = [r["depth"] for r in listed.select(depth.alias("depth")).distinct().collect()]
    listing = functools.reduce(DataFrame.unionByName, [p.select("path", "length", "modified") for p in parts])
    # A file belongs to the place that its path begins with, whatever folders lie between.
    steps = F.split("path", "/")
    places = F.transform(F.array(*[F.lit(d) for d in deep]), lambda d: F.array_join(F.slice(steps, F.lit(1), d), "/"))
    found = listing.select("path", "length", "modified", F.explode(F.array_distinct(places)).alias("location"))
    file = F.substr("path", F.length("location") + 2)
    return (
        found.select("location", file.alias("file"), "length", "modified")
        .groupBy("location")
        .agg(F.sum("length").alias("bytes"), fingerprints.of_files().alias("fingerprint"))
        .join(listed.select("location").distinct(), "location", "left_semi")
    )


_FIXED_WIDTHS = {
    "boolean": 1,
    "tinyint": 1,
    "smallint": 2,
    "int": 4,
    "bigint": 8,
    "float": 4,
    "double": 8,
    "date": 4,
    "timestamp": 8,
    "timestamp_ntz": 8,
}


def logical_bytes(schema: T.StructType) -> Column:
    """Width of a row: fixed widths, text and binary by length, arrays by element.

    Stands in for file sizes where a table is not laid out in files of its own.
    """

    def width(column: Column, kind: T.DataType) -> Column:
        fixed = _FIXED_WIDTHS.get(kind.simpleString())
        if fixed is not None:
            return F.when(column.isNull(), F.lit(0)).otherwise(F.lit(fixed))
        if isinstance(kind, T.DecimalType):
            return F.when(column.isNull(), F.lit(0)).otherwise(F.lit(16))
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(column), F.lit(0))
        if isinstance(kind, T.ArrayType) and kind.elementType.simpleString() in _FIXED_WIDTHS:
            each = _FIXED_WIDTHS[kind.elementType.simpleString()]
            return F.when(column.isNull(), F.lit(0)).otherwise(F.size(column) * each)
        if isinstance(kind, T.ArrayType):
            return F.coalesce(
                F.aggregate(column, F.lit(0), lambda acc, x: acc + width(x, kind.elementType)), F.lit(0)
            )
        if isinstance(kind, T.StructType):
            return functools.reduce(
                lambda a, b: a + b, [width(column[f.name], f.dataType) for f in kind], F.lit(0)
            )
        if isinstance(kind, T.MapType):
            entries = T.ArrayType(
                T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
            )
            return width(F.map_entries(column), entries)
        raise ValueError(f"no width for {kind.simpleString()}")

    total = functools.reduce(lambda a, b: a + b, [width(F.col(f.name), f.dataType) for f in schema])
    return total.cast("long")


def size_by_partition(spark: SparkSession, table: SourceTable) -> DataFrame:
    """Partition columns, ``name`` and ``bytes``: file sizes when laid out, else row widths."""
    columns = list(table.partition_columns)
    if table.location is not None:
        return located_partitions(spark, table).select(*columns, "name", "bytes")
    data = T.StructType([f for f in table.frame.schema if f.name not in columns])
    return (
        table.frame.groupBy(*columns)
        .agg(F.sum(logical_bytes(data)).alias("bytes"))
        .select(*columns, paths.partition_name(columns).alias("name"), "bytes")
    )


def summary_row(spark: SparkSession, table: SourceTable) -> DataFrame:
    """One summary row. ``files`` counts locations: partitions, or 1 for a plain table."""
    sized = size_by_partition(spark, table)
    count = F.count("*").cast("long") if table.partition_columns else F.lit(0).cast("long")
    return sized.agg(
        F.lit(table.name).alias("name"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
        F.greatest(count, F.lit(1)).cast("long").alias("files"),
        count.alias("partitions"),
        F.lit(None).cast("string").alias("error"),
    ).to(SUMMARY_SCHEMA)


def source_summary(
    spark: SparkSession, tables: Mapping[str, SourceTable], errors: Mapping[str, str]
) -> DataFrame:
    """Valid tables with their size, invalid ones with their error; a table that cannot be
    sized is invalid and does not stop the others."""
    errors, rows = dict(errors), []
    for name, table in tables.items():
        try:
            rows.append(summary_row(spark, table))
        except Exception as error:  # noqa: BLE001
            errors[name] = str(error)
    invalid = local_rows(
        spark, [(name, None, None, None, message) for name, message in errors.items()], SUMMARY_SCHEMA
    )
    return functools.reduce(DataFrame.unionByName, rows, invalid)


def summary_totals(summary: DataFrame) -> DataFrame:
    """Valid count, invalid count and total bytes."""
    return summary.agg(
        F.count_if(F.col("error").isNull()).alias("valid"),
        F.count_if(F.col("error").isNotNull()).alias("invalid"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("bytes"),
    )


def export_summary(summary: DataFrame, path: str) -> None:
    """``name,bytes,files,partitions,error`` with a header, empty where not known."""
    summary.select(*SUMMARY_SCHEMA.fieldNames()).write.option("header", True).option(
        "nullValue", ""
    ).csv(path)
