"""Storage formats: one name for reader and writer, with the options both sides need."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Hive storage clauses, input formats and row formats, and the Spark data
# source that reads and writes the same files.
HIVE_STORAGE = {
    "PARQUET": "parquet",
    "ORC": "orc",
    "TEXTFILE": "csv",
    "JSONFILE": "json",
}
HIVE_INPUT_FORMATS = {
    "org.apache.hadoop.hive.ql.io.parquet.MapredParquetInputFormat": "parquet",
    "org.apache.hadoop.hive.ql.io.orc.OrcInputFormat": "orc",
    "org.apache.hadoop.mapred.TextInputFormat": "csv",
}
HIVE_SERDES = {
    "org.apache.hadoop.hive.ql.io.parquet.serde.ParquetHiveSerDe": "parquet",
    "org.apache.hadoop.hive.ql.io.orc.OrcSerde": "orc",
    "org.apache.hadoop.hive.serde2.lazy.LazySimpleSerDe": "csv",
    "org.apache.hadoop.hive.serde2.JsonSerDe": "json",
    "org.apache.hive.hcatalog.data.JsonSerDe": "json",
}
# Properties of delimited row formats and the reader option each one is.
HIVE_DELIMITERS = {
    "field.delim": "sep",
    "escape.delim": "escape",
    "serialization.null.format": "nullValue",
    "line.delim": "lineSep",
}


@dataclass(frozen=True)
class StorageFormat:
    """A data source and its options, the same for reading and writing."""

    source: str
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
        return spark.read.format(self.source).options(**self.options).schema(schema).load(path)


PARQUET = StorageFormat("parquet")
ORC = StorageFormat("orc")
JSON = StorageFormat("json")


def delimited(
    fields: str = "\t",
    escape: str = "\\",
    null: str = "\\N",
    line: str | None = None,
    quote: str = '"',
    multiline: bool = False,
) -> StorageFormat:
    """A text table with a field delimiter, an escape, a null text and a line end.

    Quotes are written where they are needed, which keeps empty text apart from null.
    Files without quotes (``quote=""``) read empty text as null. Text with line breaks needs
    ``multiline``, which costs that a file is read by one task.
    """
    options = {"sep": fields, "escape": escape, "nullValue": null, "quote": quote, "header": "false"}
    if line is not None:
        options["lineSep"] = line
    if multiline:
        options["multiLine"] = "true"
    return StorageFormat("csv", options)


def _known(table: dict[str, str], name: str) -> StorageFormat:
    if name not in table:
        raise ValueError(f"no built-in data source for storage format {name}")
    return delimited() if table[name] == "csv" else StorageFormat(table[name])


def from_hive_clause(name: str) -> StorageFormat:
    """The format of a ``STORED AS`` word; a name without a built-in source is an error."""
    return _known(HIVE_STORAGE, name.upper())


def from_input_format(class_name: str) -> StorageFormat:
    """The format of a ``STORED AS INPUTFORMAT`` class."""
    return _known(HIVE_INPUT_FORMATS, class_name)


def from_serde(class_name: str, properties: dict[str, str] | None = None) -> StorageFormat:
    """The format of a ``ROW FORMAT SERDE`` class with its delimiter properties."""
    storage = _known(HIVE_SERDES, class_name)
    if storage.source != "csv":
        return storage
    storage = delimited(quote="")
    given = {HIVE_DELIMITERS[k]: v for k, v in (properties or {}).items() if k in HIVE_DELIMITERS}
    return StorageFormat("csv", {**storage.options, **given})


def pack_collections(df: DataFrame, items: str = ",", keys: str = ":") -> DataFrame:
    """Arrays and string maps as delimited text, for formats without nested types.

    Elements must not contain the delimiters, as in a delimited table.
    """

    def pack(name: str, kind: T.DataType):
        if isinstance(kind, T.ArrayType):
            return F.array_join(F.col(name).cast("array<string>"), items).alias(name)
        if isinstance(kind, T.MapType):
            entries = F.map_entries(F.col(name).cast("map<string,string>"))
            return F.array_join(
                F.transform(entries, lambda e: F.concat(e["key"], F.lit(keys), e["value"])), items
            ).alias(name)
        return F.col(name)

    return df.select(*[pack(f.name, f.dataType) for f in df.schema])


def unpack_collections(df: DataFrame, schema: T.StructType, items: str = ",", keys: str = ":") -> DataFrame:
    """Inverse of :func:`pack_collections`, back to the given schema."""

    def unpack(name: str, kind: T.DataType):
        text = F.col(name)
        if isinstance(kind, T.ArrayType):
            return F.split(text, f"[{items}]").cast(kind).alias(name)
        if isinstance(kind, T.MapType):
            return F.str_to_map(text, F.lit(f"[{items}]"), F.lit(f"[{keys}]")).cast(kind).alias(name)
        return text.cast(kind).alias(name)

    return df.select(*[unpack(f.name, f.dataType) for f in schema])
