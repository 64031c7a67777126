"""Path and partition-name expressions. All stay inside JVM codegen."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LOCATION_VARIABLE = "$LOCATION"

# Folder name of a null partition value, and the characters that partition
# folder names escape as %XX (control characters 1-31 and 127 come on top).
NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
ESCAPED_CHARACTERS = "\"#%'*/:=?\\{[]^"

# Types whose literals need no quotes.
BARE_TYPES = ("tinyint", "smallint", "int", "integer", "bigint", "float", "double", "boolean")


# The spelling of URIs, location texts and request texts below is fixed by the data they
# must be able to read.


def strip_authority(path: Column) -> Column:
    """Drop ``hdfs://authority``."""
    return F.regexp_replace(path, "^(hdfs://)[^/]*", "")


def parent(path: Column) -> Column:
    """Drop the last path element."""
    return F.regexp_replace(path, "/[^/]*$", "")


def to_location_variable(path: Column) -> Column:
    """A path that does not depend on where the copy is kept."""
    return F.concat(F.lit(LOCATION_VARIABLE), strip_authority(path))


def from_location_variable(text: Column, base: str = "") -> Column:
    """Put a base URI (or nothing) where the location variable stands."""
    return F.replace(text, F.lit(LOCATION_VARIABLE), F.lit(base))


def storage_uri(path: Column, scheme: str, bucket: str) -> Column:
    """``scheme://bucket`` plus the relative path. Credentials never go into a URI."""
    return F.concat(F.lit(f"{scheme}://{bucket}"), strip_authority(path))


def path_below(path: Column, base: str | Column, include_base: bool = False) -> Column:
    """The part of a path below a base folder, with or without the base's own name."""
    start = F.lit(base) if isinstance(base, str) else base
    if include_base:
        start = parent(start)
    return F.substr(path, F.length(start) + 2)


def is_below(path: Column, base: str | Column) -> Column:
    """True for a path that lies at or below a base folder."""
    start = F.lit(base) if isinstance(base, str) else base
    return (path == start) | F.startswith(path, F.concat(start, F.lit("/")))


def first_level_dir(path: Column, base: str) -> Column:
    """The base plus the first path element below it."""
    return F.concat(F.lit(base), F.regexp_extract(path_suffix(path, base), "^/[^/]*", 0))


def path_suffix(path: Column, base: str) -> Column:
    """What follows a base prefix, leading slash kept; the whole path when not below it."""
    return F.when(F.startswith(path, F.lit(base)), F.substr(path, F.lit(len(base) + 1))).otherwise(path)


def escape_value(value: Column) -> Column:
    """A partition value as it is spelled in a folder name.

    A lookup per character, so that the expression stays small: it is repeated wherever
    the optimizer puts a partition name into a filter.
    """
    text = value.cast("string")
    codes = [ord(c) for c in ESCAPED_CHARACTERS] + [*range(1, 32), 127]
    table = json.dumps({chr(code): f"%{code:02X}" for code in codes})
    escaped = F.from_json(F.lit(table), "map<string,string>")
    spelled = F.array_join(
        F.transform(F.split(text, ""), lambda char: F.coalesce(F.try_element_at(escaped, char), char)), ""
    )
    return F.when(text.isNull() | (text == ""), F.lit(NULL_PARTITION)).otherwise(spelled)


def unescape_value(text: Column) -> Column:
    """Inverse of :func:`escape_value`."""
    decoded = F.url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))
    return F.when(text == NULL_PARTITION, F.lit(None).cast("string")).otherwise(decoded)


def partition_name(columns: Sequence[str]) -> Column:
    """``a=1/b=2`` from the partition columns of a row."""
    return F.concat_ws("/", *[F.concat(F.lit(f"{c}="), escape_value(F.col(c))) for c in columns])


def partition_pairs(name: Column) -> Column:
    """``a=1/b=2`` as ordered ``(column, value)`` pairs; everything after the first ``=`` is value."""
    return F.transform(
        F.split(name, "/"),
        lambda item: F.struct(
            F.substring_index(item, "=", 1).alias("column"),
            unescape_value(F.substr(item, F.instr(item, "=") + F.lit(1))).alias("value"),
        ),
    )


def partition_map(name: Column) -> Column:
    """``a=1/b=2`` as a map."""
    return F.map_from_entries(partition_pairs(name))


def partition_value(name: Column, column: str) -> Column:
    """One partition column's value out of a path or partition name; null when absent."""
    raw = F.regexp_extract(name, f"(?:^|/){re.escape(column)}=([^/]*)", 1)
    return F.when(raw != "", unescape_value(raw))


def spec_text(
    pairs: Column, types: Mapping[str, str], separator: str = ", ", quoted: bool = False
) -> Column:
    """Pairs as a statement's partition spec; numbers and null stand bare, the rest in quotes.

    ``quoted`` puts the names in backquotes. A column that the table does not have raises an
    error.
    """
    tick = F.lit("`" if quoted else "")
    type_of = F.create_map(*[F.lit(x) for name, t in types.items() for x in (name.lower(), t.lower())])

    def render(pair: Column) -> Column:
        kind = F.try_element_at(type_of, F.lower(pair["column"]))
        escaped = F.regexp_replace(pair["value"], r"(['\\])", r"\\$1")
        name = F.concat(tick, pair["column"], tick)
        return (
            F.when(
                kind.isNull(),
                F.raise_error(F.concat(F.lit("invalid column: "), pair["column"])).cast("string"),
            )
            .when(pair["value"].isNull(), F.concat(name, F.lit("=null")))
            .when(
                kind.isin(*BARE_TYPES) | F.startswith(kind, F.lit("decimal")),
                F.concat(name, F.lit("="), pair["value"]),
            )
            .otherwise(F.concat(name, F.lit("='"), escaped, F.lit("'")))
        )

    return F.array_join(F.transform(pairs, render), separator)


def column_list(pairs: Column) -> Column:
    """Pairs as a column list, ``(day, hour)``."""
    return F.concat(F.lit("("), F.array_join(F.transform(pairs, lambda p: p["column"]), ", "), F.lit(")"))


def csv_items(text: Column) -> Column:
    """A comma-separated setting as trimmed items."""
    return F.transform(F.split(text, ","), lambda item: F.trim(item))


def request_table(text: Column) -> Column:
    """``db.table`` of a request text ``db.table (a='1', b=2) (a='3')``; null if it has none."""
    name = F.rtrim(F.substring_index(text, "(", 1))
    return F.when(F.contains(name, F.lit(".")) & ~F.contains(name, F.lit(" ")), name)


def request_specs(text: Column) -> Column:
    """The bracketed specs of a request text, one map each."""

    def pair(item: Column) -> Column:
        value = F.trim(F.substr(item, F.instr(item, "=") + F.lit(1)))
        return F.struct(F.trim(F.substring_index(item, "=", 1)), F.regexp_replace(value, "^'|'$", ""))

    groups = F.regexp_extract_all(text, F.lit(r"\((.*?)\)"), 1)
    return F.transform(groups, lambda g: F.map_from_entries(F.transform(F.split(g, ","), pair)))
