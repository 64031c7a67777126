"""Fingerprints of sets of files or rows: aggregates that do not depend on any order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _summed(hashed: Column) -> Column:
    """Hashes of any number of rows, in any order; repeated ones count."""
    return F.coalesce(F.sum(hashed.cast("decimal(20,0)")), F.lit(0)).cast("decimal(38,0)").cast("string")


def of_files() -> Column:
    """An aggregate over listed files (``file, length, modified``)."""
    return F.concat_ws(
        "-", F.count("*"), F.coalesce(F.sum("length"), F.lit(0)), _summed(F.xxhash64("file", "length", "modified"))
    )


def _hashable(column: Column, kind: T.DataType) -> Column:
    """Maps cannot be hashed: their entries in order of the keys can."""
    if isinstance(kind, T.MapType):
        return F.array_sort(F.map_entries(column)) if isinstance(kind.valueType, T.AtomicType) else F.to_json(column)
    if isinstance(kind, (T.ArrayType, T.StructType)) and "map<" in kind.simpleString():
        return F.to_json(column)
    return column


def of_rows(schema: T.StructType) -> Column:
    """An aggregate over rows. A null counts as what its column's place makes of it."""
    values = [_hashable(F.col(f"`{f.name}`"), f.dataType) for f in schema]
    marked = [part for value in values for part in (value.isNull(), value)]
    return F.concat_ws("-", F.count("*"), _summed(F.xxhash64(*marked)) if marked else F.lit("0"))
