"""What changed at a source since a copy was made, partition by partition.

A partition of a laid-out table is told by its files: their number, names, lengths and times, summed
up as hashes, so that the order of the listing does not matter. A table that is not laid out is
told by its files as a whole first; only if these changed, the rows of each partition are
summed up as hashes, once as the source has them now and once as the copy holds them.
"""

from __future__ import annotations

import hashlib
import types
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.functions import fingerprints, paths

ADDED, CHANGED, GONE = "added", "changed", "gone"


def row_fingerprints(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``name, fingerprint`` of every partition that has rows; combined before the shuffle."""
    data = T.StructType(sorted((f for f in rows.schema if f.name not in columns), key=lambda f: f.name))
    texts = [F.when(F.col(f"`{c}`").cast("string") != "", F.col(f"`{c}`")).alias(c) for c in columns]
    return (
        rows.groupBy(*texts)
        .agg(fingerprints.of_rows(data).alias("fingerprint"))
        .select(paths.partition_name(list(columns)).alias("name"), "fingerprint")
    )


def source_files(frame: DataFrame) -> str | None:
    """One fingerprint of all files that a frame reads, without reading a column of them.

    None for a frame that is no scan of files.
    """
    try:
        names = frame.select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_size").alias("length"),
            F.col("_metadata.file_modification_time").alias("modified"),
        )
    except AnalysisException:
        return None
    return names.distinct().agg(fingerprints.of_files().alias("all")).first()["all"]


def partition_changes(source: DataFrame, taken: DataFrame) -> DataFrame:
    """``name, change`` of what differs between two lists of ``name, fingerprint``.

    A partition of which nothing is known on one side counts as changed.
    """
    now = source.select("name", F.col("fingerprint").alias("now"), F.lit(True).alias("here"))
    then = taken.select("name", F.col("fingerprint").alias("then"), F.lit(True).alias("there"))
    change = (
        F.when(F.col("there").isNull(), ADDED)
        .when(F.col("here").isNull(), GONE)
        .when(~F.coalesce(F.col("now") == F.col("then"), F.lit(False)), CHANGED)
    )
    return now.join(then, "name", "full_outer").select("name", change.alias("change")).where("change IS NOT NULL")


def changed_rows(source: DataFrame, copied: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``name`` of the partitions whose rows differ between a source and its copy, on either side."""
    found = partition_changes(row_fingerprints(source, columns), row_fingerprints(copied, columns))
    return found.select("name")


# --- identity of callables ------------------------------------------------------------------


def identity(hook: Callable) -> str:
    """What a hook does, as text that is the same in every run of the same program.

    A ``version`` attribute speaks for itself; otherwise the code counts, with its constants, its
    defaults and the plain values and functions it closes over.
    """
    name = f"{getattr(hook, '__module__', '')}.{getattr(hook, '__qualname__', type(hook).__qualname__)}"
    version = getattr(hook, "version", None)
    if version is not None:
        return f"{name}@{version}"
    return f"{name}#{hashlib.sha256(repr(_content(hook, 0)).encode()).hexdigest()[:16]}"


def _content(value, depth: int):
    if value is None or isinstance(value, (bool, int, float, complex, str, bytes)):
        return value
    if depth > 8:
        return type(value).__qualname__
    if isinstance(value, (tuple, list)):
        return [_content(v, depth + 1) for v in value]
    if isinstance(value, (set, frozenset)):
        return sorted(repr(_content(v, depth + 1)) for v in value)
    if isinstance(value, dict):
        return sorted((repr(k), repr(_content(v, depth + 1))) for k, v in value.items())
    if isinstance(value, types.CodeType):
        return [value.co_code.hex(), value.co_names, [_content(c, depth + 1) for c in value.co_consts]]
    if isinstance(value, types.FunctionType):
        cells = [_content(_cell(c), depth + 1) for c in value.__closure__ or ()]
        return [_content(value.__code__, depth + 1), _content(value.__defaults__, depth + 1), cells]
    if isinstance(value, types.MethodType):
        return [_content(value.__func__, depth + 1), _content(value.__self__, depth + 1)]
    call = getattr(type(value), "__call__", None)
    if isinstance(call, types.FunctionType):
        return [type(value).__qualname__, _content(call, depth + 1), _content(vars(value), depth + 1)]
    if hasattr(value, "func") and hasattr(value, "args"):  # a partial
        return [_content(value.func, depth + 1), _content(value.args, depth + 1), _content(value.keywords, depth + 1)]
    return type(value).__qualname__


def _cell(cell):
    try:
        return cell.cell_contents
    except ValueError:  # not filled yet
        return None
