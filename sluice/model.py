"""What a copy run is asked to do: table requests, the policy, and row schemas."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import types as T

# A partition spec binds some or all partition columns; values are always text.
PartitionSpec = Mapping[str, str]

SUMMARY_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("bytes", T.LongType()),
        T.StructField("files", T.LongType()),
        T.StructField("partitions", T.LongType()),
        T.StructField("error", T.StringType()),
    ]
)

LEDGER_SCHEMA = T.StructType(
    [
        T.StructField("item", T.StringType()),
        T.StructField("state", T.StringType()),
        T.StructField("updated", T.TimestampNTZType()),
        T.StructField("seconds", T.LongType()),
        T.StructField("message", T.StringType()),
        # Of the lease under which the state was written; none without a lease.
        T.StructField("token", T.LongType()),
    ]
)

LOG_SCHEMA = T.StructType(
    [
        T.StructField("written_at", T.StringType()),
        T.StructField("block", T.StringType()),
        T.StructField("writer", T.StringType()),
        T.StructField("ordinal", T.IntegerType()),
        T.StructField("item", T.StringType()),
        T.StructField("statement", T.StringType()),
        T.StructField("data_type", T.StringType()),
    ]
)

# Ledger states.
TODO, FINISHED, FAILED, INVALID = "todo", "finished", "failed", "invalid"

# Copy modes.
FULL, SAMPLE = "full", "sample"


class UnresolvedRequest(ValueError):
    """A request that names no known table or selects no partition."""


@dataclass(frozen=True)
class TableSpec:
    """One requested table."""

    name: str
    sample_prob: float | None = None
    sample_size: int | None = None
    partitions: tuple[PartitionSpec, ...] = ()
    partition_count: int | None = None
    top_level_count: int | None = None
    skip_cleanup: bool = False


@dataclass(frozen=True)
class CopyPolicy:
    """Defaults that apply to every table of a run.

    The default values equal the shipped configuration of the tool this library
    matches; they are fixed values: probability 0.01, no partition limit (-1),
    threshold 500,000,000 bytes, overwrite on, one table at a time.

    ``byte_copy`` makes full copies of laid-out tables move files instead of rows; every
    executor then needs access to both storages outside of Spark's own readers. With
    ``footer_sizes`` flat parquet tables are listed and sized by their files' footers, under the
    same condition, and not by the widths of their rows. A run that gave no sign for
    ``lease_seconds`` may be overtaken by another one. The ledger and the log are compacted after a
    run that leaves more than ``compact_after`` appended folders in them. With
    ``same_request_only`` a copy by another request is an error even if overwriting is on.
    """

    default_prob: float = 0.01
    default_size: int | None = None
    default_partition_count: int = -1
    sample_threshold: int = 500_000_000
    overwrite_if_exists: bool = True
    table_parallelism: int = 1
    byte_copy: bool = False
    footer_sizes: bool = False
    sample_keys: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    sample_method: str = "md5"
    lease_seconds: float = 300
    compact_after: int = 1000
    same_request_only: bool = False

    def partition_count(self, spec: TableSpec) -> int:
        """The table's own cap when set, the default otherwise; <= 0 is no cap."""
        return self.default_partition_count if spec.partition_count is None else spec.partition_count
