"""Bernoulli samples, and the rule that decides between a full copy and a sample."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.model import FULL, SAMPLE, CopyPolicy, TableSpec
from sluice.session import local_rows

# Below this, 32 bits of a digest would be too coarse.
_SMALL = 2**-16


def threshold_hex(p: float) -> str:
    """Leading hex digits that a key's md5 must stay below; ``0 < p < 1``.

    Eight digits, or sixteen for a small ``p``. The kept rows of a smaller ``p`` are a
    subset of those of a larger one across both.
    """
    digits = 8 if p >= _SMALL else 16
    return f"{math.floor(p * 16**digits):0{digits}x}"


def sampled(p: float, keys: Sequence[str], method: str = "md5", seed: int = 0) -> Column:
    """Condition of a Bernoulli sample with probability ``p``.

    ``md5`` and ``xxhash64`` depend on the key columns only, so a retried task, another
    partitioning or a rerun keeps the same rows, and a smaller ``p`` keeps a subset.
    ``md5`` gives the same rows in any engine; ``xxhash64`` is several times cheaper.
    ``rand`` is ``rand() <= p`` and depends on how the input is partitioned.
    """
    if p >= 1:
        return F.lit(True)
    if p <= 0:
        return F.lit(False)
    if method == "rand":
        return F.rand(seed) <= p
    if not keys:
        raise ValueError("a repeatable sample needs key columns")
    if method == "md5":
        text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
        limit = threshold_hex(p)
        return F.substring(F.md5(text), 1, len(limit)) < limit
    if method == "xxhash64":
        return F.shiftrightunsigned(F.xxhash64(*keys), 1) < F.lit(math.floor(p * 2**63)).cast("long")
    raise ValueError(f"unknown sample method {method}")


def bernoulli_sample(
    df: DataFrame, p: float, keys: Sequence[str] = (), method: str = "md5", seed: int = 0
) -> DataFrame:
    """Filter partitions before this call: a ``rand`` condition blocks partition pruning."""
    return df.where(sampled(p, keys, method, seed))


def in_sigma_band(rows: Column, kept: Column, p: float, sigmas: float = 5.0) -> Column:
    """Whether a sample's size is within ``sigmas`` standard deviations (plus one row)."""
    return F.abs(kept - rows * p) <= sigmas * F.sqrt(rows * p * (1 - p)) + 1


_REQUEST_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("sample_prob", T.DoubleType()),
        T.StructField("sample_size", T.LongType()),
        T.StructField("partition_count", T.IntegerType()),
        T.StructField("skip_cleanup", T.BooleanType()),
    ]
)


def requests_frame(spark, specs: Sequence[TableSpec]) -> DataFrame:
    rows = [(s.name, s.sample_prob, s.sample_size, s.partition_count, s.skip_cleanup) for s in specs]
    return local_rows(spark, rows, _REQUEST_SCHEMA)


def resolve_policy(summary: DataFrame, requests: DataFrame, policy: CopyPolicy) -> DataFrame:
    """Probability, mode and cap per requested table.

    The first that is set counts: the table's size, the table's probability, the default
    size, the default probability. ``bytes`` is that of the selected partitions. A size
    target on 0 bytes gives an infinite probability, hence a full copy.
    """

    def share(size: Column) -> Column:
        return (
            F.when(size.isNull(), F.lit(None).cast("double"))
            .when(F.col("bytes") == 0, F.lit(float("inf")))
            .otherwise(size.cast("double") / F.when(F.col("bytes") != 0, F.col("bytes")))
        )

    default_size = F.lit(policy.default_size).cast("long")
    joined = requests.join(summary.select("name", "bytes", "error"), "name", "left")
    probability = F.coalesce(
        share(F.col("sample_size")),
        F.col("sample_prob"),
        share(default_size),
        F.lit(policy.default_prob).cast("double"),
    )
    error = (
        F.when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("bytes").isNull(), F.concat(F.lit("table not found: "), F.col("name")))
        .otherwise(F.lit(None).cast("string"))
    )
    whole = (F.col("probability") >= 1) | (F.col("bytes") <= policy.sample_threshold)
    return (
        joined.withColumn("problem", error)
        .withColumn("probability", F.when(F.col("problem").isNull(), probability))
        .select(
            "name",
            "bytes",
            "probability",
            F.when(F.col("problem").isNull(), F.when(whole, FULL).otherwise(SAMPLE)).alias("mode"),
            F.coalesce("partition_count", F.lit(policy.default_partition_count)).alias("partition_count"),
            "skip_cleanup",
            F.col("problem").alias("error"),
        )
    )
