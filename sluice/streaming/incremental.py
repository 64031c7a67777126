"""Each run copies the files that arrived since the last one, exactly once, however old they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.operators.sample import bernoulli_sample


# The source would skip files much older than the newest one it has seen, such as those of
# copies that keep file times. Its log of seen files tells new ones, so age need not.
ANY_AGE = "36500d"


def stream_copy(
    spark: SparkSession,
    source_path: str,
    schema: T.StructType,
    columns: Sequence[str],
    target_path: str,
    checkpoint: str,
    p: float = 1.0,
    keys: Sequence[str] = (),
    method: str = "md5",
    max_files_per_batch: int = 10_000,
    files_per_partition: int | None = None,
) -> None:
    """Copy (or sample) what is new below ``source_path`` and stop.

    The sample is a filter on key columns, so it has no state, needs no shuffle, and a
    retried batch keeps the same rows. The file sink's log makes each batch visible once.
    Batches are bounded by file count, so a first run over a large table is many
    restartable steps.

    A thin sample of many files leaves as many small ones. ``files_per_partition`` brings
    the sampled rows together by partition and a salt of the keys, so that even a
    partition with most of the rows is written by that many tasks.
    """
    if method == "rand" and p < 1:
        raise ValueError("a streamed sample must be repeatable: use md5 or xxhash64")
    arriving = (
        spark.readStream.schema(schema)
        .option("basePath", source_path)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .option("maxFileAge", ANY_AGE)
        .parquet(source_path)
    )
    rows = bernoulli_sample(arriving, p, keys, method)
    if files_per_partition and columns:
        salt = F.pmod(F.xxhash64(*(keys or rows.columns)), F.lit(files_per_partition))
        rows = rows.repartition(*columns, salt)
    writer = rows.writeStream.format("parquet")
    if columns:
        writer = writer.partitionBy(*columns)
    query = (
        writer.option("path", target_path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
