"""A stream of arriving files into a registered copy, which batch runs share.

The stream says only which partitions got files. Each micro-batch is a run over these partitions: it holds
the copy's lease, brings new partitions, puts changed ones in place of the old ones, and notes them in
the copy's record, the catalog and the log. What the record has by the same files is not
written again, so a batch that is replayed, a checkpoint that is lost, or a batch run in between
changes nothing and loses nothing.

A partition that files drip into is written again in each micro-batch that sees one. Where that is
too much, call it less often, with larger batches, or take ``incremental.stream_copy``, which appends the
rows of new files to a folder of its own.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from sluice.model import CopyPolicy, TableSpec
from sluice.operators.hooks import BeforeSample
from sluice.plans.run import RunTarget, copy_tables
from sluice.sources.tables import SourceTable, open_folder
from sluice.streaming.incremental import ANY_AGE


def stream_into_copy(
    spark: SparkSession,
    source: SourceTable,
    target: RunTarget,
    checkpoint: str,
    p: float = 1.0,
    policy: CopyPolicy = CopyPolicy(),
    before_sample: Sequence[BeforeSample] = (),
    max_files_per_batch: int = 1000,
) -> int:
    """Bring the copy up to date with what arrived at a laid-out source, and stop; returns the batches run.

    ``p`` below 1 is a sample whatever the size. A copy by another request is an error, and so is
    one that another run works on; the batch is then tried again by the next call. Names of a
    batch's partitions, at most one per file, go through the driver. Files without a row are not seen.
    """
    columns = list(source.partition_columns)
    if source.location is None or not columns or source.registered:
        raise ValueError(f"{source.name} is not a laid-out folder of partitions")
    if policy.sample_method == "rand" and p < 1:
        raise ValueError("a streamed sample must be repeatable: use md5 or xxhash64")
    policy = replace(policy, sample_threshold=0, overwrite_if_exists=True, same_request_only=True)
    # States of items would keep later batches from being tried.
    bound = replace(target, ledger=None)
    schema = source.frame.schema
    done = []

    def run(rows: DataFrame, _: int) -> None:
        arrived = [row.asDict() for row in rows.select(*columns).distinct().toLocalIterator()]
        if arrived:
            # Opened anew: the listing of an older frame does not have the files.
            now = open_folder(spark, source.name, source.location, schema, source.partition_columns, source.storage)
            spec = TableSpec(source.name, sample_prob=p, partitions=tuple(arrived))
            result = copy_tables(spark, {source.name: now}, [spec], bound, policy, before_sample)
            if result.errors:
                raise RuntimeError(result.errors[source.name])
        done.append(len(arrived))

    # Partition values as they are spelled.
    texts = T.StructType([T.StructField(f.name, T.StringType()) if f.name in columns else f for f in schema])
    query = (
        spark.readStream.schema(texts)
        .format(source.storage.source)
        .options(**source.storage.options)
        .option("basePath", source.location)
        .option("maxFilesPerTrigger", max_files_per_batch)
        .option("maxFileAge", ANY_AGE)
        .load(source.location)
        .writeStream.foreachBatch(run)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return len(done)
