"""The resumable ledger: an append-only table of item states, compacted to the last one of each."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice import storage
from sluice.functions import clock
from sluice.model import FAILED, FINISHED, INVALID, LEDGER_SCHEMA, TODO
from sluice.operators import compaction
from sluice.session import local_rows


def open_ledger(spark: SparkSession, path: str) -> DataFrame:
    """All ledger rows; an empty frame when there is no ledger yet."""
    if not storage.exists(spark, path):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return _read(spark, compaction.places(spark, path))


def _read(spark: SparkSession, folders: list[str]) -> DataFrame:
    return spark.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", "true").parquet(*folders)


def record(spark: SparkSession, path: str, rows: Sequence[tuple]) -> None:
    """Append ``(item, state, updated, seconds, message)`` rows, with the token of their lease if any.

    Each call writes a folder of its own. Jobs that append to one folder at the same
    time would share, and remove, each other's temporary output.
    """
    entry = f"{path}/entry-{uuid.uuid4().hex}"
    local_rows(spark, list(rows), LEDGER_SCHEMA).coalesce(1).write.parquet(entry)


def latest(ledger: DataFrame) -> DataFrame:
    """The last state per item: that of the highest token, so a run that was overtaken says no more.

    An aggregate, so an item with a long history is combined before the shuffle.
    """
    return _last(ledger).select("item", "updated", "state", "seconds", "message")


def _last(ledger: DataFrame) -> DataFrame:
    token = F.coalesce("token", F.lit(0)).alias("token")
    last = F.max(F.struct(token, "updated", "state", "seconds", "message")).alias("last")
    return ledger.groupBy("item").agg(last).select("item", "last.*")


def compact(spark: SparkSession, path: str, grace: float = compaction.GRACE_SECONDS) -> int:
    """Put the last state of each item into one snapshot; returns how many entries it takes in."""

    def write(rows: DataFrame, to: str) -> None:
        rows.select(LEDGER_SCHEMA.names).write.parquet(to)

    return compaction.compact(spark, path, lambda folders: _read(spark, folders), _last, write, grace)


def next_run(configured: DataFrame, ledger: DataFrame) -> DataFrame:
    """State and action per item at the start of a run.

    New, unfinished and failed items are attempted; finished and invalid ones carry over.
    Unfinished or failed items that are no longer configured drop out.
    """
    before = latest(ledger).select("item", F.col("state").alias("before"))
    wanted = configured.select("item").distinct().withColumn("configured", F.lit(True))
    joined = wanted.join(before, "item", "full_outer")
    carried = F.col("before").isin(FINISHED, INVALID)
    return joined.where(carried | F.col("configured")).select(
        "item",
        F.coalesce("before", F.lit("new")).alias("before"),
        F.when(carried, F.col("before")).otherwise(F.lit(TODO)).alias("state"),
        F.coalesce(~carried, F.lit(True)).alias("attempt"),
    )


def attempts(run: DataFrame) -> DataFrame:
    return run.where("attempt").select("item")


def report(ledger: DataFrame) -> DataFrame:
    """Items, total seconds and readable duration per state."""
    return (
        latest(ledger)
        .groupBy("state")
        .agg(F.count("*").alias("items"), F.coalesce(F.sum("seconds"), F.lit(0)).cast("long").alias("seconds"))
        .withColumn("elapsed", clock.elapsed_text(F.col("seconds")))
    )


def run_totals(ledger: DataFrame) -> DataFrame:
    """One row: successes, failures, invalid items and the total duration."""
    counts = latest(ledger).agg(
        F.count_if(F.col("state") == FINISHED).alias("success"),
        F.count_if(F.col("state") == FAILED).alias("failure"),
        F.count_if(F.col("state") == INVALID).alias("invalid"),
        F.coalesce(F.sum("seconds"), F.lit(0)).cast("long").alias("seconds"),
    )
    return counts.withColumn("elapsed", clock.elapsed_text(F.col("seconds")))


def now() -> datetime:
    """UTC, without zone."""
    return datetime.now(timezone.utc).replace(tzinfo=None)
