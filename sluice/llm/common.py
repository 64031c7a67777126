"""Helpers that the operators share."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.session import drop_folders, handed_out

#: White space as the word patterns see it, for the trim and for the split.
SPACES = " \t\n\x0b\x0c\r"
SPACE_RUN = r"[\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, whatever the optimizer merges."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is; texts of ASCII alone take the plain function."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, UPPER.lower())
    )


def split_words(text: Column, separators: str = SPACE_RUN, trim: str = SPACES) -> Column:
    """Words between runs of separators; ``trim`` lists the single separators to strip."""
    core = F.btrim(text, F.lit(trim))
    return let(
        core, lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, separators))
    )


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete shuffle files of steps that are written and done.

    The cleaner acts when the driver's collector finds their plans unused, which on an
    idle driver may take long while the disks of the executors fill.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def discard(frame: DataFrame) -> None:
    """Delete the scratch tables that ``frame`` reads; nothing else may still read them."""
    names = {part for file in frame.inputFiles() for part in file.split("/")}
    drop_folders(frame.sparkSession, [f for f in handed_out() if f.rpartition("/")[2] in names])


def free_name(frame: DataFrame, wish: str) -> str:
    """A column name that ``frame`` does not have yet."""
    taken = {c.lower() for c in frame.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish
