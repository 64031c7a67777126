"""Callables that run around a copy.

``before_sample(DataFrame) -> DataFrame`` runs on the sampled rows before the write.
``after_copy(CopyContext)`` runs when a table's copy is complete.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from sluice.operators import copy
from sluice.sources.tables import SourceTable

BeforeSample = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class CopyContext:
    """What a hook sees of a finished copy."""

    spark: SparkSession
    source: SourceTable
    target: SourceTable
    mode: str


AfterCopy = Callable[[CopyContext], None]


def copy_side_files(pattern: str) -> AfterCopy:
    """A hook that also copies files beside the data, such as ``*.meta``."""

    def hook(context: CopyContext) -> None:
        if context.source.location is None or context.target.location is None:
            return
        report = copy.copy_files(context.spark, context.source.location, context.target.location, pattern)
        if not copy.incomplete(report).isEmpty():
            raise OSError(f"side files of {context.source.name} are incomplete")

    return hook
