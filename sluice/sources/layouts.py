"""Partition layouts derived from a time column.

A layout says which text partition columns a table gets, and it can turn a partition
spec back into a range on the time column. The range reaches the parquet scan, where
row-group statistics apply; the derived columns alone could not be pushed down.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.model import PartitionSpec

_EXPRESSIONS = {
    "yyyy": lambda c: F.lpad(F.year(c).cast("string"), 4, "0"),
    "MM": lambda c: F.lpad(F.month(c).cast("string"), 2, "0"),
    "yyyy-MM": lambda c: F.substring(F.to_date(c).cast("string"), 1, 7),
    "yyyy-MM-dd": lambda c: F.to_date(c).cast("string"),
    "HH": lambda c: F.lpad(F.hour(c).cast("string"), 2, "0"),
}

# Up to this many ranges are one filter; more are one range around them all, and the text.
RANGE_LIMIT = 64

_PARSE = {4: "%Y", 7: "%Y-%m", 10: "%Y-%m-%d", 13: "%Y-%m-%d %H"}


@dataclass(frozen=True)
class TimeLevel:
    """One partition column: its name, its pattern, and what joins it to the level above."""

    name: str
    pattern: str
    joiner: str = ""


@dataclass(frozen=True)
class Layout:
    """Text partition columns of a table, derived from one time column."""

    time_column: str
    levels: tuple[TimeLevel, ...]

    @property
    def columns(self) -> list[str]:
        return [level.name for level in self.levels]

    def apply(self, df: DataFrame) -> DataFrame:
        """Add the partition columns, last in the schema."""
        source = F.col(self.time_column)
        return df.select(
            "*", *[_EXPRESSIONS[level.pattern](source).alias(level.name) for level in self.levels]
        )

    def time_range(self, spec: PartitionSpec) -> tuple[datetime, datetime] | None:
        """``[start, end)`` of a spec that binds the first level or levels only; else None."""
        text = ""
        bound = [level for level in self.levels if level.name in spec]
        if len(bound) != len(spec) or bound != list(self.levels[: len(bound)]):
            return None
        for level in bound:
            text += level.joiner + str(spec[level.name])
        if len(text) not in _PARSE:
            return None
        try:
            start = datetime.strptime(text, _PARSE[len(text)])
        except ValueError:
            return None
        if start.year >= 9999:
            return None
        if len(text) == 4:
            end = start.replace(year=start.year + 1)
        elif len(text) == 7:
            end = (start.replace(day=1) + timedelta(days=32)).replace(day=1)
        elif len(text) == 10:
            end = start + timedelta(days=1)
        else:
            end = start + timedelta(hours=1)
        return start, end

    def time_filter(self, specs: Sequence[PartitionSpec]) -> Column | None:
        """The specs as ranges on the time column, exactly; None where that cannot be done.

        Touching ranges are merged. Plain comparisons reach the parquet scan and replace
        the text columns in the filter.
        """
        ranges = [self.time_range(spec) for spec in specs]
        if not ranges or any(r is None for r in ranges):
            return None
        merged: list[list[datetime]] = []
        for start, end in sorted(ranges):
            if merged and start <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], end)
            else:
                merged.append([start, end])
        if len(merged) > RANGE_LIMIT:
            return None
        return functools.reduce(lambda a, b: a | b, [self._within(start, end) for start, end in merged])

    def time_bounds(self, specs: Sequence[PartitionSpec]) -> Column | None:
        """One range around all specs, to prune a scan by; None where a spec has no range."""
        ranges = [self.time_range(spec) for spec in specs]
        if not ranges or any(r is None for r in ranges):
            return None
        return self._within(min(start for start, _ in ranges), max(end for _, end in ranges))

    def _within(self, start: datetime, end: datetime) -> Column:
        source = F.col(self.time_column)
        low, high = (F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz") for t in (start, end))
        return (source >= low) & (source < high)


SHIP_MONTH = Layout("l_shipdate", (TimeLevel("ship_year", "yyyy"), TimeLevel("ship_month", "MM", "-")))
EVENT_HOUR = Layout("ts", (TimeLevel("day", "yyyy-MM-dd"), TimeLevel("hour", "HH", " ")))
EVENT_DAY = Layout("ts", (TimeLevel("day", "yyyy-MM-dd"),))
ORDER_MONTH = Layout("o_orderdate", (TimeLevel("order_month", "yyyy-MM"),))
