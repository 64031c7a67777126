"""Time texts, durations and expiry rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# The two text formats and the extension rule.
SORTABLE_FORMAT = "yyyy-MMM-dd-HH-mm-ss"
READABLE_FORMAT = "dd/MMM/yyyy HH:mm:ss"
EXTENSION_DAYS = 3
LONGEST_EXTENSION_DAYS = 6


def sortable_text(ts: Column) -> Column:
    return F.date_format(ts, SORTABLE_FORMAT)


def readable_text(ts: Column) -> Column:
    return F.date_format(ts, READABLE_FORMAT)


def parse_sortable(text: Column) -> Column:
    """Null for a text that is not in the format."""
    return F.try_to_timestamp(text, F.lit(SORTABLE_FORMAT)).cast("timestamp_ntz")


def parse_readable(text: Column) -> Column:
    """Null for a text that is not in the format."""
    return F.try_to_timestamp(text, F.lit(READABLE_FORMAT)).cast("timestamp_ntz")


def from_epoch_millis(millis: Column) -> Column:
    return F.timestamp_millis(millis).cast("timestamp_ntz")


def utc_now() -> Column:
    """The query's start in UTC, without zone, whatever the session's zone is."""
    return F.convert_timezone(None, F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz"))


def elapsed_text(seconds: Column) -> Column:
    """Seconds as ``h:mm:ss``."""
    whole = seconds.cast("long")
    return F.format_string(
        "%d:%02d:%02d",
        F.floor(whole / 3600).cast("long"),
        F.floor((whole % 3600) / 60).cast("long"),
        whole % 60,
    )


def _moment(now: datetime | Column) -> Column:
    return now if isinstance(now, Column) else F.lit(now.isoformat(sep=" ")).cast("timestamp_ntz")


def is_expired(running: Column, expires: Column, now: datetime | Column) -> Column:
    """Running, and the expiry text is missing, unreadable or before now."""
    return running & F.coalesce(parse_readable(expires) < _moment(now), F.lit(True))


def extended_expiry(expires: Column, now: datetime | Column, reset: bool = False) -> Column:
    """Expiry (or now, if there is none) plus the extension; null when past the limit.

    An unreadable expiry cannot be extended and gives null too. ``reset`` starts again
    from now, whatever the expiry says.
    """
    current = F.when(expires.isNull() | F.lit(reset), _moment(now)).otherwise(parse_readable(expires))
    extended = current + F.expr(f"INTERVAL {EXTENSION_DAYS} DAYS")
    limit = _moment(now) + F.expr(f"INTERVAL {LONGEST_EXTENSION_DAYS} DAYS")
    return F.when(extended <= limit, extended)
