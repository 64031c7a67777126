"""Key/value tags kept as ``map<string,string>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tag_equals(tags: Column, key: str, value: str) -> Column:
    """False (not null) for a missing key."""
    return F.coalesce(F.try_element_at(tags, F.lit(key)) == value, F.lit(False))


def tags_with_prefix(tags: Column, prefix: str) -> Column:
    """Tags whose key has the prefix, with the prefix taken off."""
    kept = F.map_filter(tags, lambda k, v: F.startswith(k, F.lit(prefix)))
    return F.transform_keys(kept, lambda k, v: F.substr(k, F.lit(len(prefix) + 1)))


def set_tag(tags: Column, key: str, value: str | Column) -> Column:
    new = F.lit(value) if isinstance(value, str) else value
    return F.map_concat(remove_tag(tags, key), F.create_map(F.lit(key), new))


def remove_tag(tags: Column, key: str) -> Column:
    return F.map_filter(tags, lambda k, v: k != key)
