"""Names and values as they are spelled in statements."""

from __future__ import annotations

import re
from collections.abc import Mapping


def quoted_name(name: str) -> str:
    """``db.table`` with each part in backquotes; parts that have them already stay."""
    parts = re.findall(r"`[^`]*`|[^.`]+", name)
    return ".".join(part if part.startswith("`") else f"`{part}`" for part in parts)


def literal(value) -> str:
    """A value as SQL text; everything but numbers and null is quoted."""
    if value is None:
        return "null"
    if isinstance(value, (bool, int, float)):
        return str(value)
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def partition_clause(values: Mapping) -> str:
    """``PARTITION (`a`='x', `b`=2)``."""
    return "PARTITION (" + ", ".join(f"`{c}`={literal(v)}" for c, v in values.items()) + ")"
