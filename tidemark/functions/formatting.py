"""Numbers and rows as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed(value: Column, digits: int) -> Column:
    """A number with so many digits behind the point."""
    return F.format_string(f"%.{digits}f", F.round(value, digits))


def grouped(value: Column) -> Column:
    """A whole number with commas between its thousands."""
    return F.format_number(value, 0)


def percent(share: Column, digits: int = 2) -> Column:
    return F.concat(fixed(share * 100, digits), F.lit("%"))


def json(**columns: Column) -> Column:
    """A row as JSON text, nulls left out."""
    return F.to_json(F.struct(*[c.alias(name) for name, c in columns.items()]))
