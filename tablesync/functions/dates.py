"""Date arithmetic, formatting and parsing over zone-free timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Default patterns.
DATE_PATTERN = "yyyy-MM-dd"
DATETIME_PATTERN = "yyyy-MM-dd HH:mm:ss"


def add_to_date(ts: Column, years: int = 0, months: int = 0, days: int = 0) -> Column:
    """Calendar addition; a day past the end of the target month becomes its last day."""
    moved = ts + F.make_ym_interval(F.lit(years), F.lit(months)) if years or months else ts
    return moved + F.make_dt_interval(F.lit(days)) if days else moved


def format_date(ts: Column, pattern: str = DATETIME_PATTERN) -> Column:
    return F.date_format(ts, pattern)


def parse_date(text: Column, pattern: str = DATETIME_PATTERN) -> Column:
    """Text by pattern, null where it does not fit."""
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")
