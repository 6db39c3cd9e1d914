"""Timestamp helpers that do not depend on the session time zone."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

SECOND_US = 1_000_000
HOUR_US = 3_600 * SECOND_US
DAY_US = 24 * HOUR_US


def micros(column: str) -> Column:
    """Microseconds since 1970 of a ``timestamp_ntz`` column, as a long.

    ``unix_micros`` and ``timestampdiff`` convert through the session zone, which bends
    the distance between two timestamps at a daylight-saving change.
    """
    return F.expr(
        f"unix_date(to_date({column})) * {DAY_US}L"
        f" + (hour({column}) * 3600 + minute({column}) * 60) * {SECOND_US}L"
        f" + cast(extract(second from {column}) * {SECOND_US} as bigint)"
    )


def at(moment: datetime) -> Column:
    """A ``timestamp_ntz`` literal. ``lit(datetime)`` would be a zoned timestamp, which
    shifts the comparison by the session zone and keeps the filter out of the scan."""
    return F.expr(f"timestamp_ntz'{moment.isoformat(sep=' ')}'")


def month_of(column: str | Column) -> Column:
    """First day of the month, as a DATE."""
    return F.trunc(column, "month")


def floor_to(column: str, width: int) -> Column:
    """Largest multiple of ``width`` not above the column (exact on longs)."""
    return F.expr(f"({column}) - pmod({column}, {width}L)")
