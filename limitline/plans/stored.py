"""Rule months kept as a stored table that new payments change in a few months only."""

from __future__ import annotations

from pyspark.sql import DataFrame

from limitline.sources.versions import VersionedTable

USER = "user_profile_id"
MONTH = "month_rule_hit"


def store_months(table: VersionedTable, months: DataFrame) -> DataFrame:
    """Create or replace a table of rule months, one folder per month."""
    return table.replace(months, by=MONTH)


def refresh_months(table: VersionedTable, months: DataFrame, customers: DataFrame) -> list:
    """Bring the stored months up to date for some customers; returns the months rewritten.

    ``customers`` holds the ids whose payments changed, ``months`` their rule months now. Only
    months that gain or lose a row are written, with the rows of all other customers in
    them taken over; every other month keeps its files. The list of months is short,
    whatever the number of customers.
    """
    ids = customers.select(USER).distinct()
    stored = table.read()
    before = stored.join(ids, USER, "left_semi").select(*stored.columns)
    now = months.join(ids, USER, "left_semi").select(*stored.columns)
    changed = before.exceptAll(now).union(now.exceptAll(before))
    touched = [row[0] for row in changed.select(MONTH).distinct().collect()]
    if touched:
        others = table.read(parts=touched).join(ids, USER, "left_anti").select(*stored.columns)
        table.replace_parts(others.union(now.where(now[MONTH].isin(touched))), touched)
    return touched
