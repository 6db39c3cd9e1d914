"""Whether tables hold one row per key, as the joins expect."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from limitline.sources.tables import Sources

GRAIN: dict[str, Sequence[str]] = {
    "daily_aggregated_rates": ("from_currency_id", "currency_date"),
    "user_profile_risk_score_level": ("user_profile_id",),
    "lookup_request_history": ("request_id",),
}


def repeated_keys(df: DataFrame, table: str, keys: Sequence[str]) -> DataFrame:
    """One row: how many keys are repeated, how many rows they hold, how many rows lack a key.

    Counts per key are summed map-side; a key with any number of rows is one counter.
    """
    lacking = " or ".join(f"{k} is null" for k in keys)
    per_key = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.expr(f"first({lacking}) as lacking"))
    return per_key.agg(
        F.lit(table).alias("table_name"),
        F.lit(", ".join(keys)).alias("grain"),
        F.expr("count_if(n > 1 and not lacking) as repeated_keys"),
        F.expr("coalesce(sum(if(n > 1 and not lacking, n, 0)), 0) as rows_of_them"),
        F.expr("coalesce(sum(if(lacking, n, 0)), 0) as rows_without_key"),
    )


def violations(src: Sources) -> DataFrame:
    """The grain of every table that is joined as if it had one row per key."""
    found = [repeated_keys(getattr(src, table), table, keys) for table, keys in GRAIN.items()]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def observed(df: DataFrame, name: str, keys: Sequence[str]) -> tuple[DataFrame, Observation]:
    """The table with counters of rows and of missing keys that ride along with whatever reads it."""
    watch = Observation(name)
    lacking = [F.expr(f"count_if({k} is null) as {k}_missing") for k in keys]
    return df.observe(watch, F.count(F.lit(1)).alias("rows"), *lacking), watch
