"""Small reports and checks over the rule tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def count_by_month(
    hits: DataFrame,
    month: str = "month_rule_hit",
    user: str = "user_profile_id",
    since: date | None = None,
) -> DataFrame:
    """Customers per month and risk level, in that order, NULLs last."""
    rows = hits if since is None else hits.filter(F.col(month) >= F.lit(since))
    return (
        rows.groupBy(month, "risk_level")
        .agg(F.count(user).alias("customers"))
        .orderBy(F.col(month).asc_nulls_last(), F.col("risk_level").asc_nulls_last())
    )


def first_month(months: DataFrame) -> DataFrame:
    """Earliest month of a rule table."""
    return months.agg(F.min("month_rule_hit").alias("first_month"))


def ambiguous_users(months: DataFrame) -> DataFrame:
    """Customers with more than one risk level or month in a rule table."""
    return (
        months.groupBy("user_profile_id")
        .agg(
            F.count_distinct("risk_level").alias("cr"),
            F.count_distinct("month_rule_hit").alias("cm"),
        )
        .filter((F.col("cr") > 1) | (F.col("cm") > 1))
    )


def count_users(months: DataFrame) -> DataFrame:
    """Distinct customers of a rule table."""
    return months.agg(F.count_distinct("user_profile_id").alias("customers"))


def customer_total(payments: DataFrame, user: int) -> DataFrame:
    """GBP value of one customer's unique payments."""
    return payments.filter(
        (F.col("user_profile_id") == user) & F.col("flag_for_aggregations")
    ).agg(F.sum("invoice_value_gbp").alias("total_gbp"))


def preview(df: DataFrame, order: list[str], rows: int) -> DataFrame:
    """First rows under a total order, so that the preview is repeatable."""
    rest = [c for c in df.columns if c not in order]
    return df.orderBy(*(F.col(c).asc_nulls_last() for c in [*order, *rest])).limit(rows)
