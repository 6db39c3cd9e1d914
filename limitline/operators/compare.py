"""Rules set against each other: released customers and the comparison table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from limitline.config import LimitConfig
from limitline.functions.rules import eligible, listed, risk_volume
from limitline.functions.time import month_of
from limitline.operators.limits import (
    CUSTOMER_KEYS,
    ENTITLEMENT_HIT_KEYS,
    MONITORING_HIT_KEYS,
)

RULES = ("pgl", "lro", "lttw", "ltto")
REACHED = tuple(f"{rule}_reached_month" for rule in RULES)


def released_users(old: DataFrame, new: DataFrame) -> DataFrame:
    """Customers in ``old`` whose id is NOT IN the ids of ``new``.

    An anti join on the id scales where a null-aware one must broadcast; the NULL rules
    of NOT IN come from two scalar subqueries: a NULL in ``new`` releases nobody, and
    a NULL id in ``old`` is released only if ``new`` is empty.
    """
    ids = new.select("user_profile_id")
    has_null = ids.filter(F.col("user_profile_id").isNull()).exists()
    has_any = ids.exists()
    return (
        old.join(ids, "user_profile_id", "left_anti")
        .filter(~has_null & (F.col("user_profile_id").isNotNull() | ~has_any))
        .select("user_profile_id", "risk_level")
    )


def backtest_months(volumes: DataFrame, config: LimitConfig = LimitConfig()) -> DataFrame:
    """Old- and new-rule month per customer in one pass over the grouped volumes."""
    limit = config.limit

    def first_date(volume):
        return F.min(F.when(volume >= limit, F.col("refdate")))

    return (
        volumes.filter(listed("source_currency", config.currencies))
        .groupBy(*ENTITLEMENT_HIT_KEYS)
        .agg(
            first_date(F.col("lifetime_volume")).alias("old_date"),
            first_date(risk_volume(config)).alias("new_date"),
        )
        .groupBy(*CUSTOMER_KEYS)
        .agg(
            month_of(F.min("old_date")).alias("old_month"),
            month_of(F.min("new_date")).alias("new_month"),
        )
        .filter(F.col("old_month").isNotNull() | F.col("new_month").isNotNull())
    )


def released_from_months(months: DataFrame) -> DataFrame:
    """``released_users`` from ``backtest_months``: no second pass over the payments.

    The volumes come from an inner join on the customer id, so no id is NULL.
    """
    hit_new = F.count("new_month").over(Window.partitionBy("user_profile_id"))
    return (
        months.withColumn("hit_new", hit_new)
        .filter(F.col("old_month").isNotNull() & (F.col("hit_new") == 0))
        .select("user_profile_id", "risk_level")
    )


def compare_rules(pgl: DataFrame, lro: DataFrame, lttw: DataFrame, ltto: DataFrame) -> DataFrame:
    """One row per customer with the month each rule was reached.

    The customers are those of the first three tables; months are joined on the id
    alone, so a customer with two risk levels gets every combination of its months.
    """
    customers = (
        pgl.select(*CUSTOMER_KEYS)
        .union(lro.select(*CUSTOMER_KEYS))
        .union(lttw.select(*CUSTOMER_KEYS))
        .distinct()
    )
    table = customers
    for month, rule in zip(REACHED, (pgl, lro, lttw, ltto)):
        table = table.join(
            rule.select("user_profile_id", F.col("month_rule_hit").alias(month)),
            "user_profile_id",
            "left",
        )
    return table.select("user_profile_id", "risk_level", *REACHED)


def monitoring_months(volumes: DataFrame, config: LimitConfig = LimitConfig()) -> DataFrame:
    """Month of all four rules per (risk level, customer), from ``monitoring_volumes``."""
    rule_volumes = {
        "pgl": F.col("lifetime_volume"),
        "lro": F.col("same_recipient_volume"),
        "lttw": risk_volume(config, "linked_"),
        "ltto": risk_volume(config, "any_"),
    }
    first_dates = [
        F.min(F.when(volume >= config.limit, F.col("refdate"))).alias(rule)
        for rule, volume in rule_volumes.items()
    ]
    return (
        volumes.filter(eligible(config))
        .groupBy(*MONITORING_HIT_KEYS)
        .agg(*first_dates)
        .groupBy(*CUSTOMER_KEYS)
        .agg(*(month_of(F.min(rule)).alias(month) for rule, month in zip(RULES, REACHED)))
    )


def compare_months(months: DataFrame) -> DataFrame:
    """``compare_rules`` from ``monitoring_months``, without a join.

    Everything is already grouped by customer; the few months a customer has (one per
    risk level) are gathered and unfolded again per rule.
    """
    reached = F.col(REACHED[0]).isNotNull()
    for month in REACHED[1:3]:
        reached = reached | F.col(month).isNotNull()
    risk = F.struct("risk_level")
    table = months.groupBy("user_profile_id").agg(
        F.collect_list(F.when(reached, risk)).alias("risk"),
        *(F.collect_list(month).alias(month) for month in REACHED),
    )
    table = table.withColumn("risk", F.explode("risk"))
    for month in REACHED:
        table = table.withColumn(month, F.explode_outer(month))
    return table.select("user_profile_id", "risk.risk_level", *REACHED)


def rule_gap(comparison: DataFrame, column: str = "ltto_reached_month") -> DataFrame:
    """Customers that reached the rule of ``column`` but never the lifetime rule."""
    return comparison.filter(
        F.col(column).isNotNull() & F.col("pgl_reached_month").isNull()
    ).orderBy(F.col("user_profile_id").asc_nulls_last())


def rule_disagreement(comparison: DataFrame, rows: int = LimitConfig().disagreement_rows) -> DataFrame:
    """First customers whose lifetime month differs from both window rules."""
    pgl = F.col("pgl_reached_month")
    order = ["user_profile_id", "risk_level", *REACHED]
    return (
        comparison.filter(
            (pgl != F.col("lttw_reached_month")) & (pgl != F.col("ltto_reached_month"))
        )
        .orderBy(*(F.col(c).asc_nulls_last() for c in order))
        .limit(rows)
    )


def rule_counts(comparison: DataFrame) -> DataFrame:
    """Rows of the comparison table that reached each rule."""

    def reached(column: str):
        return F.count(F.when(F.col(column).isNotNull(), F.col("user_profile_id")))

    return comparison.agg(
        reached("ltto_reached_month").alias("customers_reached_only_time_window"),
        reached("lttw_reached_month").alias("customers_reached_time_window_and_same_recipient"),
        reached("pgl_reached_month").alias("customer_reached_personal_global_lifetime"),
    )
