"""When a limit is hit: first date, first month, preconditions, eligibility."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitline.config import LimitConfig
from limitline.functions.rules import eligible, listed
from limitline.functions.time import at, month_of

ENTITLEMENT_HIT_KEYS = ("risk_level", "user_profile_id", "source_currency")
MONITORING_HIT_KEYS = (
    "risk_level", "user_profile_id", "source_currency", "product_type",
    "has_us_address", "tw_ltd_customer",
)
CUSTOMER_KEYS = ("risk_level", "user_profile_id")


def single_payment_hit(payments: DataFrame, config: LimitConfig = LimitConfig()) -> DataFrame:
    """First month with one payment at or over the limit, per customer."""
    return (
        payments.filter(
            (F.col("invoice_value_eur") >= config.limit)
            & listed("source_currency", config.currencies)
        )
        .groupBy("risk_level", F.col("user_profile_id").alias("profile_id"))
        .agg(month_of(F.min("action_creation_time")).alias("date_limit_reached"))
    )


def limit_date(
    volumes: DataFrame,
    column: str,
    keys: Sequence[str] = ENTITLEMENT_HIT_KEYS,
    limit: int = LimitConfig().limit,
) -> DataFrame:
    """First ``refdate`` with the volume at or over the limit."""
    return (
        volumes.filter(F.col(column) >= limit)
        .groupBy(*keys)
        .agg(F.min("refdate").alias("dateoflimit"))
    )


def _first_months(dates: DataFrame) -> DataFrame:
    return dates.groupBy(*CUSTOMER_KEYS).agg(month_of(F.min("dateoflimit")).alias("month_rule_hit"))


def cutoffs(
    verified: DataFrame, products: DataFrame, config: LimitConfig = LimitConfig()
) -> tuple[DataFrame, DataFrame]:
    """Latest date a limit may be hit, per customer and precondition table.

    A hit counts if any row of the customer allows it, so the latest cut-off decides
    and repeated rows collapse before the join.
    """
    default = at(config.default_cutoff)
    by_verification = verified.groupBy("user_profile_id").agg(
        F.max(F.coalesce("dateoflimit", default)).alias("verification_cutoff")
    )
    by_product = products.groupBy(F.col("profile_id").alias("user_profile_id")).agg(
        F.max(
            F.least(
                F.coalesce("account_details_order_time", default),
                F.coalesce("card_order_time", default),
            )
        ).alias("product_cutoff")
    )
    return by_verification, by_product


def apply_preconditions(
    dates: DataFrame,
    verified: DataFrame,
    products: DataFrame,
    config: LimitConfig = LimitConfig(),
) -> DataFrame:
    """Keep hits on or before the customer's cut-offs (the default where it has none)."""
    by_verification, by_product = cutoffs(verified, products, config)
    default = at(config.default_cutoff)
    return (
        dates.join(by_verification, "user_profile_id", "left")
        .join(by_product, "user_profile_id", "left")
        .filter(
            (F.col("dateoflimit") <= F.coalesce("verification_cutoff", default))
            & (F.col("dateoflimit") <= F.coalesce("product_cutoff", default))
        )
        .select(*dates.columns)
    )


def month_hit(
    dates: DataFrame,
    config: LimitConfig = LimitConfig(),
    verified: DataFrame | None = None,
    products: DataFrame | None = None,
) -> DataFrame:
    """First month a rule is hit per customer, in the listed currencies.

    With the two precondition tables, only hits up to the customer's cut-offs count.
    """
    counted = dates.filter(listed("source_currency", config.currencies))
    if verified is not None and products is not None:
        counted = apply_preconditions(counted, verified, products, config)
    return _first_months(counted)


def month_hit_eligible(dates: DataFrame, config: LimitConfig = LimitConfig()) -> DataFrame:
    """First month a monitored rule is hit by an eligible payment, per customer."""
    return _first_months(dates.filter(eligible(config)))
