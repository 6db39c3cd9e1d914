"""The two payment datasets every rule is computed from."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limitline.config import AMOUNT_TYPE, EUR_TYPE, LimitConfig, SkewPolicy
from limitline.functions.rules import listed, text_list
from limitline.functions.time import at
from limitline.operators.rates import count_eur_rates, to_eur_rates
from limitline.operators.skew import HotKeys, broadcast_if_small, hot_keys, skew_join
from limitline.sources.schemas import DAY
from limitline.sources.tables import Sources

FACT_KEYS = ("user_profile_id", "request_id")


def stored_day(payments: DataFrame) -> list[str]:
    return [DAY] if DAY in payments.columns else []


def unique_payments(src: Sources, products: Sequence[str]) -> DataFrame:
    """Payments that count once, of the given products."""
    return src.report_action_step.filter(
        F.col("flag_for_aggregations") & listed("product_type", products)
    )


def in_eur(
    payments: DataFrame, src: Sources, config: LimitConfig, policy: SkewPolicy, since: datetime | None = None
) -> DataFrame:
    """Replace the local amount by its EUR value; drop payments without one.

    The rates hold one row per currency and day, however many payments there are. They
    are broadcast once a count of the quotes proves them small, otherwise the join shuffles.
    Payments stored by day (``payment_day``) are joined on that column: then days without
    a rate, and those before ``since``, are not read at all.
    """
    quotes = src.daily_aggregated_rates
    rates = to_eur_rates(quotes, config.eur_currency_id).filter(F.col("exch_rate").isNotNull())
    if since is not None:
        rates = rates.filter(F.col("currency_date") >= F.lit(since.date()))
    value = f"cast(cast(invoice_value_local as {AMOUNT_TYPE}) * exch_rate as {EUR_TYPE})"
    kept = [c for c in payments.columns if c not in ("invoice_value_local", DAY)]
    day = F.col(DAY) if DAY in payments.columns else F.to_date("action_creation_time")
    few = count_eur_rates(quotes, config.eur_currency_id)
    return (
        payments.filter("invoice_value_local is not null")
        .withColumn("currency_date", day)
        .join(broadcast_if_small(rates, few, policy), ["source_currency", "currency_date"])
        .selectExpr(*kept, f"{value} as invoice_value_eur")
    )


def counted_transfers(src: Sources, config: LimitConfig) -> DataFrame:
    """Transfers whose state counts towards the volumes, keyed by ``request_id``."""
    return src.transfer.filter(~listed("state", config.excluded_states)).selectExpr(
        "id as request_id", "target_recipient_id"
    )


def with_profile(
    payments: DataFrame,
    profiles: DataFrame,
    src: Sources,
    hot: HotKeys | Sequence,
    policy: SkewPolicy,
) -> DataFrame:
    """Keep the rows of the given profiles, with the risk level where a user has one."""
    sides = [(profiles, "inner"), (src.user_profile_risk_score_level, "left")]
    return skew_join(payments, "user_profile_id", sides, hot, policy)


def personal(config: LimitConfig) -> Column:
    return F.col("class") != config.business_class


def _hot(src: Sources, hot: Mapping[str, HotKeys | Sequence] | None, policy: SkewPolicy):
    return hot_keys(src.report_action_step, *FACT_KEYS, policy=policy) if hot is None else hot


def payments_entitlement(
    src: Sources,
    config: LimitConfig = LimitConfig(),
    policy: SkewPolicy = SkewPolicy(),
    hot: Mapping[str, HotKeys | Sequence] | None = None,
) -> DataFrame:
    """Unique personal send-money payments in EUR, with recipient and risk level."""
    hot = _hot(src, hot, policy)
    payments = unique_payments(src, [config.sendmoney]).filter(
        F.col("action_creation_time") >= at(config.entitlement_payments_since)
    )
    profiles = src.user_profile.filter(
        personal(config) & (F.col("date_created") >= at(config.entitlement_profiles_since))
    ).select(F.col("id").alias("user_profile_id"))
    valued = in_eur(
        payments.select(
            "user_profile_id", "request_id", "action_creation_time",
            "source_currency", "invoice_value_local", *stored_day(payments),
        ),
        src, config, policy, config.entitlement_payments_since,
    )
    counted = skew_join(
        valued, "request_id", [(counted_transfers(src, config), "inner")],
        hot["request_id"], policy,
    )
    return with_profile(counted, profiles, src, hot["user_profile_id"], policy).select(
        "user_profile_id", "request_id", "action_creation_time", "source_currency",
        "target_recipient_id", "risk_level", "invoice_value_eur",
    )


def payments_monitoring(
    src: Sources,
    config: LimitConfig = LimitConfig(),
    policy: SkewPolicy = SkewPolicy(),
    hot: Mapping[str, HotKeys | Sequence] | None = None,
) -> DataFrame:
    """Unique personal send-money and balance payments in EUR, with address flags.

    Only payments not before the first successful submit of their request count.
    """
    hot = _hot(src, hot, policy)
    submits = src.lookup_request_history.filter(
        F.col("first_success_submit_date") >= at(config.monitoring_submitted_since)
    ).select("request_id", "first_success_submit_date")

    other_entity = f"country_code in {text_list(config.other_entity_countries)}"
    addresses = src.user_profile_address.selectExpr(
        "id as address_id",
        f"coalesce(country_code = '{config.us_country}', false) as has_us_address",
        f"coalesce(not {other_entity}, false) as tw_ltd_customer",
    )
    profiles = (
        src.user_profile.filter(personal(config))
        .select(F.col("id").alias("user_profile_id"), "address_id")
        .join(addresses, "address_id", "left")
        .selectExpr(
            "user_profile_id",
            "coalesce(has_us_address, false) as has_us_address",
            "coalesce(tw_ltd_customer, false) as tw_ltd_customer",
        )
    )
    # A payment is not before its first submit, which is not before this date. Spark does
    # not derive that, so it is said here: older payments stay out of every shuffle.
    recent = unique_payments(src, [config.sendmoney, config.balance]).filter(
        F.col("action_creation_time") >= at(config.monitoring_submitted_since)
    )
    valued = in_eur(
        recent.select(
            "user_profile_id", "request_id", "action_creation_time",
            "source_currency", "product_type", "invoice_value_local", *stored_day(recent),
        ),
        src, config, policy, config.monitoring_submitted_since,
    )
    counted = skew_join(
        valued, "request_id", [(counted_transfers(src, config), "inner"), (submits, "inner")],
        hot["request_id"], policy,
    ).filter("action_creation_time >= first_success_submit_date")
    return with_profile(counted, profiles, src, hot["user_profile_id"], policy).select(
        "user_profile_id", "request_id", "action_creation_time", "source_currency",
        "product_type", "target_recipient_id", "risk_level", "invoice_value_eur",
        "has_us_address", "tw_ltd_customer",
    )
