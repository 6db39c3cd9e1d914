"""What happens to suspension and fraud if customers are released.

Every rate counts distinct requests per month. Each input is first reduced to one row
per request (map-side, so copies collapse before the shuffle); the distinct counts
then become plain sums of 0/1 flags. The released requests are shuffled once; a Bloom
filter of their ids keeps the scores of all other requests out of the shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from limitline.config import LimitConfig, SkewPolicy
from limitline.functions.time import at, month_of
from limitline.operators.keyfilter import key_filter, possibly_in
from limitline.operators.skew import HotKeys, hot_keys, skew_join

MONTH = "transaction_creation_month"


def _any(condition: Column) -> Column:
    return F.max(F.coalesce(condition, F.lit(False)).cast("int"))


def _released_requests(
    users: DataFrame,
    transfers: DataFrame,
    flags: dict[str, Column],
    hot: HotKeys | Sequence | None,
    policy: SkewPolicy,
) -> DataFrame:
    """One row per request of the released customers: request_id and facts, its distinct
    months and 0/1 flags. One exchange by request, which every later step keeps."""
    if hot is None:
        hot = hot_keys(transfers, "user_profile_id", policy=policy)["user_profile_id"]
    ids = users.select("user_profile_id").distinct()
    released = skew_join(transfers, "user_profile_id", [(ids, "left_semi")], hot, policy)
    fact = F.struct(
        month_of("action_creation_time").alias(MONTH),
        *(F.coalesce(c, F.lit(False)).cast("int").alias(name) for name, c in flags.items()),
    )
    return released.groupBy("request_id").agg(F.collect_set(fact).alias("facts"))


def _by_month(requests: DataFrame, flags: Sequence[str], *known: DataFrame) -> DataFrame:
    """One row per request and month, with its flags and what ``known`` tables say of it."""
    columns = [c for side in known for c in side.columns if c != "request_id"]
    for side in known:
        requests = requests.join(side, "request_id", "left")
    return (
        requests.select("request_id", *columns, F.explode("facts").alias("fact"))
        .groupBy("request_id", F.col(f"fact.{MONTH}").alias(MONTH))
        .agg(*(F.max(f"fact.{f}").alias(f) for f in flags), *(F.max(c).alias(c) for c in columns))
    )


def _scores(scores: DataFrame, released: DataFrame) -> DataFrame:
    """Scores per request; those of other requests are dropped before they are shuffled."""
    return possibly_in(scores, "request_id", released).groupBy("request_id").agg(
        F.lit(1).alias("scored"), _any(F.col("needs_review")).alias("suspended")
    )


def _released_filter(requests: DataFrame) -> DataFrame:
    # Every request has facts. Asking for them keeps the columns of the exchange, which
    # Spark then makes once for the filter and the join.
    return key_filter(requests.where(F.size("facts") > 0), "request_id")


def suspension_rate(
    users: DataFrame,
    transfers: DataFrame,
    scores: DataFrame,
    config: LimitConfig = LimitConfig(),
    hot: HotKeys | Sequence | None = None,
    policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Suspended share of the scored transfers per month, newest month first.

    NULL where a month has no scored transfer.
    """
    small = transfers.filter(
        (F.col("action_creation_time") >= at(config.outcomes_since))
        & (F.col("invoice_value_gbp") < config.outcome_limit_gbp)
    ).select("user_profile_id", "request_id", "action_creation_time")
    requests = _released_requests(users, small, {}, hot, policy)
    scored_requests = _scores(scores, _released_filter(requests))
    suspended = F.coalesce(F.sum("suspended"), F.lit(0))
    scored = F.coalesce(F.sum("scored"), F.lit(0))
    return (
        _by_month(requests, (), scored_requests)
        .groupBy(MONTH)
        .agg(
            F.try_divide(suspended, scored).alias("percent_transfer_suspended"),
            suspended.alias("total_transfers_suspended"),
        )
        .orderBy(F.col(MONTH).desc_nulls_first())
    )


def fraud_rate(
    users: DataFrame,
    transfers: DataFrame,
    fraud: DataFrame,
    scores: DataFrame,
    config: LimitConfig = LimitConfig(),
    hot: HotKeys | Sequence | None = None,
    policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Fraudulent share of the completed transfers per month, newest month first.

    Balance payments are left out; only months with an engine-suspended and a scored
    transfer are kept. The rate is NULL, not 0, for a month without fraud.
    """
    method = F.col("payment_method")
    small = transfers.filter(
        (F.col("action_creation_time") >= at(config.outcomes_since))
        & ((method != config.balance_method) | method.isNull())
        & (F.col("invoice_value_gbp") <= config.outcome_limit_gbp)
    ).select(
        "user_profile_id", "request_id", "action_creation_time", "action_state",
        "engine_suspend_flag",
    )
    flags = {
        "transferred": F.col("action_state") == config.transferred_state,
        "engine_suspended": F.col("engine_suspend_flag"),
    }
    # Distinct requests: the group of requests without an id counts for nothing.
    known = F.col("request_id").isNotNull()
    requests = _released_requests(users, small, flags, hot, policy)
    released = _released_filter(requests)
    frauds = possibly_in(fraud, "request_id", released).groupBy("request_id").agg(F.lit(1).alias("fraud"))
    counts = (
        _by_month(requests, tuple(flags), frauds, _scores(scores, released))
        .groupBy(MONTH)
        .agg(
            F.coalesce(F.sum("fraud"), F.lit(0)).alias("count_of_fraudulent_transfers"),
            F.sum(F.when(known, F.col("transferred"))).alias("transferred"),
            F.sum(F.when(known, F.col("engine_suspended"))).alias("engine_suspended"),
            F.sum("scored").alias("scored"),
        )
    )
    return (
        counts.filter((F.col("engine_suspended") > 0) & (F.col("scored") > 0))
        .select(
            MONTH,
            F.try_divide(
                F.nullif(F.col("count_of_fraudulent_transfers"), F.lit(0)),
                F.nullif(F.col("transferred"), F.lit(0)),
            ).alias("fraud_rate_transfer_numbers"),
            "count_of_fraudulent_transfers",
        )
        .orderBy(F.col(MONTH).desc_nulls_first())
    )
