"""Customers whose limit entitlement was triggered, and how they were verified."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from limitline.config import LimitConfig, SkewPolicy
from limitline.functions.time import DAY_US, at, micros, month_of
from limitline.operators.payments import with_profile
from limitline.operators.prefix import running_totals
from limitline.operators.skew import HotKeys, hot_keys, skew_join
from limitline.sources.tables import Sources

USER = "user_profile_id"
AT = "at_us"


def _find_hot(src: Sources, hot: Mapping[str, HotKeys | Sequence] | None, policy: SkewPolicy):
    if hot is not None:
        return hot
    return {
        **hot_keys(src.triggered_entitlement, "request_id", policy=policy),
        **hot_keys(src.transfer, "user_profile_id", policy=policy),
    }


def hot_verified(src: Sources, hot: Mapping[str, HotKeys | Sequence], policy: SkewPolicy) -> HotKeys:
    """Customers with very many verifications or transfers, of which some have triggers."""
    many = hot_keys(src.profile_verification_history_sm, USER, policy=policy)[USER]
    moved = hot[USER] if isinstance(hot[USER], HotKeys) else HotKeys.of(src.transfer, USER, hot[USER], policy)
    if not (many and moved):
        return many or moved
    both = many.table.union(moved.table).distinct()
    return HotKeys(both, many.count + moved.count, policy)


def _triggers(
    src: Sources,
    entitlement: str,
    since: datetime | None,
    until: datetime | None,
    config: LimitConfig,
    hot: Mapping[str, HotKeys | Sequence],
    policy: SkewPolicy,
) -> DataFrame:
    """Triggers of one entitlement by personal customers, with risk level."""
    triggers = src.triggered_entitlement.filter(F.col("entitlement_id") == entitlement)
    if since is not None:
        triggers = triggers.filter(F.col("date_created") >= at(since))
    if until is not None:
        triggers = triggers.filter(F.col("date_created") < at(until))
    profiles = src.user_profile.filter(F.col("class").ilike(config.personal_pattern)).select(
        F.col("id").alias("user_profile_id")
    )
    transfers = src.transfer.select(F.col("id").alias("request_id"), "user_profile_id")
    owned = skew_join(
        triggers, "request_id", [(transfers, "inner")], hot["request_id"], policy
    ).drop("request_id")
    return with_profile(owned, profiles, src, hot["user_profile_id"], policy)


def _sweep(asks: DataFrame, seen: DataFrame, before: int, after: int) -> tuple[DataFrame, DataFrame]:
    """Triggers with the number of verifications up to either end of their span, and the
    verifications numbered by time. A customer costs one sort of each."""
    both = asks.withColumn("one", F.lit(0)).unionByName(
        seen.select(USER, AT, F.lit(1).alias("one")), allowMissingColumns=True
    )
    upto = f"coalesce(sum(one) over (partition by {USER} order by {AT} range between unbounded preceding and"
    counted = both.selectExpr(
        *asks.columns, "one", f"{upto} {before}L preceding), 0L) as earlier", f"{upto} {after}L following), 0L) as reached"
    ).where("one = 0")
    # Of equal time and method, any order will do.
    number = f"row_number() over (partition by {USER} order by {AT}, verification_method)"
    return counted.drop("one"), seen.selectExpr(USER, "verification_method", f"cast({number} as bigint) as number")


def _cut_sweep(asks: DataFrame, seen: DataFrame, before: int, after: int) -> tuple[DataFrame, DataFrame]:
    """The same for customers with too many of either for one task: distributed prefix sums."""
    slots = (
        seen.groupBy(USER, AT, "verification_method")
        .agg(F.count(F.lit(1)).alias("copies"))
        .selectExpr(USER, f"{AT} as place", "0 as asks", "verification_method", "copies")
    )

    def asked(rows: DataFrame, at: str, name: str) -> DataFrame:
        both = rows.withColumns({"place": F.expr(at), "asks": F.lit(1), "copies": F.lit(0).cast("bigint")})
        both = both.unionByName(slots.drop("verification_method"), allowMissingColumns=True)
        # A verification at the very end comes before the question.
        counted = running_totals(both, [USER], ["place", "asks"], "copies", "bigint", name)
        return counted.where("asks = 1").select(*rows.columns, name)

    counted = asked(asked(asks, f"{AT} - {before}L", "earlier"), f"{AT} + {after}L", "reached")
    numbered = running_totals(slots, [USER], ["place", "verification_method"], "copies", "bigint", "last")
    return counted, numbered.selectExpr(
        USER, "verification_method", "explode(sequence(last - copies + 1, last)) as number"
    )


def verified_near(
    triggers: DataFrame,
    history: DataFrame,
    days_before: int,
    days_after: int,
    hot: HotKeys | Sequence = (),
    policy: SkewPolicy = SkewPolicy(),
) -> DataFrame:
    """Left join each trigger with the verifications around it.

    A verification matches from strictly after ``days_before`` days before the trigger
    up to and including ``days_after`` days after it. A sweep over time numbers each
    customer's verifications, so that those of a trigger are a range of numbers: the ones
    up to the end of its span without those up to its start. The range is unfolded and
    joined on (customer, number), which makes exactly the rows of the result, dealt out by
    number however busy the customer. ``hot`` lists customers whose sweep is cut in pieces.
    """
    before, after = days_before * DAY_US, days_after * DAY_US
    asks = triggers.withColumn(AT, micros("date_created"))
    seen = history.where(f"{USER} is not null and first_verification_time is not null").select(
        USER, micros("first_verification_time").alias(AT), "verification_method"
    )
    if not isinstance(hot, HotKeys):
        hot = HotKeys.of(triggers, USER, hot, policy)
    if hot:
        (cold_asks, hot_asks), (cold_seen, hot_seen) = hot.split(asks, USER), hot.split(seen, USER)
        plain, cut = _sweep(cold_asks, cold_seen, before, after), _cut_sweep(hot_asks, hot_seen, before, after)
        asked, numbered = (a.unionByName(b) for a, b in zip(plain, cut))
    else:
        asked, numbered = _sweep(asks, seen, before, after)
    range_ = F.expr("if(reached > earlier, sequence(earlier + 1, reached), null)")
    return (
        asked.withColumn("number", F.explode_outer(range_))
        .join(numbered, [USER, "number"], "left")
        .select(*triggers.columns, "verification_method")
    )


def entitlement_verified(
    src: Sources,
    entitlement: str,
    since: datetime | None = None,
    until: datetime | None = None,
    config: LimitConfig = LimitConfig(),
    policy: SkewPolicy = SkewPolicy(),
    hot: Mapping[str, HotKeys | Sequence] | None = None,
) -> DataFrame:
    """Triggers of an entitlement with the verifications that followed, if any."""
    hot = _find_hot(src, hot, policy)
    triggers = _triggers(src, entitlement, since, until, config, hot, policy)
    # The dates of the triggers bound those of the verifications that can match.
    history = src.profile_verification_history_sm
    verified = F.col("first_verification_time")
    if since is not None:
        history = history.filter(verified > at(since - timedelta(config.verified_days_before)))
    if until is not None:
        history = history.filter(verified < at(until + timedelta(config.verified_days_after)))
    busy = hot.get("verified_user")
    if busy is None:
        busy = hot_verified(src, hot, policy)
    matched = verified_near(
        triggers, history, config.verified_days_before, config.verified_days_after, busy, policy
    )
    return matched.select(
        F.col("user_profile_id").alias("profile_id"),
        month_of("date_created").alias("entitlement_month"),
        "verification_method", "risk_level", "entitlement_id",
    )


def entitlement_triggered(
    src: Sources,
    entitlement: str,
    since: datetime | None = None,
    until: datetime | None = None,
    config: LimitConfig = LimitConfig(),
    policy: SkewPolicy = SkewPolicy(),
    hot: Mapping[str, HotKeys | Sequence] | None = None,
) -> DataFrame:
    """Triggers of an entitlement."""
    triggers = _triggers(
        src, entitlement, since, until, config, _find_hot(src, hot, policy), policy
    )
    return triggers.select(
        F.col("user_profile_id").alias("profile_id"),
        month_of("date_created").alias("entitlement_month"),
        "risk_level",
    )


def triggered_users(src: Sources, since: datetime = LimitConfig().triggered_since) -> DataFrame:
    """Distinct customers with any entitlement triggered since a date.

    Requests are made distinct before the join, so copies never reach the shuffle and
    the join reuses that partitioning; a trigger without a transfer has no customer.
    """
    requests = (
        src.triggered_entitlement.filter(F.col("date_created") >= at(since))
        .select("request_id")
        .distinct()
    )
    owners = src.transfer.select(F.col("id").alias("request_id"), "user_profile_id")
    return requests.join(owners, "request_id").agg(
        F.count_distinct("user_profile_id").alias("customers")
    )
