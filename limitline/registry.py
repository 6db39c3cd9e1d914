"""Every operator as a named query over the star-schema test tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from limitline.config import SkewPolicy
from limitline.operators import volumes
from limitline.operators.grain import violations
from limitline.operators.skew import shared_folder, stored
from limitline.plans.backtest import Backtest
from limitline.plans.comparison import RuleComparison
from limitline.plans.extracts import Extracts
from limitline.sources.star_schema import from_star_schema, tied_payments
from limitline.sources.tables import Sources

Query = Callable[[SparkSession, str], DataFrame]



def _itself(src: Sources) -> Sources:
    return src


def _new_folder(plan: Backtest | RuleComparison) -> str:
    return f"{shared_folder(plan.payments.sparkSession)}/limitline-{uuid.uuid4().hex}"


def _bucketed(plan: RuleComparison) -> RuleComparison:
    folder = _new_folder(plan)
    plan.bucket_payments(folder.rpartition("/")[2].replace("-", "_"), f"{folder}/payments", buckets=8)
    return plan


BACKTEST: dict[str, Callable[[Backtest], DataFrame]] = {
    "fx_rates": Backtest.rates,
    "payments_entitlement": lambda b: b.payments,
    "single_payment_hit": Backtest.single_payment_hit,
    "single_payment_report": Backtest.single_payment_report,
    "rolling_volumes_grouped": lambda b: b.volumes,
    "volume_by_risk": Backtest.volume_by_risk,
    "limit_date_new": Backtest.limit_date_new,
    "limit_date_old": Backtest.limit_date_old,
    "old_rule_month_pre": lambda b: b.old_rule_month(preconditions=True),
    "old_rule_month": Backtest.old_rule_month,
    "new_rule_month_pre": lambda b: b.new_rule_month(preconditions=True),
    "new_rule_month": Backtest.new_rule_month,
    "first_rule_month": Backtest.first_rule_month,
    "ambiguous_users": Backtest.ambiguous_users,
    "new_rule_report": Backtest.new_rule_report,
    "old_rule_report": Backtest.old_rule_report,
    "released_users": Backtest.released_users,
    "released_users_not_in": Backtest.released_users_not_in,
    "refreshed_old_rule_month": lambda b: b.refreshed_old_rule_month(_new_folder(b), datetime(2020, 7, 1)),
    "volume_check": Backtest.volume_check,
    "suspension_rate": Backtest.suspension_rate,
    "fraud_rate": Backtest.fraud_rate,
}

COMPARISON: dict[str, Callable[[RuleComparison], DataFrame]] = {
    "payments_monitoring": lambda c: c.payments,
    "linked_volumes": RuleComparison.linked_volumes,
    "limit_date_pgl": lambda c: c.limit_date("pgl"),
    "limit_date_lro": lambda c: c.limit_date("lro"),
    "pgl_month": lambda c: c.month("pgl"),
    "pgl_users": RuleComparison.pgl_users,
    "lro_month": lambda c: c.month("lro"),
    "rule_gap": RuleComparison.rule_gap,
    "linked_window_volumes": RuleComparison.linked_window_volumes,
    "linked_window_snapshot": lambda c: c.linked_window_snapshot(_new_folder(c)),
    "lttw_volume": RuleComparison.lttw_volume,
    "limit_date_lttw": lambda c: c.limit_date("lttw"),
    "lttw_month": lambda c: c.month("lttw"),
    "user_window_volumes": RuleComparison.user_window_volumes,
    "ltto_volume": RuleComparison.ltto_volume,
    "limit_date_ltto": lambda c: c.limit_date("ltto"),
    "ltto_month": lambda c: c.month("ltto"),
    "compare_rules": RuleComparison.comparison,
    "compare_rules_joined": RuleComparison.comparison_joined,
    "compare_rules_bucketed": lambda c: _bucketed(c).comparison(),
    "rule_disagreement": RuleComparison.rule_disagreement,
    "rule_counts": RuleComparison.rule_counts,
}

EXTRACTS: dict[str, Callable[[Extracts], DataFrame]] = {
    "lifetime_verified": Extracts.lifetime_verified,
    "lifetime_triggered": Extracts.lifetime_triggered,
    "payment_verified": Extracts.payment_verified,
    "payment_triggered": Extracts.payment_triggered,
    "customer_total": Extracts.customer_total,
    "triggered_users": Extracts.triggered_users,
}

# The volume operators again, over payments of which most share their time; then with every
# customer of more than a few dozen payments taken as too many for one task.
TIED: dict[str, Callable[..., DataFrame]] = {
    "tied_rolling_volumes_grouped": volumes.rolling_volumes_grouped,
    "tied_linked_volumes": volumes.linked_volumes,
    "tied_linked_window_volumes": volumes.linked_window_volumes,
    "tied_user_window_volumes": volumes.user_window_volumes,
}


#: Small enough for hot keys, of which more than the plan keeps, on the smallest table.
BUSY = SkewPolicy(hot_rows=40, max_hot_keys=20, salts=4)

# The verification tables with the sweep of busy customers cut in pieces.
CUT: dict[str, Callable[[Extracts], DataFrame]] = {
    "hot_lifetime_verified": Extracts.lifetime_verified,
    "hot_payment_verified": Extracts.payment_verified,
}


# Over the disputed variant of the tables, in which these have rows.
DISPUTED: dict[str, tuple] = {
    "violations_disputed": (_itself, violations),
    "ambiguous_users_disputed": (Backtest, Backtest.ambiguous_users),
    "rule_gap_disputed": (RuleComparison, RuleComparison.rule_gap),
}


def as_doubles(df: DataFrame) -> DataFrame:
    """Exact decimals to doubles, as the last step."""
    return df.select(
        *(
            F.col(f.name).cast("double").alias(f.name)
            if isinstance(f.dataType, T.DecimalType)
            else F.col(f.name)
            for f in df.schema.fields
        )
    )


def _over(plan, build, disputed: bool = False, **kind) -> Query:
    return lambda spark, sf_dir: as_doubles(build(plan(from_star_schema(spark, sf_dir, disputed), **kind)))


def _over_tied(build, policy: SkewPolicy = SkewPolicy()) -> Query:
    # The search for hot customers and the volumes both read the payments: joined and stored once.
    return lambda spark, sf_dir: as_doubles(build(stored(tied_payments(spark, sf_dir)), policy=policy))


def queries() -> dict[str, Query]:
    named: dict[str, Query] = {f"hot_{name.removeprefix('tied_')}": _over_tied(build, BUSY) for name, build in TIED.items()}
    for plan, builds in ((Backtest, BACKTEST), (RuleComparison, COMPARISON), (Extracts, EXTRACTS)):
        named.update({name: _over(plan, build) for name, build in builds.items()})
    few = SkewPolicy(hot_rows=6, max_hot_keys=20, salts=4)
    named.update({name: _over(Extracts, build, policy=few) for name, build in CUT.items()})
    named["violations"] = _over(_itself, violations)
    named.update({name: _over(plan, build, disputed=True) for name, (plan, build) in DISPUTED.items()})
    named["hot_volume_check"] = _over_tied(volumes.volume_check, BUSY)
    return named | {name: _over_tied(build) for name, build in TIED.items()}
